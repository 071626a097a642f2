"""Stateful streaming forms of the ordered operators.

Rows of one key in a micro-batch come in no order: each processor sorts them by their sequence before it folds.  A
key is a producer in a partition, or a partition, so state is spread by key and bounded per key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.append import ProducerState

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sorted_rows(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    parts = list(rows)
    return pd.concat(parts).sort_values(by, kind="stable") if parts else pd.DataFrame()


class Deduplicate(StatefulProcessor):
    """Idempotent producers: state is the epoch, the last batches and the producer's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("producer", "epoch int, batches string, end long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        producer, end = ProducerState(), 0
        if self.state.exists():
            epoch, batches, end = self.state.get()
            producer = ProducerState(epoch, [tuple(b) for b in json.loads(batches)])
        out = []
        for r in sorted_rows(rows, "seq").itertuples():
            status, base = producer.take(int(r.producer_epoch), int(r.base_sequence), int(r.records), end)
            end += int(r.records) if status == "accepted" else 0
            out.append((int(key[0]), int(key[1]), int(r.seq), status, base))
        self.state.update((producer.epoch, json.dumps(producer.batches), end))
        yield pd.DataFrame(out, columns=["partition", "producer_id", "seq", "status", "base"])

    def close(self) -> None:
        pass


def deduplicated(writes: DataFrame) -> DataFrame:
    """The streaming form of ``operators.append.idempotent``."""
    schema = StructType.fromDDL("partition long, producer_id long, seq long, status string, base long")
    return writes.groupBy("partition", "producer_id").transformWithStateInPandas(statefulProcessor=Deduplicate(), outputStructType=schema, outputMode="append", timeMode="None")


class StableOffset(StatefulProcessor):
    """Open transactions of a partition: the last stable offset after each micro-batch, and the ranges that closed.

    Keyed by partition alone, since the last stable offset is a minimum over all its producers.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "end long, open string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end, running = 0, {}
        if self.state.exists():
            end, text = self.state.get()
            running = {tuple(k): v for k, v in json.loads(text)}
        closed = []
        for r in sorted_rows(rows, "offset").itertuples():
            end = max(end, int(r.offset) + 1)
            if not r.is_txn:
                continue
            name = (int(r.producer_id), int(r.producer_epoch))
            if r.is_control:
                first = running.pop(name, None)
                if first is not None:
                    closed.append((int(key[0]), "closed", name[0], name[1], first[0], first[1], int(r.control_type)))
            else:
                for other in [o for o in running if o[0] == name[0] and o[1] < name[1]]:
                    first = running.pop(other)  # a newer epoch ends what the older one left open
                    closed.append((int(key[0]), "closed", other[0], other[1], first[0], first[1], 0))
                first = running.get(name, (int(r.offset), int(r.offset)))
                running[name] = (first[0], int(r.offset))
        lso = min([end, *(first for first, _ in running.values())])
        self.state.update((end, json.dumps([[list(k), list(v)] for k, v in running.items()])))
        out = [*closed, (int(key[0]), "mark", None, None, lso, end, None)]
        frame = pd.DataFrame(out, columns=["partition", "kind", "producer_id", "producer_epoch", "first_offset", "last_offset", "control_type"])
        yield frame.astype({"producer_id": "Int64", "producer_epoch": "Int64", "control_type": "Int32"})

    def close(self) -> None:
        pass


def stable_offsets(log: DataFrame) -> DataFrame:
    """Rows ``closed`` (a transaction's range and outcome) and ``mark`` (first_offset: last stable offset,
    last_offset: end) of a streamed log."""
    schema = StructType.fromDDL("partition long, kind string, producer_id long, producer_epoch long, first_offset long, last_offset long, control_type int")
    rows = log.select("partition", "offset", "producer_id", "producer_epoch", "is_txn", "is_control", F.coalesce("control_type", F.lit(-1)).alias("control_type"))
    return rows.groupBy("partition").transformWithStateInPandas(statefulProcessor=StableOffset(), outputStructType=schema, outputMode="append", timeMode="None")


class ShareLocks(StatefulProcessor):
    """Share-group deliveries of a partition with locks that run out by a processing-time timer."""

    def __init__(self, lock_ms: int = 30_000, limit: int = 5):
        self.lock_ms, self.limit = lock_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("share", "offsets string")

    def load(self) -> dict[int, list]:
        return {int(k): v for k, v in json.loads(self.state.get()[0]).items()} if self.state.exists() else {}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = self.load(), []  # offset -> [state, holder, deliveries, lock's end]
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in sorted_rows(rows, "seq").itertuples():
            for o in range(int(r.first), int(r.last) + 1):
                state, holder, count, until = held.get(o, ["free", None, 0, 0])
                if state == "locked" and until <= now:
                    state, holder = "free", None
                if r.kind == "fetch" and state == "free" and count < self.limit:
                    held[o] = ["locked", r.member, count + 1, now + self.lock_ms]
                    out.append((key[0], int(key[1]), int(r.seq), o, r.member, count + 1))
                elif r.kind != "fetch" and state == "locked" and holder == r.member:
                    held[o] = ["free" if r.kind == "release" else "done", None, count, 0]
        self.state.update((json.dumps(held),))
        if any(v[0] == "locked" for v in held.values()):
            self.handle.registerTimer(now + self.lock_ms)
        yield pd.DataFrame(out, columns=["group", "partition", "seq", "offset", "member", "deliveries"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, now = self.load(), timerValues.getCurrentProcessingTimeInMs()
        for o, v in held.items():
            if v[0] == "locked" and v[3] <= now:
                held[o] = ["free", None, v[2], 0]
        self.state.update((json.dumps(held),))
        yield pd.DataFrame([], columns=["group", "partition", "seq", "offset", "member", "deliveries"])

    def close(self) -> None:
        pass


def share_deliveries(events: DataFrame, lock_ms: int = 30_000, limit: int = 5) -> DataFrame:
    schema = StructType.fromDDL("group string, partition long, seq long, offset long, member string, deliveries int")
    return events.groupBy("group", "partition").transformWithStateInPandas(statefulProcessor=ShareLocks(lock_ms, limit), outputStructType=schema, outputMode="append", timeMode="ProcessingTime")


def append_sink(path: str):
    """A ``foreachBatch`` writer whose replays are idempotent: a batch's rows live in a folder of its number."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
