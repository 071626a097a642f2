"""Appends: offsets, contiguity, segment rolls and idempotent producers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REMEMBERED = 5


class InvalidRecords(ValueError):
    """Rows that an append refuses as a whole, before anything is written."""


def assign_offsets(batch_rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Base offsets behind each partition's end, in order of ``seq``.  ``ends``: partition, leo."""
    before = Window.partitionBy("partition").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    joined = batch_rows.join(ends, "partition", "left")
    return joined.withColumn("base_offset", F.coalesce("leo", F.lit(0)) + F.coalesce(F.sum("records").over(before), F.lit(0))).withColumn("last_offset", F.col("base_offset") + F.col("records") - 1).drop("leo")


def contiguity_violations(batch_rows: DataFrame) -> DataFrame:
    """Batches whose base is not one behind the batch before: what an absolute append refuses."""
    before = F.lag("last_offset").over(Window.partitionBy("partition").orderBy("base_offset"))
    return batch_rows.withColumn("expected", before + 1).where("expected IS NOT NULL AND expected <> base_offset").select("partition", "base_offset", "expected")


def last_batches(batch_rows: DataFrame, n: int = REMEMBERED) -> DataFrame:
    """The last ``n`` batches of each producer in a partition."""
    recent = Window.partitionBy("partition", "producer_id").orderBy(F.desc("base_offset"))
    return batch_rows.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= n).drop("_r")


def roll_segments(batch_rows: DataFrame, max_bytes: int) -> DataFrame:
    """Greedy segments: a new one starts when the active one is not empty and would grow past the limit.

    Greedy sums depend on each earlier cut, so a partition's batches are folded in order, batch by batch of rows.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("base_offset")
        size, segment, out = 0, 0, []
        for n in rows["bytes"]:
            if size and size + n > max_bytes:
                segment, size = segment + 1, 0
            size += n
            out.append(segment)
        return rows[["partition", "base_offset"]].assign(segment=out)

    return batch_rows.select("partition", "base_offset", "bytes").groupBy("partition").applyInPandas(run, "partition long, base_offset long, segment long")


class ProducerState:
    """One producer in one partition: newer epochs start over, older ones are fenced; of the last batches a repeat is
    answered with its first offsets, an older repeat and a gap are errors.  Only accepted batches are remembered."""

    def __init__(self, epoch: int = -1, batches: list[tuple[int, int, int]] | None = None):
        self.epoch, self.batches = epoch, batches or []  # (first sequence, last sequence, base offset)

    def take(self, epoch: int, first: int, records: int, offset: int) -> tuple[str, int]:
        if epoch < self.epoch:
            return "fenced", -1
        if epoch > self.epoch:
            self.epoch, self.batches = epoch, []
        last = first + records - 1
        if self.batches and first != self.batches[-1][1] + 1:
            for a, b, base in self.batches:
                if (a, b) == (first, last):
                    return "duplicate", base
            return ("duplicate_sequence" if first <= self.batches[-1][1] else "out_of_order"), -1
        self.batches = [*self.batches, (first, last, offset)][-REMEMBERED:]
        return "accepted", offset


def idempotent(writes: DataFrame) -> DataFrame:
    """The fold of :class:`ProducerState` over writes in order of ``seq``.

    ``writes``: partition, producer_id, seq, producer_epoch, base_sequence, records.  Adds status and base (the offset
    counted within the producer's accepted rows).  State is per producer, so partitions of many producers spread.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, end, out = ProducerState(), 0, []
        for r in rows.sort_values("seq").itertuples():
            status, base = state.take(int(r.producer_epoch), int(r.base_sequence), int(r.records), end)
            end += int(r.records) if status == "accepted" else 0
            out.append((int(key[0]), int(key[1]), int(r.seq), status, base))
        return pd.DataFrame(out, columns=["partition", "producer_id", "seq", "status", "base"])

    return writes.groupBy("partition", "producer_id").applyInPandas(run, "partition long, producer_id long, seq long, status string, base long")


#: Error numbers of the protocol (fixed values).
UNKNOWN_TOPIC, NOT_ENOUGH_REPLICAS, INVALID_ACKS, NOT_ALLOWED, STORAGE_ERROR = 3, 19, 21, 29, 56


def produce_status(requests: DataFrame) -> DataFrame:
    """Adds ``error``: what a write is refused for before anything is appended, else 0.

    ``requests``: acks, known (the topic or id has a route), allowed, read_only (the disk is full), enough_replicas.
    """
    error = F.when(~F.col("acks").isin(-1, 0, 1), INVALID_ACKS).when(~F.col("known"), UNKNOWN_TOPIC).when(~F.col("allowed"), NOT_ALLOWED).when(F.col("read_only"), STORAGE_ERROR)
    return requests.withColumn("error", error.when((F.col("acks") == -1) & ~F.col("enough_replicas"), NOT_ENOUGH_REPLICAS).otherwise(0))


def trusted_segments(segments: DataFrame) -> DataFrame:
    """Adds ``trusted``: recovery need not read a segment whose size is the recorded one and which begins where the
    one before ends.  ``segments``: partition, base, last_offset, bytes, recorded_bytes."""
    before = F.lag("last_offset").over(Window.partitionBy("partition").orderBy("base"))
    return segments.withColumn("trusted", (F.col("recorded_bytes") == F.col("bytes")) & F.coalesce(before + 1 == F.col("base"), F.lit(True)))
