"""The transaction coordinator's commands folded in order, and its time-outs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coordinate(commands: DataFrame) -> DataFrame:
    """Answers each command of a transactional id, in order of ``seq``.

    ``commands``: txn_id, seq, command (init | add_partition | add_offsets | commit_offset | end), pid, epoch, topic,
    partition, offset, commit.  An init bumps the epoch and aborts what is running; others need the current pid and
    epoch; a partition or offset opens a transaction; an end answers the partitions that get a marker and, if it
    commits, the offsets that become visible.  Offsets of one transaction are merged by topic and partition, the last
    one wins; ending twice the same way is answered again, another way is refused.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, epoch, parts, pending, last, out = "none", -1, set(), {}, None, []
        for r in rows.sort_values("seq").itertuples():
            status, markers, visible = "ok", [], []
            if r.command == "init":
                if state == "Ongoing":
                    markers, last = sorted(parts), False
                state, epoch, parts, pending = "Empty", epoch + 1, set(), {}
            elif state == "none":
                status = "unknown_id"
            elif int(r.epoch) < epoch:
                status = "fenced"
            elif int(r.epoch) > epoch:
                status = "invalid_epoch"
            elif r.command in ("add_partition", "add_offsets"):
                if state != "Ongoing":
                    state, parts, pending = "Ongoing", set(), {}
                if r.command == "add_partition":
                    parts.add(f"{r.topic}-{int(r.partition)}")
            elif r.command == "commit_offset":
                if state != "Ongoing":
                    status = "invalid_state"
                else:
                    pending[f"{r.topic}-{int(r.partition)}"] = int(r.offset)
            elif state == "Ongoing":
                markers, last = sorted(parts), bool(r.commit)
                visible = [f"{k}@{v}" for k, v in sorted(pending.items())] if last else []
                state, parts, pending = "CompleteCommit" if last else "CompleteAbort", set(), {}
            elif not state.startswith("Complete") or last != bool(r.commit):
                status = "invalid_state"
            out.append((key[0], int(r.seq), status, state, epoch, ",".join(markers), ",".join(visible)))
        return pd.DataFrame(out, columns=["txn_id", "seq", "status", "state", "epoch", "markers", "offsets"])

    return commands.groupBy("txn_id").applyInPandas(run, "txn_id string, seq long, status string, state string, epoch long, markers string, offsets string")


def timed_out(states: DataFrame, now_ms: int) -> DataFrame:
    """Running transactions past their time-out, which the coordinator aborts with the next epoch.

    ``states``: txn_id, pid, epoch, state, started_ms, timeout_ms.
    """
    late = (F.col("state") == "Ongoing") & (F.col("started_ms") + F.col("timeout_ms") <= now_ms)
    return states.where(late).select("txn_id", "pid", (F.col("epoch") + 1).alias("epoch"), F.lit("abort").alias("action"))


def newer_image(records: DataFrame, known: int) -> DataFrame:
    """The whole metadata log if it goes beyond the caller's version, else nothing."""
    return records.where(records.agg(F.max("version")).scalar() > F.lit(known))


def topic_configs(requests: DataFrame) -> DataFrame:
    """retention_ms, retention_bytes and tiered from a map of strings; ``-1``, empty and missing mean the default."""

    def number(name: str):
        value = F.col("configs")[name]
        return F.when(value.isNull() | value.isin("", "-1"), F.lit(None)).otherwise(value).try_cast("long")

    return requests.select("topic", number("retention.ms").alias("retention_ms"), number("retention.bytes").alias("retention_bytes"), (F.coalesce(F.col("configs")["tiered"], F.lit("false")) == "true").alias("tiered"))
