"""Decisions of a node: waiting readers, followers' pulls, a new image, the gate before a login, upload delays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests that a connection may send before its login (fixed values): versions, handshake, authentication.
OPEN_REQUESTS = (18, 17, 36)
#: What an upload's window lasts.
WINDOW_MS = 1000


def long_polls(requests: DataFrame, ready: DataFrame) -> DataFrame:
    """When waiting readers are answered: at once if their offset can be read, else when it can, at the deadline at
    the latest - an empty answer is no error.

    ``requests``: request, partition, offset, asked_ms, wait_ms; ``ready``: partition, offset, ready_ms, the moment
    from which a reader's isolation shows the offset.  Adds sent_ms and timed_out.
    """
    joined = requests.join(ready.select("partition", "offset", "ready_ms"), ["partition", "offset"], "left")
    deadline = F.col("asked_ms") + F.greatest(F.col("wait_ms"), F.lit(0))
    late = F.coalesce(F.col("ready_ms") > deadline, F.lit(True))
    sent = F.when(late, deadline).otherwise(F.greatest("asked_ms", "ready_ms"))
    return joined.select(*requests.columns, sent.alias("sent_ms"), late.alias("timed_out"))


def pull_steps(pulls: DataFrame) -> DataFrame:
    """A follower's step after a leader's answer, and the offset it asks for next.

    ``pulls``: next_offset, local_leo, blocked (the leader is cut off), failed (no answer), error, leader_next, base
    and last (of the slice that came; null: none).  A slice that does not begin at the local end is a gap.
    """
    step = F.when(F.col("blocked"), "stop").when(F.col("failed") | (F.col("error") != 0), "wait").when(F.col("leader_next") < F.col("next_offset"), "truncate")
    step = step.when(F.col("base").isNull(), "poll").when(F.col("base") != F.col("local_leo"), "retry").otherwise("append")
    stepped = pulls.withColumn("step", step)
    then = F.when(F.col("step") == "truncate", F.col("leader_next")).when(F.col("step") == "retry", F.col("local_leo")).when(F.col("step") == "append", F.col("last") + 1)
    return stepped.withColumn("then_offset", F.coalesce(then, F.col("next_offset")))


def image_steps(before: DataFrame, after: DataFrame, before_nodes: DataFrame, after_nodes: DataFrame, node: int) -> DataFrame:
    """What ``node`` does for each partition when a new image replaces the old one.

    ``before`` and ``after``: topic, partition, replicas, leader, epoch; ``*_nodes``: node, address.  Columns step
    (start, update, drop, none), role, reconcile (a leader of a new epoch first fetches what replicas hold beyond it)
    and pull (start, restart, stop, keep, none).
    """

    def side(rows: DataFrame, nodes: DataFrame, mark: str) -> DataFrame:
        at = nodes.select(F.col("node").alias("leader"), F.col("address").alias(f"{mark}_address"))
        own = rows.join(at, "leader", "left")
        return own.select("topic", "partition", F.array_contains("replicas", node).alias(f"{mark}_own"), F.col("leader").alias(f"{mark}_leader"), F.col("epoch").alias(f"{mark}_epoch"), f"{mark}_address")

    both = side(before, before_nodes, "old").join(side(after, after_nodes, "new"), ["topic", "partition"], "full")
    had, has = F.coalesce("old_own", F.lit(False)), F.coalesce("new_own", F.lit(False))
    leads = F.col("new_leader") == node
    step = F.when(had & F.col("new_own").isNull(), "drop").when(has & ~had, "start").when(has, "update").otherwise("none")
    both = both.withColumn("step", step)
    active = F.col("step").isin("start", "update")
    known = F.col("new_address").isNotNull()
    moved = ~F.col("old_address").eqNullSafe(F.col("new_address")) | (F.col("old_leader") == node)
    pull = F.when(~active, "none").when(leads, F.when(F.col("step") == "start", "none").otherwise("stop")).when(F.col("step") == "start", F.when(known, "start").otherwise("none"))
    return both.select(
        "topic", "partition", "step",
        F.when(active, F.when(leads, "leader").otherwise("follower")).alias("role"),
        F.coalesce((F.col("step") == "update") & leads & (F.col("new_epoch") > F.col("old_epoch")), F.lit(False)).alias("reconcile"),
        pull.otherwise(F.when(known & moved, "restart").otherwise("keep")).alias("pull"),
    )


def admitted(requests: DataFrame) -> DataFrame:
    """Whether a connection may send a request: anything after its login, before it what a login needs.
    ``requests``: api_key, user (null: nobody yet)."""
    return requests.withColumn("admitted", F.col("user").isNotNull() | F.coalesce(F.col("api_key").isin(*OPEN_REQUESTS), F.lit(False)))


def upload_delays(uploads: DataFrame, rate: int) -> DataFrame:
    """How long each upload of a store waits under ``rate`` bytes a second (0: no limit).

    ``uploads``: store, seq, at_ms, bytes, taken by seq.  The first upload a second or more after a window began opens
    the next and is free; others wait for what passes the rate and are not counted then.  Rows stream by a sort; the
    state is one window."""
    kept = uploads.select(F.col("store").cast("long").alias("store"), F.col("seq").cast("long").alias("seq"), F.col("at_ms").cast("long").alias("at_ms"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"))
    if not rate:
        return kept.select("store", "seq", F.lit(0).cast("long").alias("delay_ms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: object = run  # no store yet
        start = used = 0
        for batch in batches:
            seqs, delays = batch.column(1), []
            for store, at, size in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                delay = 0
                if store != own:  # a store's first window begins with its first upload
                    own, start, used = store, at, 0
                if at - start >= WINDOW_MS:
                    start, used = at, 0
                elif used + size <= rate:
                    used += size
                else:
                    delay = max(1, (used + size - rate) * 1000 // rate)
                delays.append(delay)
            yield pa.RecordBatch.from_arrays([batch.column(0), seqs, pa.array(delays, pa.int64())], names=["store", "seq", "delay_ms"])

    return kept.repartition("store").sortWithinPartitions("store", "seq").mapInArrow(run, "store long, seq long, delay_ms long")
