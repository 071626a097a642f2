"""Reads of a partitioned log: offset ranges, byte budgets, isolation, time and segment look-ups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.transactions import aborted_ranges
from tidemark.operators.watermarks import watermarks


class InvalidRequest(ValueError):
    """A request that is answered with error 42."""


class OffsetOutOfRange(ValueError):
    """A fetch from below the log's start or beyond what may be read (error 1)."""


def range_scan(log: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Rows with ``start <= offset < end``: literals, so they reach the file statistics."""
    rows = log.where(F.col("offset") >= start)
    return rows if end is None else rows.where(F.col("offset") < end)


def capped(log: DataFrame, caps: DataFrame, cap: str) -> DataFrame:
    """Rows below their partition's cap; ``caps`` has a row a partition."""
    return log.join(caps.select("partition", F.col(cap).alias("_cap")), "partition").where(F.col("offset") < F.col("_cap")).drop("_cap")


def read_uncommitted(log: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Data below the high watermark; markers are never shown.  ``marks``: the log's watermarks, where they are kept."""
    return capped(log, watermarks(log) if marks is None else marks, "hw").where("NOT is_control")


def read_committed(log: DataFrame, marks: DataFrame | None = None, aborted: DataFrame | None = None) -> DataFrame:
    """Data below the last stable offset without rows of aborted transactions.  ``marks`` and ``aborted``: the log's
    watermarks and aborted ranges, where they are kept.

    The anti join has the equi keys (partition, producer, epoch) beside its range, so it hashes.
    """
    visible = capped(log, watermarks(log) if marks is None else marks, "lso").where("NOT is_control")
    bad = (aborted_ranges(log) if aborted is None else aborted).select(F.col("partition").alias("p"), F.col("producer_id").alias("pid"), F.col("producer_epoch").alias("e"), "first_offset", "last_offset")
    same = (F.col("partition") == F.col("p")) & (F.col("producer_id") == F.col("pid")) & (F.col("producer_epoch") == F.col("e"))
    inside = (F.col("offset") >= F.col("first_offset")) & (F.col("offset") <= F.col("last_offset")) & F.col("is_txn")
    return visible.join(bad, same & inside, "left_anti")


def batches(log: DataFrame) -> DataFrame:
    """One row per batch: partition, batch, base_offset, last_offset, bytes, records, max_ts.

    A batch's size counts a fixed header beside its records.
    """
    data = log.where("NOT is_control")
    return data.groupBy("partition", "batch").agg(F.min("offset").alias("base_offset"), F.max("offset").alias("last_offset"), (F.sum("bytes") + 61).alias("bytes"), F.count("*").alias("records"), F.max("ts_ms").alias("max_ts"), F.min("ts_ms").alias("first_ts"))


def budgeted(batch_rows: DataFrame, start: int, max_bytes: int) -> DataFrame:
    """Whole batches from ``start`` on until the budget is used up; the first one always comes."""
    order = Window.partitionBy("partition").orderBy("base_offset")
    before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return batch_rows.where(F.col("last_offset") >= start).withColumn("_before", before).where((F.col("_before") < max_bytes) | (F.col("_before") == 0)).drop("_before")


def segment_of(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """The last segment whose base is not above each probed offset: an as-of look-up, where probes stand behind the
    segments up to them in one order."""
    none = F.lit(None).cast("struct<segment: bigint, base: bigint>")
    both = segments.select("partition", F.col("base").alias("probe"), F.struct(F.col("segment").cast("long").alias("segment"), F.col("base").cast("long").alias("base")).alias("_s"), F.lit(False).alias("_asks"))
    both = both.unionByName(probes.select("partition", "probe", none.alias("_s"), F.lit(True).alias("_asks")))
    order = Window.partitionBy("partition").orderBy("probe", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_s", F.last("_s", ignorenulls=True).over(order)).where("_asks")
    return met.select("partition", "probe", F.coalesce("_s.segment", F.lit(-1)).cast("long").alias("segment"), F.coalesce("_s.base", F.lit(-1)).cast("long").alias("base"))


def offset_index(batch_rows: DataFrame, every: int = 4096) -> DataFrame:
    """The sparse index of each segment: the first batch that begins in each stretch of ``every`` bytes.

    ``batch_rows``: partition, segment, base_offset, bytes.  Adds position; ``segment_of`` finds a floor entry.
    """
    order = Window.partitionBy("partition", "segment").orderBy("base_offset")
    placed = batch_rows.withColumn("position", F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stretch = F.floor(F.col("position") / every)
    before = F.lag(stretch).over(order)
    return placed.withColumn("_new", before.isNull() | (before < stretch)).where("_new").select("partition", "segment", "base_offset", "position")


def time_index(batch_rows: DataFrame) -> DataFrame:
    """Batches whose newest time is beyond that of all before them: strictly increasing times by offset."""
    order = Window.partitionBy("partition").orderBy("base_offset")
    before = F.max("max_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return batch_rows.withColumn("_before", before).where("_before IS NULL OR max_ts > _before").select("partition", "base_offset", "max_ts")


def fetch_status(marks: DataFrame, requests: DataFrame) -> DataFrame:
    """What a fetch from ``start`` is answered: error 1 below the log's start or beyond the cap, and whether there is
    anything to read.  ``marks``: partition, log_start, hw; ``requests``: partition, start."""
    joined = requests.join(marks.select("partition", "log_start", "hw"), "partition", "left")
    out = F.when(F.col("hw").isNull(), 3).when((F.col("start") < F.col("log_start")) | (F.col("start") > F.col("hw")), 1).otherwise(0)
    return joined.withColumn("error", out).select("partition", "start", "error", ((F.col("error") == 0) & (F.col("start") < F.col("hw"))).alias("has_rows"))


def consumed(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages and bytes that each connection's fetches were answered with.

    ``requests``: connection, partition, start, records (how many offsets are read).  Each offset meets the log by
    equality.
    """
    wanted = requests.select("connection", "partition", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("records") - 1)).alias("offset"))
    met = wanted.join(log.where("NOT is_control").select("partition", "offset", "bytes"), ["partition", "offset"])
    return met.groupBy("connection").agg(F.count("*").alias("messages"), F.sum("bytes").alias("bytes"))


def segments(log: DataFrame, batches_a_segment: int) -> DataFrame:
    """Segments of a fixed number of batches: base, last, bytes, records, newest time."""
    parts = batches(log).withColumn("segment", F.floor(F.col("batch") / batches_a_segment).cast("long"))
    return parts.groupBy("partition", "segment").agg(F.min("base_offset").alias("base"), F.max("last_offset").alias("last_offset"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"), F.max("max_ts").alias("max_ts"))


def list_offsets(log: DataFrame, timestamp: int, log_start: int = 0) -> DataFrame:
    """-1: the high watermark; -2: the log start; else the first offset at or after the time, or -1."""
    if timestamp == -1:
        return watermarks(log, log_start).select("partition", F.lit(-1).cast("long").alias("ts_ms"), F.col("hw").alias("offset"))
    if timestamp == -2:
        return watermarks(log, log_start).select("partition", F.lit(-2).cast("long").alias("ts_ms"), F.col("log_start").alias("offset"))
    late = (F.col("ts_ms") >= timestamp) & ~F.col("is_control")
    found = log.groupBy("partition").agg(F.min(F.when(late, F.col("offset"))).alias("offset"), F.min_by("ts_ms", F.when(late, F.col("offset"))).alias("ts_ms"))
    return found.select("partition", F.when(F.col("offset").isNull(), -1).otherwise(F.col("ts_ms")).cast("long").alias("ts_ms"), F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"))


def tiered_union(local: DataFrame, tier: DataFrame, first_local: DataFrame) -> DataFrame:
    """Rows from the tier below each partition's first local offset, and the local rows from there on."""
    firsts = first_local.select("partition", "first_local")
    old = tier.join(firsts, "partition", "left").where("first_local IS NULL OR offset < first_local").drop("first_local")
    new = local.join(firsts, "partition", "left").where("first_local IS NULL OR offset >= first_local").drop("first_local")
    return old.unionByName(new)


def subscribed(topics: DataFrame, names: list[str], pattern: str) -> DataFrame:
    """Topics named or matching the whole pattern; a pattern that is none is refused (error 42)."""
    try:
        re.compile(pattern)
    except re.error as wrong:
        raise InvalidRequest(f"error 42: {wrong}") from wrong
    return topics.where(F.col("topic").isin(names) | F.col("topic").rlike(f"^(?:{pattern})$"))


def changed_partitions(fetched: DataFrame) -> DataFrame:
    """What an incremental fetch answers: partitions with bytes or an error."""
    return fetched.where("bytes > 0 OR error <> 0")
