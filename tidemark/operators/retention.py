"""Retention, truncation, deletion and tiering as predicates over segments and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_time(segments: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Adds ``deleted``: the oldest run of sealed segments whose newest row and file time are both too old.

    ``segments``: partition, base, max_ts, mtime_ms, sealed.
    """
    limit = now_ms - retention_ms
    old = F.col("sealed") & (F.col("max_ts") < limit) & (F.col("mtime_ms") < limit)
    before = Window.partitionBy("partition").orderBy("base").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("deleted", F.min(old.cast("int")).over(before) == 1)


def by_bytes(segments: DataFrame, max_bytes: int) -> DataFrame:
    """Adds ``deleted``: sealed segments go from the oldest on while the whole is over the limit, but one stays.

    A segment goes if what is left from it on is still too much, so a suffix sum decides.
    """
    order = Window.partitionBy("partition").orderBy("base")
    rest = F.sum("bytes").over(order.rowsBetween(0, Window.unboundedFollowing))
    sealed_left = F.sum(F.col("sealed").cast("int")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return segments.withColumn("deleted", F.col("sealed") & (rest > max_bytes) & (sealed_left > 1))


def delete_records(marks: DataFrame, requests: DataFrame) -> DataFrame:
    """partition, before, status, log_start after the request: below the start nothing happens, beyond the high
    watermark it is refused.  ``marks``: partition, log_start, hw; ``requests``: partition, before (-1: all)."""
    joined = requests.join(marks, "partition")
    target = F.when(F.col("before") == -1, F.col("hw")).otherwise(F.col("before"))
    status = F.when(target > F.col("hw"), "out_of_range").when(target <= F.col("log_start"), "unchanged").otherwise("moved")
    return joined.select("partition", "before", status.alias("status"), F.when(status == "moved", target).otherwise(F.col("log_start")).cast("long").alias("log_start"))


def droppable(segments: DataFrame, starts: DataFrame) -> DataFrame:
    """Whole sealed segments below the log start.  ``starts``: partition, log_start."""
    return segments.join(starts, "partition").where((F.col("last_offset") < F.col("log_start")) & F.col("sealed")).drop("log_start")


def truncate(batch_rows: DataFrame, offset: int) -> DataFrame:
    """Batches that end at or before ``offset`` (exclusive); cuts are aligned to batches."""
    return batch_rows.where(F.col("last_offset") + 1 <= offset)


def truncated_marks(marks: DataFrame, kept: DataFrame) -> DataFrame:
    """High watermark and log start after a cut: clamped to the new end."""
    ends = kept.groupBy("partition").agg((F.max("last_offset") + 1).alias("end"))
    joined = marks.join(ends, "partition", "left").withColumn("leo", F.coalesce("end", "log_start").cast("long"))
    return joined.select("partition", "leo", F.least("hw", "leo").alias("hw"), F.least("log_start", "leo").alias("log_start"))


def tier_registry(records: DataFrame) -> DataFrame:
    """Of the tier's records with one base, the one of the greatest epoch."""
    return records.groupBy("partition", "base").agg(F.max_by(F.struct("last_offset", "bytes", "key", "epoch"), "epoch").alias("r")).select("partition", "base", "r.*")


def tier_purge(registry: DataFrame, starts: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Tiered segments below the log start or too old.  ``registry`` needs max_ts."""
    return registry.join(starts, "partition").where((F.col("last_offset") < F.col("log_start")) | (F.col("max_ts") < now_ms - retention_ms)).drop("log_start")


def tier_orphans(objects: DataFrame, records: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Objects that no record names and that are older than the grace time.  ``objects``: key, mtime_ms."""
    return objects.where(F.col("mtime_ms") < now_ms - grace_ms).join(records.select("key"), "key", "left_anti").select("key")


def tier_uploads(segments: DataFrame, registered: DataFrame, epoch: int) -> DataFrame:
    """The sealed segments that the tier doesn't have yet, with their object's key: an upload writes the object, then
    its record, then lets go of the local copy.  ``registered``: partition, base."""
    name = F.concat(F.col("partition"), F.lit("/"), F.lpad(F.col("base").cast("string"), 20, "0"), F.lit("-"), F.lit(epoch))
    return segments.where("sealed").join(registered, ["partition", "base"], "left_anti").select("partition", "segment", name.alias("key"), "bytes")
