"""Progress marks of a partition: end of log, high watermark, last stable offset, log start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def open_transactions(log: DataFrame) -> DataFrame:
    """(partition, producer_id, producer_epoch, first_offset) of transactions without a marker."""
    done = log.where("is_control").select("partition", "producer_id", "producer_epoch").distinct()
    data = log.where("is_txn AND NOT is_control")
    return data.join(done, ["partition", "producer_id", "producer_epoch"], "left_anti").groupBy("partition", "producer_id", "producer_epoch").agg(F.min("offset").alias("first_offset"))


def watermarks(log: DataFrame, log_start: int = 0) -> DataFrame:
    """partition, log_start, leo, hw, lso, one grouped pass and the open transactions' minimum."""
    ends = log.groupBy("partition").agg((F.max("offset") + 1).alias("leo"))
    first = open_transactions(log).groupBy("partition").agg(F.min("first_offset").alias("first_open"))
    lso = F.greatest(F.lit(log_start), F.least("leo", F.coalesce("first_open", "leo")))
    return ends.join(first, "partition", "left").select("partition", F.lit(log_start).cast("long").alias("log_start"), "leo", F.col("leo").alias("hw"), lso.cast("long").alias("lso"))


def replicated_hw(replicas: DataFrame) -> DataFrame:
    """High watermark per partition from replica ends: ``max(hw, min(leo, min leo of in-sync followers))``.

    ``replicas``: partition, leo (the leader's), hw, follower_leo, in_sync.  Without in-sync followers it stays.
    """
    least = F.min(F.when(F.col("in_sync"), F.col("follower_leo")))
    sums = replicas.groupBy("partition").agg(F.max("leo").alias("leo"), F.max("hw").alias("old_hw"), least.alias("isr_leo"))
    return sums.select("partition", "leo", F.when(F.col("isr_leo").isNull(), F.col("old_hw")).otherwise(F.greatest("old_hw", F.least("leo", "isr_leo"))).alias("hw"))


def in_sync(replicas: DataFrame, lag_ms: int) -> DataFrame:
    """A member leaves after ``lag_ms`` of silence and comes back only at the leader's end.

    ``replicas``: partition, replica, leo, follower_leo, silent_ms, was_in_sync.
    """
    stays = F.col("was_in_sync") & (F.col("silent_ms") <= lag_ms)
    returns = ~F.col("was_in_sync") & (F.col("follower_leo") >= F.col("leo"))
    return replicas.withColumn("in_sync", stays | returns)


def acks_all(partitions: DataFrame) -> DataFrame:
    """Whether an all-replica write may be taken: ``1 + |ISR| >= max(min_insync, replicas div 2 + 1)``."""
    majority = F.floor(F.col("replicas") / 2) + 1
    return partitions.withColumn("accepted", (F.col("isr_followers") + 1) >= F.greatest(F.col("min_insync").cast("long"), majority))


def epoch_end_offsets(epochs: DataFrame, requests: DataFrame, ends: DataFrame) -> DataFrame:
    """For each requested leader epoch the greatest epoch not above it and where that one ends (exclusive).

    ``epochs``: partition, epoch, start; ``requests``: partition, requested; ``ends``: partition, leo.
    """
    spans = epochs.withColumn("next_start", F.lead("start").over(Window.partitionBy("partition").orderBy("epoch")))
    spans = spans.join(ends, "partition").select("partition", "epoch", F.coalesce("next_start", "leo").alias("end_offset"))
    # an as-of look-up: requests stand behind the epochs up to them, in one order
    both = spans.select("partition", F.col("epoch").alias("at"), F.struct("epoch", "end_offset").alias("span"), F.lit(False).alias("asks")).unionByName(requests.select("partition", F.col("requested").alias("at"), F.lit(None).cast("struct<epoch: bigint, end_offset: bigint>").alias("span"), F.lit(True).alias("asks")))
    order = Window.partitionBy("partition").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("span", F.last("span", ignorenulls=True).over(order)).where("asks")
    return met.select("partition", F.col("at").alias("requested"), F.coalesce("span.epoch", F.lit(-1)).cast("long").alias("epoch"), F.coalesce("span.end_offset", F.lit(-1)).cast("long").alias("end_offset"))


def trimmed_epochs(epochs: DataFrame, most: int = 1000, drop: int = 500) -> DataFrame:
    """The epoch history as it is kept: whenever it grows beyond ``most`` entries, the oldest ``drop`` go.  After n
    entries that has happened once for every ``drop`` begun beyond ``most``.  ``epochs``: partition, epoch, start."""
    own = Window.partitionBy("partition")
    n = F.count("*").over(own)
    gone = F.when(n > most, drop * (F.floor((n - most - 1) / drop) + 1)).otherwise(0)
    return epochs.withColumn("_gone", gone).withColumn("_place", F.row_number().over(own.orderBy("epoch"))).where("_place > _gone").drop("_gone", "_place")
