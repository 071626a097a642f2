"""The cluster's metadata log folded to its image, and the pure choices a controller makes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def placement(topics: DataFrame, brokers: list[int]) -> DataFrame:
    """Replicas of each partition: cyclic from the partition's index over the brokers, no more than there are."""
    nodes = F.array(*[F.lit(b) for b in sorted(brokers)])
    rows = topics.where("partitions > 0").withColumn("partition", F.explode(F.sequence(F.lit(0), F.col("partitions").cast("int") - 1)))
    width = F.greatest(F.lit(1), F.least(F.col("rf").cast("int"), F.lit(len(brokers))))
    return rows.select("topic", F.col("partition").cast("long").alias("partition"), F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get(nodes, (F.col("partition") + i) % len(brokers))).alias("replicas"))


def image(records: DataFrame) -> DataFrame:
    """Topics that exist after the metadata log, with their partition leaders (last change wins, creation resets).

    ``records``: version, kind, topic, partitions, rf, partition, leader, epoch.
    """
    topic = records.where(F.col("kind").isin("CreateTopic", "DeleteTopic"))
    # a creation counts only if the topic does not exist then: the first one after the last deletion
    deleted = topic.groupBy("topic").agg(F.max(F.when(F.col("kind") == "DeleteTopic", F.col("version"))).alias("_deleted"))
    made = topic.where("kind = 'CreateTopic'").join(deleted, "topic").where("_deleted IS NULL OR version > _deleted")
    alive = made.groupBy("topic").agg(F.min("version").alias("created"), F.min_by("partitions", "version").alias("partitions"), F.min_by("rf", "version").alias("rf"))
    parts = alive.withColumn("partition", F.explode(F.sequence(F.lit(0), F.col("partitions").cast("int") - 1)))
    moves = records.where("kind = 'LeaderChange'").select("topic", "partition", F.col("version").alias("v"), "leader", "epoch")
    changed = parts.select("topic", "partition", "created").join(moves, ["topic", "partition"]).where("v > created").groupBy("topic", "partition").agg(F.max_by(F.struct("leader", "epoch"), "v").alias("m"))
    return parts.join(changed, ["topic", "partition"], "left").select("topic", F.col("partition").cast("long").alias("partition"), "rf", "created", "m.leader", "m.epoch")


def failover(partitions: DataFrame, alive: list[int]) -> DataFrame:
    """For partitions whose leader is gone the first live replica, one epoch on; -1 if there is none."""
    live = F.array(*[F.lit(b) for b in alive]) if alive else F.array().cast("array<int>")
    left = F.filter("replicas", lambda r: F.array_contains(live, r) & (r != F.col("leader")))
    lost = partitions.where(~F.array_contains(live, F.col("leader"))).withColumn("_next", F.get(left, F.lit(0)))
    return lost.select("topic", "partition", F.coalesce("_next", F.lit(-1)).cast("int").alias("leader"), F.when(F.col("_next").isNotNull(), F.col("epoch") + 1).otherwise(F.col("epoch")).alias("epoch"))


def transfer(requests: DataFrame, partitions: DataFrame, alive: list[int]) -> DataFrame:
    """Whether a leader may move: to a live replica that does not lead yet.  ``requests``: topic, partition, target."""
    joined = requests.join(partitions, ["topic", "partition"], "left")
    status = F.when(F.col("leader").isNull(), "unknown_partition").when(~F.array_contains("replicas", F.col("target")), "not_a_replica").when(F.col("target") == F.col("leader"), "already_leader")
    status = status.when(~F.col("target").isin(alive), "not_alive").otherwise("moved")
    return joined.select("topic", "partition", "target", status.alias("status"), F.when(status == "moved", F.col("epoch") + 1).otherwise(F.col("epoch")).alias("epoch"))


def creatable(requests: DataFrame, topics: DataFrame, brokers: int) -> DataFrame:
    """What a topic creation answers: exists (a repeat does nothing), too_few_brokers or created."""
    there = topics.select("topic", F.lit(True).alias("_there"))
    joined = requests.join(there, "topic", "left")
    return joined.withColumn("status", F.when(F.col("_there"), "exists").when((F.col("rf") > 1) & (F.col("rf") > brokers), "too_few_brokers").otherwise("created")).drop("_there")


def longest_replica(replicas: DataFrame) -> DataFrame:
    """The replica whose log ends last (the smallest id among equals): where a new leader catches up."""
    first = Window.partitionBy("partition").orderBy(F.desc("follower_leo"), "replica")
    return replicas.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("partition", "replica", "follower_leo")


def look_up(requested: DataFrame | None, topics: DataFrame) -> DataFrame:
    """Requested names against the catalogue; unknown names come back with error 3, no request means all."""
    if requested is None:
        return topics.select("topic", "partitions", F.lit(0).alias("error"))
    return requested.join(topics, "topic", "left").select("topic", F.coalesce("partitions", F.lit(0)).alias("partitions"), F.when(F.col("partitions").isNull(), 3).otherwise(0).alias("error"))


def routes(requests: DataFrame, partitions: DataFrame) -> DataFrame:
    """Requests by topic name or id sent to their partition's leader; -1 where there is none."""
    by = partitions.select(F.col("topic").alias("r_topic"), F.col("topic_id").alias("r_id"), F.col("partition").alias("r_partition"), "leader")

    def found(rows: DataFrame, own: str, other: str) -> DataFrame:
        same = (F.col(own) == F.col(other)) & (F.col("partition") == F.col("r_partition"))
        return rows.join(by, same, "left").select(*requests.columns, F.coalesce("leader", F.lit(-1)).alias("leader"))

    return found(requests.where("topic IS NOT NULL"), "topic", "r_topic").unionAll(found(requests.where("topic IS NULL"), "topic_id", "r_id"))


def in_request_order(done: DataFrame) -> DataFrame:
    """When each response leaves: not before those of all earlier requests of its connection.  ``done``: connection,
    seq, done_ms."""
    order = Window.partitionBy("connection").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return done.select("connection", "seq", F.max("done_ms").over(order).alias("sent_ms"))


def fields_of_versions(fields: DataFrame, low: int, high: int) -> DataFrame:
    """The fields that each protocol version from ``low`` to ``high`` has in its body: those of its range that are not
    tagged.  ``fields``: field, first_version, last_version, tagged."""
    first, last = F.greatest("first_version", F.lit(low).cast("long")), F.least("last_version", F.lit(high).cast("long"))
    return fields.where(~F.col("tagged") & (first <= last)).select("field", F.explode(F.sequence(first, last)).alias("version"))


def marker_routes(transactions: DataFrame, leaders: DataFrame, node: int) -> DataFrame:
    """Where each partition's marker goes: to a local log or to its leader's node.  ``leaders``: partition, leader."""
    joined = transactions.join(leaders, "partition", "left")
    return joined.withColumn("route", F.when(F.col("leader").isNull(), "unknown").when(F.col("leader") == node, "local").otherwise("remote"))
