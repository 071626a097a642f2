"""Committed offsets: latest by key, look-up with defaults, lag, and what a commit request answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["group", "topic", "partition"]


def latest(commits: DataFrame) -> DataFrame:
    """The last commit (by ``seq``) of each group and partition; partial maxima meet, so hot groups do not."""
    return commits.groupBy(*KEY).agg(F.max_by(F.struct("offset", "metadata"), "seq").alias("c")).select(*KEY, "c.offset", "c.metadata")


def fetch(committed: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Offsets of the wanted (group, topic, partition), -1 where none is committed; all commits if none are named."""
    if wanted is None:
        return committed.select(*KEY, "offset")
    return wanted.join(committed.select(*KEY, "offset"), KEY, "left").select(*KEY, F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"))


def lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """end - committed where both are known, else -1.  ``ends``: topic, partition, end_offset."""
    joined = committed.join(ends, ["topic", "partition"], "left")
    known = (F.col("offset") >= 0) & (F.coalesce("end_offset", F.lit(-1)) >= 0)
    return joined.select(*KEY, "offset", F.coalesce("end_offset", F.lit(-1)).cast("long").alias("end_offset"), F.when(known, F.col("end_offset") - F.col("offset")).otherwise(-1).cast("long").alias("lag"))


def total_lag(lags: DataFrame) -> DataFrame:
    """Positive lags only, per group."""
    return lags.groupBy("group").agg(F.sum(F.when(F.col("lag") > 0, F.col("lag")).otherwise(0)).alias("total_lag"))


def judged_commits(requests: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Adds ``status``: unknown_member, illegal_generation (a stable group of another generation) or ok.

    ``requests``: group, member, generation, ...; ``groups``: group, state, current_generation; ``members``: group, member.
    """
    known = members.select("group", "member", F.lit(True).alias("_known"))
    joined = requests.join(groups, "group", "left").join(known, ["group", "member"], "left")
    status = F.when(F.col("_known").isNull(), "unknown_member").when((F.col("state") == "Stable") & (F.col("generation") != F.col("current_generation")), "illegal_generation").otherwise("ok")
    return joined.withColumn("status", status).drop("_known", "state", "current_generation")
