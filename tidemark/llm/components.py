"""Connected components of an edge table by alternating large-star and small-star steps.

Steps go on until the edges no longer change, which is when every node points at the smallest one of its component;
their number grows with the logarithm of the longest path, and nothing bounds it beforehand.

Defined results: an edge from a node to itself names no component; repeated edges and both directions count once;
an edge with a null end is left out; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise, release


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (v, m).  Large: every node hands its larger neighbours to the smallest; small: its
    smaller ones and itself."""
    if large:
        pairs = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
    else:
        pairs = edges.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("w"))
    least = pairs.groupBy("u").agg(F.min("w").alias("low")).select("u", F.least("u", "low").alias("low"))
    moved = pairs.join(least, "u").where(F.col("w") > F.col("u")) if large else pairs.join(least, "u").unionAll(least.select("u", F.col("u").alias("w"), "low"))
    return moved.select(F.col("w").alias("v"), F.col("low").alias("m")).where("v <> m").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node."""
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = materialise(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    before = None
    while True:
        told = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
        if told == before or not told[0]:
            break
        before = told
        last, now = now, materialise(star(star(now, True), False), "edges")
        release(now.sparkSession, last)
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionAll(now.select(F.col("m").alias("node"), F.col("m").alias("component"))).distinct()
