"""Ranges of a numeric column, and row numbers that no single task has to count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def constants(values: list[int]) -> Column:
    """An array of whole numbers, folded to one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def marks_below(key: Column, marks: list[int]) -> Column:
    """How many of the ascending ``marks`` are not above ``key``, by halving; 0 for null."""
    if not marks:
        return F.lit(0)
    table = constants(marks)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(marks).bit_length()))])
    fits = lambda at: F.coalesce(F.get(table, at - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda s, step: F.when(fits(s + step), s + step).otherwise(s))


def numbered(rows: DataFrame, keys: list[str], order: str, name: str, ranges: int = 256) -> DataFrame:
    """``rows`` with their rank from 0 by ``order`` within ``keys``.

    Quantiles of ``order`` cut the rows into ranges; a range's first number is the sum of the counts before it, so a
    window ranks the rows of one key and range, and a key that holds all rows is spread over all ranges.
    """
    marks = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 40 * ranges).alias("q")).first()["q"] or []
    cut = rows.withColumn("_range", marks_below(F.col(order), sorted({int(m) for m in marks})))
    counts = cut.groupBy(*keys, "_range").count()
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_range").orderBy(order)
    return cut.join(starts, [*keys, "_range"]).withColumn(name, (F.row_number().over(within) - 1 + F.col("_start")).cast("long")).drop("_range", "_start")
