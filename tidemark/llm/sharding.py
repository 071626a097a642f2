"""Reproducible global shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Everything here is built from DataFrame and SQL functions.

A row's number is its rank by ``order`` columns.  Ranks come from a list of quantile boundaries of the first column,
one grouped count and a window inside each range, so no task sees more than its range.  A boundary's value is a range
of its own; where rows share that value (or null) beyond a range's share, it is cut by a hash of the other columns,
and rows are ranked by that hash before those columns.  Boundaries and hashes depend on values alone, never on the
partitioning of a run, so a recomputed task finds the same numbers.

The permutation works on ``Z_a x Z_b``, where ``a`` is the size near the square root of ``n`` that leaves the fewest
surplus places (``a * b - n``): each round adds a mix of one half to the other, which is a bijection.  A position that
falls on a surplus place walks on along its cycle until it is below ``n``.  A walk meets no surplus place twice, so as
many steps as there are surplus places always end it.

Defined results: an empty table stays empty; null keys are ranked first; repeated rows each get a place of their own;
null texts and texts of any length are columns like others; columns of the input keep their names and values, and a
result column whose name is taken gets an underscore behind it.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.scratch import fresh, quoted, whole_row

PRIME = 2147483647
KEYS = (1013904223, 1664525, 22695477, 1103515245, 134775813, 214013)
#: Sizes of the first half that are tried.
SEARCH = 1 << 16
#: Ranges at least, and rows that a range has about beyond that.
RANGES, RANGE_ROWS = 512, 1_000_000


def constants(values: list[int]) -> Column:
    """An array of whole numbers, folded to one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def halves(n: int) -> tuple[int, int]:
    first = max(1, math.isqrt(max(n - 1, 0)) + 1)
    a = min(range(first, first + min(SEARCH, first // 4 + 1)), key=lambda a: (-n % a, a))
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int) -> Column:
    """One application of the permutation of ``[0, a * b)``."""
    a, b = halves(n)
    state = F.struct((x % F.lit(a)).alias("l"), ((x - x % F.lit(a)) / F.lit(a)).cast("long").alias("r"))
    steps = [F.struct(F.lit(bool(i % 2)).alias("odd"), F.lit(KEYS[i] + seed).cast("long").alias("k")) for i in range(len(KEYS))]

    def round_(s: Column, step: Column) -> Column:
        def stir(v: Column) -> Column:
            first = ((v + step["k"]) * F.lit(48271)) % F.lit(PRIME)
            folded = first.bitwiseXOR(F.shiftright(first, 15))
            return ((folded + step["k"]) * F.lit(69621)) % F.lit(PRIME)

        return F.when(step["odd"], F.struct(s["l"].alias("l"), ((s["r"] + stir(s["l"])) % F.lit(b)).alias("r"))).otherwise(F.struct(((s["l"] + stir(s["r"])) % F.lit(a)).alias("l"), s["r"].alias("r")))

    return F.aggregate(F.array(*steps), state, round_, lambda s: s["r"] * F.lit(a) + s["l"])


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``x`` among ``n``; a bijection of ``[0, n)``."""
    a, b = halves(n)
    first = feistel(x, n, seed)
    if a * b == n:
        return first
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    walked = lambda p: F.aggregate(steps, p, lambda q, _: F.when(q < F.lit(n), q).otherwise(feistel(q, n, seed)))
    return F.get(F.transform(F.array(first), lambda p: F.when(p < F.lit(n), p).otherwise(walked(p))), F.lit(0))


def marks_below(key: Column, marks: list[int]) -> Column:
    """How many of the ascending ``marks`` are not above ``key``, by halving."""
    table = constants(marks)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(marks).bit_length()))])
    fits = lambda at: F.coalesce(F.get(table, at - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda s, step: F.when(fits(s + step), s + step).otherwise(s))


def cells_of(rows: DataFrame, key: Column, rest: list[Column], ranges: int, total: int) -> tuple[Column, list[int]]:
    """(the cell of a row, the rows of each cell): cells ascend by ``key``, nulls first.  A value that holds more than
    a range's share of the ``total`` is cut by a hash of the columns ``rest``."""
    marks = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 10 * ranges)).alias("q")).first()["q"] or []
    marks = sorted(set(marks))
    # 0: null; 2 i + 1: between marks; 2 i: mark number i itself
    below = marks_below(key, marks) if marks else F.lit(0)
    equal = F.coalesce(F.get(constants(marks), below - 1) == key, F.lit(False)) if marks else F.lit(False)
    band = F.when(key.isNull(), 0).otherwise(F.when(equal, 2 * below).otherwise(2 * below + 1)).cast("int")
    sizes = {r["band"]: r["count"] for r in rows.groupBy(band.alias("band")).count().collect()}  # two for each mark
    share = max(1, -(-total // ranges))
    cuts = [max(1, -(-sizes.get(b, 0) // (2 * share))) if b % 2 == 0 and rest else 1 for b in range(2 * len(marks) + 2)]
    if max(cuts) == 1:
        return band, [sizes.get(b, 0) for b in range(len(cuts))]
    first, at = [], 0
    for n in cuts:
        first.append(at)
        at += n
    cell = (F.get(constants(first), band) + F.pmod(F.xxhash64(*rest), F.get(constants(cuts), band))).cast("int")
    found = {r["cell"]: r["count"] for r in rows.groupBy(cell.alias("cell")).count().collect()}
    return cell, [found.get(c, 0) for c in range(at)]


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with the rank of each row by ``order`` (nulls first), from 0, and the number of rows.

    The first column must be integral; the remaining ones should tell its repeated values apart.  Rows equal in every
    column of ``order`` are interchangeable.
    """
    key, rest = F.col("row")[order[0]], [F.col("row")[c] for c in order[1:]]
    rows = df.select(whole_row(df))
    total = df.count()
    cell, counts = cells_of(rows, key, rest, max(RANGES, -(-total // RANGE_ROWS)), total)
    starts = [0, *accumulate(counts)]
    within = Window.partitionBy("cell").orderBy(key.asc_nulls_first(), *[c.asc_nulls_first() for c in rest])
    number = (F.row_number().over(within) - 1).cast("long") + F.get(constants(starts), F.col("cell"))
    numbered = rows.withColumn("cell", cell).select("row", number.alias("number"))
    return numbered.select("row.*", F.col("number").alias(fresh(df.columns, name)[0])), total


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Adds ``shard`` and ``slot``: place ``p`` of the permutation goes to shard ``p % shards``, slot ``p // shards``.

    Counts differ by one row at most and slots run from 0 without gaps.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    numbered, n = row_numbers(df, order)
    number = F.col(quoted(numbered.columns[-1]))
    placed = numbered.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), permuted(number, max(n, 1), seed).alias("place"))
    shard, slot = fresh(df.columns, "shard", "slot")
    return placed.select("row.*", (F.col("place") % F.lit(shards)).cast("int").alias(shard), ((F.col("place") - F.col("place") % F.lit(shards)) / F.lit(shards)).cast("long").alias(slot))
