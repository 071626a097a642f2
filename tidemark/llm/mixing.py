"""Mixing sources to target weights by Poisson replication.

Source s with size n_s gets the rate ``target_s * total / n_s``; a document is repeated as often as the inverse of
the Poisson distribution at its own uniform number says.  That number comes from a hash of seed and id, so a run can
be repeated and no task needs another's state.  Copies are ordered by a hash of (seed, id, copy), which shuffles the
mixture globally.

Without given weights the target share of a source is proportional to the square root of its size.  Rates beyond
``LARGEST`` are drawn as a sum of independent draws.

Sizes are added up by source before anything is dealt out.  The table of sources is broadcast where it has
``BROADCAST_SOURCES`` rows at most, so documents are exchanged once, by their places; beyond that, documents meet it
by source and a salt, so a source of any share is spread over ``SALTS`` keys.

Defined results: null sources form a source of their own; null texts have size 1 like every text plus its length;
rows with a null id share the hash of the empty id; repeated rows get the same number of copies each; an empty table
stays empty; sources without a given weight get none, which drops them; texts are passed on whole, whatever their
length; columns of the input keep their names and values, whatever they are called, and a detail whose name is taken
gets an underscore behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import fresh, materialise, partitions_for, quoted, whole_row

LARGEST = 16.0
#: Terms of the distribution that are added up: beyond them lies less than 2**-52 for every rate up to LARGEST.
TERMS = 80
#: A row of the table of sources takes less than a kilobyte.
BROADCAST_SOURCES, SALTS = 4096, 64


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def distribution(rate: Column) -> Column:
    """The distribution function at 0, 1, ..., TERMS - 1."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("f"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.struct(p.alias("p"), (s["f"] + p).alias("f"), F.array_append(s["all"], s["f"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda s: s["all"])


def draws_of(rate: Column) -> Column:
    return F.greatest(F.ceil(rate / F.lit(LARGEST)).cast("int"), F.lit(1))


def copies(table: Column, draws: Column, seed: int, key: Column) -> Column:
    """The inverse of a distribution (``table``, for an equal part of the rate) at a row's numbers, summed over its
    draws: the smallest k whose function reaches the number is how many terms lie below it."""

    def below(i: Column) -> Column:
        u = uniform(F.lit(seed), key, i)
        return F.size(F.filter(table, lambda f: f < u))

    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda s, i: s + below(i))


def rates(df: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None = None) -> DataFrame:
    """source, size (characters plus one a document), rate."""
    sizes = df.groupBy(F.col(quoted(source_col)).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(quoted(text_col)), F.lit(""))) + 1).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt(F.col("size").cast("double")))
    else:
        given = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
        weighed = sizes.withColumn("weight", given)
    # one row: the totals over sources
    total = weighed.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights")).first()
    return weighed.select("source", "size", (F.col("weight") / F.lit(float(total["weights"] or 1.0)) * F.lit(float(total["total"] or 0)) / F.col("size")).alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, seed: int = 17, details: bool = False) -> DataFrame:
    """The mixture: the columns of ``df``, a row per copy, in shuffled order.  ``details`` adds rate, n_copies, copy
    and place (the number the order follows)."""
    spark = df.sparkSession
    table = materialise(rates(df, source_col, text_col, weights), "sources")
    drawn = table.withColumn("draws", draws_of(F.col("rate")))
    drawn = drawn.select("source", "rate", "draws", distribution(F.col("rate") / F.col("draws")).alias("table"))
    rows = df.select(whole_row(df), F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("own"))
    if table.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(drawn), F.col("own").eqNullSafe(F.col("source")))
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.col("id"), F.col("row")[text_col]), F.lit(SALTS)))
        dealt = drawn.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(dealt, F.col("own").eqNullSafe(F.col("source")) & (F.col("salt") == F.col("at")))
    counted = joined.select("row", "id", "rate", copies(F.col("table"), F.col("draws"), seed, F.col("id")).alias("n"))
    every = counted.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    placed = every.withColumn("place", uniform(F.lit(seed), F.col("id"), F.lit("place"), F.col("copy")))
    n = partitions_for(spark)  # places are uniform, so equal ranges need no sampling
    shuffled = placed.repartitionById(n, F.floor(F.col("place") * n).cast("int")).sortWithinPartitions("place")
    told = ["rate", "n", "copy", "place"] if details else []
    names = fresh(df.columns, "rate", "n_copies", "copy", "place")
    return shuffled.select("row.*", *[F.col(c).alias(name) for c, name in zip(told, names, strict=False)])


#: The mixture of ``documents`` by square roots, as DuckDB says it.
ORACLE = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source),
weighed AS (SELECT source, size, sqrt(size::DOUBLE) AS weight FROM sizes),
rated AS (SELECT source, weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(size) FROM weighed)::DOUBLE / size AS rate FROM weighed),
drawn AS (
  SELECT d.doc_id, d.source, r.rate, r.rate / greatest(ceil(r.rate / 16.0), 1) AS part, i.i,
         ((('0x' || substr(md5('{seed}|' || d.doc_id || '|' || i.i), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source, unnest(range(1, greatest(ceil(r.rate / 16.0), 1)::BIGINT + 1)) AS i(i)),
terms AS (
  SELECT part, k.k, sum(exp(-part + k.k * ln(part) - lgamma(k.k + 1))) OVER (PARTITION BY part ORDER BY k.k) AS f
  FROM (SELECT DISTINCT part FROM drawn), range(0, 81) AS k(k)),
counts AS (
  SELECT doc_id, source, sum(n)::INT AS n_copies FROM (
    SELECT w.doc_id, w.source, w.i, least(count(*) FILTER (t.f < w.u), 80) AS n FROM drawn w JOIN terms t USING (part) GROUP BY ALL)
  GROUP BY ALL)
SELECT doc_id, source, n_copies, c.copy::INT AS copy FROM counts, unnest(range(1, n_copies + 1)) AS c(copy)
"""
