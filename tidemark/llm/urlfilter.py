"""URL filter: exact host/path rules, then logistic regression on hashed character n-grams of host and path.

Everything here is built from DataFrame and SQL functions.  The model is one number per bucket, so each step of
the fit is a grouped sum over the labelled table and a bounded vector comes back to the driver.

Defined results: null urls and urls without ``://`` have an empty host and path; no rule fits them and the model
judges the empty text.  Repeated rows are judged each on its own, and count once in the fit; urls are read whole,
whatever their length; an empty table stays empty.  Columns of the input keep their names and values, and a result
column whose name is taken gets an underscore behind it.  With no labelled row, or labels of one class only, the model
says what its bias says (``allow`` for an empty table).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import fresh, materialise, quoted, whole_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 4096
GRAMS = (3, 4, 5)
STEPS = 12
#: The fit sees this many distinct labelled addresses at most, those with the smallest hash.
MAX_LABELLED = 4096


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: list[float]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  ``rules``: (``host/path``, verdict), a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        if not rest:
            fits = (host == own) | host.endswith("." + own)
            fits = fits & (path.startswith("/"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> Column:
    """The distinct buckets of the n-grams of ``^host``, ``path$`` joined; the marks tell ends from middles."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.hash(F.substring(text, i, F.lit(n))), F.lit(buckets)))

    return F.array_distinct(F.concat(*map(of_size, sizes)))


def margin(features: Column, model: UrlModel) -> Column:
    weights = F.split(F.lit(",".join(map(repr, map(float, model.weights)))), ",").cast("array<double>")  # folded to one constant
    return F.aggregate(features, F.lit(float(model.bias)), lambda s, i: s + F.get(weights, i))


def distinct_sample(labelled: DataFrame, most: int) -> DataFrame:
    """The ``most`` distinct addresses with the smallest hash, each with its mean label.  A rough count of distinct
    hashes tells which of them may be taken, so that copies and the rest are left behind before anything is dealt."""
    spot = F.xxhash64("host", "path")
    rows = labelled.where(F.col("label").isNotNull()).select("host", "path", F.col("label").cast("double").alias("label"))
    about = rows.agg(F.approx_count_distinct(spot)).first()[0]
    times = 4
    while True:
        top = F.lit((1 << 63) - 1) if about <= times * most else F.lit(int((1 << 64) * (times * most / about)) - (1 << 63))
        found = rows.where(spot <= top).groupBy("host", "path").agg(F.avg("label").alias("label"))
        if about <= times * most or found.count() >= most:
            return found.orderBy(spot, "host", "path").limit(most)
        times *= 4  # the rough count was too high


def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, max_labelled: int = MAX_LABELLED, ridge: float = 1.0) -> UrlModel:
    """``labelled`` has ``host``, ``path`` and ``label`` (1: block); labels of one address are averaged.  Each step
    moves every weight along its own gradient over its own curvature, damped by the number of features a row has."""
    data = materialise(distinct_sample(labelled, max_labelled).select(grams(F.col("host"), F.col("path"), buckets).alias("features"), "label"), "url-fit").coalesce(1)
    n, positive, width = data.agg(F.count("*"), F.sum("label"), F.avg(F.size("features"))).first()
    if not n:
        return UrlModel(-1.0, [0.0] * buckets)
    share = min(max(positive / n, 0.5 / n), 1 - 0.5 / n)
    bias, weights = math.log(share / (1 - share)), [0.0] * buckets
    if positive in (0, n):
        return UrlModel(bias, weights)
    for _ in range(steps):
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(F.col("features"), UrlModel(bias, weights))))
        judged = data.select("features", (F.col("label") - chance).alias("g"), (chance * (1 - chance)).alias("h"))
        sums = judged.select(F.explode("features").alias("bucket"), "g", "h").groupBy("bucket").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        for row in sums:  # one row a bucket at most
            i = row["bucket"]
            weights[i] += (row["g"] - ridge * weights[i] / width) / (row["h"] * math.sqrt(width) + ridge)
    return UrlModel(bias, weights)


def judge(df: DataFrame, rules: list[tuple[str, str]], model: UrlModel, url: str = "url") -> DataFrame:
    """Adds host, path, rule, score (the model's log odds of ``block``) and verdict."""
    address = F.col(quoted(url))
    parts = df.select(whole_row(df), host_of(address).alias("host"), path_of(address).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("row", "host", "path", rule.alias("rule"), says.alias("says"), margin(grams(F.col("host"), F.col("path"), len(model.weights)), model).alias("score"))
    judged = scored.withColumn("verdict", F.coalesce("says", F.when(F.col("score") > 0, "block").otherwise("allow")))
    told = ["host", "path", "rule", "score", "verdict"]
    return judged.select("row.*", *[F.col(c).alias(name) for c, name in zip(told, fresh(df.columns, *told), strict=True)])


def weak_labels(df: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """The labelled URL table that the rules give: every row that a rule decides."""
    parts = with_parts(df, url)
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("host", "path", (verdict == "block").cast("int").alias("label")).where("label IS NOT NULL")
