"""Access decisions, quotas and names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LITERAL, PREFIXED = 3, 4
DENY, ALLOW = 2, 3
ALL_OPERATIONS = 2


def decide(requests: DataFrame, acls: DataFrame, superusers: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """Adds ``allowed``: everything if access lists are off, everything for superusers, else a deny wins over an
    allow and the default is no.

    ``requests``: principal, resource_type, resource_name, operation.  Names match literally, by ``*`` or by prefix.
    """
    if not enabled:
        return requests.withColumn("allowed", F.lit(True))
    asked = requests.select("principal", "resource_type", "resource_name", "operation").distinct()
    # what an entry may say to fit: the name, the star or a prefix of the name; the principal or all; the operation or all
    name = F.col("resource_name")
    literal = F.transform(F.array(name, F.lit("*")), lambda n: F.struct(F.lit(LITERAL).alias("pattern_type"), n.alias("name")))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda n: F.struct(F.lit(PREFIXED).alias("pattern_type"), F.substring(name, F.lit(1), n).alias("name")))
    tried = asked.select("*", F.explode(F.array_distinct(F.concat(literal, prefixes))).alias("_n"))
    tried = tried.select("*", F.explode(F.array_distinct(F.array("principal", F.lit("User:*")))).alias("_p"))
    tried = tried.select("*", F.explode(F.array_distinct(F.array(F.col("operation").cast("int"), F.lit(ALL_OPERATIONS)))).alias("_o"))
    entries = acls.where(F.col("host") == "*").select(*[F.col(c).alias(f"a_{c}") for c in ("resource_type", "resource_name", "pattern_type", "principal", "operation", "permission")])
    same = (F.col("a_resource_type") == F.col("resource_type")) & (F.col("a_pattern_type") == F.col("_n.pattern_type")) & (F.col("a_resource_name") == F.col("_n.name")) & (F.col("a_principal") == F.col("_p")) & (F.col("a_operation") == F.col("_o"))
    sums = tried.join(entries, same).groupBy("principal", "resource_type", "resource_name", "operation").agg(F.max(F.col("a_permission") == DENY).alias("_deny"), F.max(F.col("a_permission") == ALLOW).alias("_allow"))
    met = requests.join(sums, ["principal", "resource_type", "resource_name", "operation"], "left")
    free = F.col("principal").isin(superusers or [])
    return met.select(*requests.columns, (free | (F.coalesce("_allow", F.lit(False)) & ~F.coalesce("_deny", F.lit(False)))).alias("allowed"))


def describe(acls: DataFrame, resource_type: int | None = None, resource_name: str | None = None, principal: str | None = None) -> DataFrame:
    """Entries that match a filter (None: any), grouped by resource."""
    rows = acls
    for column, value in (("resource_type", resource_type), ("resource_name", resource_name), ("principal", principal)):
        if value is not None and value != "":
            rows = rows.where(F.col(column) == value)
    return rows.groupBy("resource_type", "resource_name", "pattern_type").agg(F.count("*").alias("entries"), F.min("principal").alias("first_principal"))


def valid_topic(name):
    """Not empty, up to 249 characters, none of ``.`` and ``..``, letters, digits, dots, dashes and underscores."""
    return name.isNotNull() & F.length(name).between(1, 249) & ~name.isin(".", "..") & name.rlike("^[A-Za-z0-9._-]+$")


def bucket_delays(requests: DataFrame, rate: float, rates: dict[str, float] | None = None) -> DataFrame:
    """Token buckets per user, folded in order: a burst of two seconds' rate, one second's at the start, debt is
    allowed and answered by a delay.  ``requests``: user, seq, ts_ms, bytes."""
    own = rates or {}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        speed = own.get(key[0], rate)
        level, then, out = speed, None, []
        for r in rows.sort_values("seq").itertuples():
            if then is not None:
                level = min(2 * speed, level + speed * max(0, r.ts_ms - then) / 1000)
            then = r.ts_ms
            level -= r.bytes
            out.append((key[0], int(r.seq), max(0, round(-level / speed * 1000))))
        return pd.DataFrame(out, columns=["user", "seq", "delay_ms"])

    return requests.groupBy("user").applyInPandas(run, "user long, seq long, delay_ms long")
