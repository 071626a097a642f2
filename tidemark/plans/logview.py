"""The canonical log: batches, transactions and markers derived from the ``events`` table, in Spark and in DuckDB SQL.

Four partitions; batches of ten rows; transaction windows of six batches; three producers of which the third writes
outside transactions; a marker row per closed transaction behind its window's data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ranges import numbered
from tidemark.operators import transactions, watermarks
from tidemark.sources.stored import stored

PARTITIONS, BATCH_ROWS, WINDOW_BATCHES, PRODUCERS = 4, 10, 6, 3
PLAIN_PRODUCER = 1002
WINDOW_ROWS, MARKERS = BATCH_ROWS * WINDOW_BATCHES, PRODUCERS - 1


def div(a, n: int):
    return ((a - F.pmod(a, F.lit(n))) / F.lit(n)).cast("long")


def log_view(events: DataFrame) -> DataFrame:
    """partition, offset, n, batch, win, producer_id, producer_epoch, is_txn, is_control, control_type, is_open,
    ts_ms, key, value, bytes.

    A closed window has all its rows, so all its producers: offsets follow from a row's number, and a window's last
    row brings its markers.
    """
    rows = events.select(
        F.col("event_id"),
        F.pmod("user_id", F.lit(PARTITIONS)).alias("partition"),
        F.col("event_type").alias("key"),
        F.col("props").alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )
    rows = numbered(rows, ["partition"], "event_id", "n").drop("event_id")
    rows = rows.withColumn("batch", div(F.col("n"), BATCH_ROWS)).withColumn("win", div(F.col("batch"), WINDOW_BATCHES))
    last = rows.groupBy("partition").agg(F.max("win").alias("last_win"))
    rows = rows.join(last, "partition").withColumn("is_open", F.col("win") == F.col("last_win")).drop("last_win")
    offset = F.col("n") + MARKERS * F.col("win")
    data = rows.select(
        "partition", offset.alias("offset"), "n", "batch", "win", (F.lit(1000) + F.pmod("batch", F.lit(PRODUCERS))).alias("producer_id"), F.lit(False).alias("is_control"), F.lit(None).cast("int").alias("control_type"),
        "is_open", "ts_ms", "key", "value", (F.length("key") + F.length("value")).cast("long").alias("bytes"),
    )
    ends = rows.where(~F.col("is_open") & (F.pmod("n", F.lit(WINDOW_ROWS)) == WINDOW_ROWS - 1))
    ends = ends.withColumn("producer_id", F.explode(F.sequence(F.lit(1000).cast("long"), F.lit(1000 + MARKERS - 1).cast("long"))))
    none = F.lit(None).cast("string")
    kind = F.when((F.col("partition") + F.col("win") + F.col("producer_id")) % 4 == 0, 0).otherwise(1)
    control = ends.select(
        "partition", (offset + 1 + F.col("producer_id") - 1000).alias("offset"), "n", F.lit(None).cast("long").alias("batch"), "win", "producer_id", F.lit(True).alias("is_control"), kind.alias("control_type"),
        "is_open", "ts_ms", none.alias("key"), none.alias("value"), F.lit(0).cast("long").alias("bytes"),
    )
    log = data.unionByName(control)
    return log.select(
        "partition", "offset", "n", "batch", "win", "producer_id", F.col("win").alias("producer_epoch"),
        (F.col("producer_id") != PLAIN_PRODUCER).alias("is_txn"), "is_control", "control_type", "is_open", "ts_ms", "key", "value", "bytes",
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it is stored: folders by partition, files by ranges of offsets."""
    return stored(spark, f"log {sf_dir}", lambda: log_view(spark.read.parquet(f"{sf_dir}/events.parquet")), ["partition"], ["offset"])


def kept_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's watermarks as a store keeps them beside it, a row a partition."""
    return stored(spark, f"marks {sf_dir}", lambda: watermarks.watermarks(load(spark, sf_dir)))


def kept_aborts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's aborted ranges as a store keeps them beside it."""
    return stored(spark, f"aborts {sf_dir}", lambda: transactions.aborted_ranges(load(spark, sf_dir)))


#: The same view for DuckDB: put in front of a query that reads ``log``.
LOG_SQL = """
ev AS (SELECT event_id, user_id % 4 AS "partition", event_type AS key, props AS value, epoch_us(ts) // 1000 AS ts_ms,
       row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS n FROM events),
dt AS (SELECT *, n // 10 AS batch, (n // 10) // 6 AS win, 1000 + (n // 10) % 3 AS producer_id FROM ev),
lw AS (SELECT "partition", max(win) AS last_win FROM dt GROUP BY ALL),
rw AS (SELECT dt.*, win = last_win AS is_open FROM dt JOIN lw USING ("partition")),
en AS (SELECT "partition", win, max(n) AS n, max(ts_ms) AS ts_ms FROM rw WHERE NOT is_open GROUP BY ALL),
mk AS (SELECT w."partition", e.n, w.win, w.producer_id, e.ts_ms,
       CASE WHEN (w."partition" + w.win + w.producer_id) % 4 = 0 THEN 0 ELSE 1 END AS control_type
       FROM (SELECT DISTINCT "partition", win, producer_id FROM rw WHERE NOT is_open AND producer_id <> 1002) w JOIN en e USING ("partition", win)),
un AS (SELECT "partition", n, batch, win, producer_id, ts_ms, key, value, is_open, false AS is_control, NULL::INT AS control_type FROM rw
       UNION ALL SELECT "partition", n, NULL, win, producer_id, ts_ms, NULL, NULL, false, true, control_type FROM mk),
log AS (SELECT *, win AS producer_epoch, producer_id <> 1002 AS is_txn,
        row_number() OVER (PARTITION BY "partition" ORDER BY win, is_control, n, producer_id) - 1 AS "offset",
        CASE WHEN is_control THEN 0 ELSE length(key) + length(value) END::BIGINT AS bytes FROM un)
"""
