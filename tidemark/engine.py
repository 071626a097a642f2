"""A log on any store that Spark can write: topics, appends, reads, offsets and retention.

Rows live in Parquet under ``log/topic=.../partition=...``, sorted by offset, so a range read prunes folders, files and
row groups.  An append is one job that writes a folder of its own; readers see folders named in the manifest, which
is appended to last - a repeated append with the same number replaces its rows and changes nothing else.

The manifest is a row of files numbered from 0.  An append that planned its offsets behind entry n may only create entry
n + 1, and creating a file that exists fails: of two writers that planned the same offsets one is refused and plans
again.  (The store must refuse to create an existing file, as HDFS and local file systems do.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.ranges import numbered
from tidemark.operators import offsets as committed
from tidemark.operators import append as appends
from tidemark.operators import scan, transactions, watermarks

ROWS = "topic string, partition long, offset long, ts_ms long, key string, value string, producer_id long, producer_epoch long, is_txn boolean, is_control boolean, control_type int, bytes long, append long"
MANIFEST = "append long, topic string, partition long, base long, records long"
COMMITS = "group string, topic string, partition long, offset long, metadata string, seq long"
STARTS = "topic string, partition long, log_start long, seq long"


class ConflictingAppend(RuntimeError):
    """Another append came first: its offsets are taken, so this one must plan again."""


class LogStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:  # nothing is written yet
            return self.spark.createDataFrame([], schema)

    def path(self, name: str):
        """(file system, path) of a name below the root."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def manifest(self) -> DataFrame:
        """What finished appends wrote: a row an append and partition."""
        store, where = self.path("manifest")
        if not store.exists(where):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest")

    def version(self) -> int:
        """The number of manifest entries."""
        store, where = self.path("manifest")
        return len(store.listStatus(where)) if store.exists(where) else 0

    def publish(self, version: int, entries: DataFrame) -> None:
        """Creates manifest entry ``version``; raises if another append has done so."""
        store, where = self.path(f"manifest/{version:020d}.json")
        try:
            out = store.create(where, False)
        except Exception as refused:
            raise ConflictingAppend(f"entry {version} exists") from refused
        try:
            for line in entries.toJSON().toLocalIterator():  # a row a partition that the append wrote to
                out.write((line + "\n").encode())
        finally:
            out.close()

    def log(self, topic: str | None = None) -> DataFrame:
        """The rows of finished appends, from each partition's log start on."""
        rows = self.table("log", ROWS)
        if topic is not None:
            rows = rows.where(F.col("topic") == topic)
        known = self.manifest().select("append", "topic", "partition").distinct()
        starts = self.starts().select("topic", "partition", "log_start")
        return rows.join(known, ["append", "topic", "partition"], "left_semi").join(starts, ["topic", "partition"], "left").where(F.col("offset") >= F.coalesce("log_start", F.lit(0))).drop("log_start", "append")

    def starts(self) -> DataFrame:
        return self.table("starts", STARTS).groupBy("topic", "partition").agg(F.max("log_start").alias("log_start"))

    def ends(self) -> DataFrame:
        return self.manifest().groupBy("topic", "partition").agg(F.max(F.col("base") + F.col("records")).alias("leo"))

    def append(self, rows: DataFrame, number: int) -> DataFrame:
        """Appends rows (topic, partition, ts_ms, key, value and a ``seq`` that orders them; producer columns are
        optional) and answers base offset and count of each partition.  ``number`` names the append: a repeat of a
        finished one changes nothing.  Rows without a topic, partition, time or place in the order are refused before
        anything is written; ``ConflictingAppend`` tells that another append came first."""
        version = self.version()
        bad = rows.where("topic IS NULL OR partition IS NULL OR partition < 0 OR ts_ms IS NULL OR seq IS NULL").limit(1)
        if not bad.isEmpty():
            raise appends.InvalidRecords("rows need a topic, a partition from 0 on, a time and a place in the order")
        done = self.manifest().where(F.col("append") == number)
        if not done.isEmpty():
            return done.select("topic", "partition", "base", "records")
        for name, default in (("producer_id", F.lit(-1).cast("long")), ("producer_epoch", F.lit(-1).cast("long")), ("is_txn", F.lit(False)), ("is_control", F.lit(False)), ("control_type", F.lit(None).cast("int"))):
            if name not in rows.columns:
                rows = rows.withColumn(name, default)
        size = F.coalesce(F.length("key"), F.lit(0)) + F.coalesce(F.length("value"), F.lit(0))
        ranked = numbered(rows, ["topic", "partition"], "seq", "_place")
        placed = ranked.join(self.ends(), ["topic", "partition"], "left").withColumn("offset", F.col("_place") + F.coalesce("leo", F.lit(0))).withColumn("bytes", size.cast("long")).withColumn("append", F.lit(number).cast("long"))
        names = [x.split()[0] for x in ROWS.split(", ")]
        path = f"{self.root}/log/append={number}"
        placed.select([n for n in names if n != "append"]).repartitionByRange("topic", "partition", "offset").sortWithinPartitions("topic", "partition", "offset").write.mode("overwrite").partitionBy("topic", "partition").parquet(path)
        written = self.spark.read.parquet(path).groupBy("topic", "partition").agg(F.min("offset").alias("base"), F.count("*").alias("records"))
        entry = written.select(F.lit(number).cast("long").alias("append"), F.col("topic").cast("string").alias("topic"), F.col("partition").cast("long").alias("partition"), F.col("base").cast("long").alias("base"), "records")
        self.publish(version, entry)
        return self.manifest().where(F.col("append") == number).select("topic", "partition", "base", "records")

    def fetch(self, topic: str, start: int | None = None, end: int | None = None, isolation: str = "read_uncommitted", partition: int | None = None) -> DataFrame:
        """Rows of ``start`` to ``end`` of a topic or of one of its partitions; without ``start`` from the log's start.

        A start below a partition's log start or beyond its high watermark raises ``OffsetOutOfRange``.
        """
        rows = self.log(topic)
        if partition is not None:
            rows = rows.where(F.col("partition") == partition)
        if start is not None:
            ends = self.ends().where(F.col("topic") == topic)
            ends = ends if partition is None else ends.where(F.col("partition") == partition)
            marks = ends.join(self.starts(), ["topic", "partition"], "left").select("partition", F.coalesce("log_start", F.lit(0)).alias("log_start"), F.col("leo").alias("hw"))
            wrong = scan.fetch_status(marks, marks.select("partition", F.lit(start).cast("long").alias("start"))).where("error <> 0").limit(1).collect()
            if wrong:
                raise scan.OffsetOutOfRange(f"offset {start} of partition {wrong[0]['partition']} of {topic}")
        marks, aborted = watermarks.watermarks(rows), transactions.aborted_ranges(rows)
        asked = scan.range_scan(rows, start or 0, end)
        return scan.read_committed(asked, marks, aborted) if isolation == "read_committed" else scan.read_uncommitted(asked, marks)

    def list_offsets(self, topic: str, timestamp: int) -> DataFrame:
        return scan.list_offsets(self.log(topic), timestamp)

    def watermarks(self, topic: str) -> DataFrame:
        return watermarks.watermarks(self.log(topic))

    def end_transaction(self, topic: str, producer_id: int, producer_epoch: int, commit: bool, ts_ms: int, number: int) -> DataFrame:
        """Writes the markers of a producer's open transaction to every partition that it wrote to."""
        key = (F.col("producer_id") == producer_id) & (F.col("producer_epoch") == producer_epoch)
        opened = watermarks.open_transactions(self.log(topic)).where(key).select("partition")
        none = F.lit(None).cast("string")
        markers = opened.select(F.lit(topic).alias("topic"), "partition", F.lit(ts_ms).cast("long").alias("ts_ms"), none.alias("key"), none.alias("value"), F.lit(0).alias("seq"), F.lit(producer_id).cast("long").alias("producer_id"), F.lit(producer_epoch).cast("long").alias("producer_epoch"), F.lit(True).alias("is_txn"), F.lit(True).alias("is_control"), F.lit(int(commit)).alias("control_type"))
        return self.append(markers, number)

    def aborted(self, topic: str) -> DataFrame:
        return transactions.aborted_ranges(self.log(topic))

    def commit(self, rows: DataFrame, seq: int) -> None:
        """Commits offsets: group, topic, partition, offset, metadata."""
        names = [x.split()[0] for x in COMMITS.split(", ")]
        rows.withColumn("seq", F.lit(seq).cast("long")).select(names).write.mode("append").parquet(f"{self.root}/commits")

    def committed(self) -> DataFrame:
        return committed.latest(self.table("commits", COMMITS))

    def lag(self) -> DataFrame:
        return committed.lag(self.committed(), self.ends().withColumnRenamed("leo", "end_offset"))

    def delete_records(self, topic: str, partition: int, before: int, seq: int) -> None:
        """Moves a partition's log start up; it never goes back."""
        self.spark.createDataFrame([(topic, partition, before, seq)], STARTS).write.mode("append").parquet(f"{self.root}/starts")
