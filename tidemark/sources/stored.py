"""Derived tables that are written once a session, sorted, so that reads prune folders, files and row groups."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: dict[tuple[str, str], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a master of one machine may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir() + "/tidemark-scratch"
    return root.rstrip("/")


def stored(spark: SparkSession, name: str, make, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The table that ``make()`` gives, written at its first use in a session: in folders ``by`` columns, in files of
    neighbouring ranges of ``order``, which their statistics tell apart."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _tables:
        df = make()
        path = f"{shared_dir(spark)}/tidemark-stored-{uuid.uuid4().hex}"
        if order:
            df = df.repartitionByRange(*(by or []), *order).sortWithinPartitions(*(by or []), *order)
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        _tables[key] = (path, df.schema)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def clear() -> None:
            try:
                store.delete(where, True)
            except Exception:  # noqa: BLE001 - the JVM may be gone by now
                pass

        atexit.register(clear)
    path, schema = _tables[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)
