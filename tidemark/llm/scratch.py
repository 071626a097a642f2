"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it.

All tables of an application lie in one folder below ``spark.checkpoint.dir``, which goes when the driver ends.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_homes: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a master of one machine may do without; elsewhere no
    folder of this machine would do, so a missing setting is an error."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir() + "/tidemark-scratch"
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def home(spark: SparkSession) -> str:
    """This application's folder; it is deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if path not in _homes:
        _homes.add(path)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def clear() -> None:
            try:
                store.delete(where, True)
            except Exception:  # noqa: BLE001 - the JVM may be gone by now
                pass

        atexit.register(clear)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{home(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads, and let Spark drop the shuffle files of finished jobs: it does
    so once the driver's collector has found their plans unused, hence the collections."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            delete(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``keys``: the hashes alone are ranked first, so that tasks send only
    rows that are taken."""
    spot = F.xxhash64(*keys)
    cut = df.select(spot.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.where(spot <= (cut if cut is not None else 0)).orderBy(spot, *keys).limit(n)


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it is made of."""
    return "`" + name.replace("`", "``") + "`"


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores behind it until no column of ``taken`` is called so (in any case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def whole_row(df: DataFrame, name: str = "row"):
    """All columns of ``df`` as one struct, so that no internal column can clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name)
