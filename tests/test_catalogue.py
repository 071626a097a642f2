"""Every catalogue query against its SQL, value by value."""

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, oracle, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    said = oracle.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(said.columns)
    at = [said.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in said.fetchall()), key=key)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("inv_")])
def test_invariants_hold(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_folds_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_fetch_reads_a_range_of_files(spark, sf_dir):
    """The stored log takes offsets and partitions to the files."""
    from tidemark.plans.logview import load

    plan = load(spark, sf_dir).where("partition = 2 AND offset >= 100 AND offset < 120")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(offset,100)" in plan and "PartitionFilters: [isnotnull(partition" in plan


def test_invariants_tell_broken_logs(spark, sf_dir):
    from pyspark.sql import functions as F
    from tidemark.operators import scan, transactions, watermarks
    from tidemark.plans.logview import load

    log = load(spark, sf_dir)
    marks = watermarks.watermarks(log).withColumn("lso", F.col("hw") + 1)
    assert marks.where("lso > hw OR hw > leo").count() == 4
    bad = transactions.aborted_ranges(log)
    shown = scan.read_committed(log, aborted=bad.limit(0))  # a reader that forgot the aborted ranges
    assert shown.join(bad, ["partition", "producer_id", "producer_epoch"]).count() > 0
    twice = log.unionAll(log.where("is_control")).where("is_control").groupBy("partition", "producer_id", "producer_epoch").count()
    assert twice.where("count > 1").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
