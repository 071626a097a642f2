import pytest
from pyspark.sql import functions as F

from tidemark.engine import ConflictingAppend, LogStore
from tidemark.functions.ranges import numbered
from tidemark.operators import append, coordinator, scan, watermarks
from tidemark.sources import recordbatch as rb


def rows(spark, n, topic="t", **more):
    df = spark.range(n).select(F.lit(topic).alias("topic"), (F.col("id") % 2).alias("partition"), (F.col("id") * 10).alias("ts_ms"), F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.format_string("msg-%05d", F.col("id")).alias("value"), F.col("id").alias("seq"))
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_round_trip(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/log1")
    assert store.log().count() == 0 and store.fetch("t").count() == 0
    assert sorted(tuple(r) for r in store.append(rows(spark, 100), 1).collect()) == [("t", 0, 0, 50), ("t", 1, 0, 50)]
    again = store.append(rows(spark, 100), 1)
    assert again.count() == 2 and store.log().count() == 100  # a repeated append changes nothing
    store.append(rows(spark, 20, topic="u"), 2)
    assert [r.base for r in store.append(rows(spark, 10), 3).orderBy("partition").collect()] == [50, 50]
    got = store.fetch("t").collect()
    assert len(got) == 110 and len({(r.partition, r.offset) for r in got}) == 110
    assert store.fetch("t", 10, 12).count() == 4
    assert {r.offset for r in store.list_offsets("t", 500).collect()} == {25}
    assert store.fetch("t", 55, partition=0).count() == 0 and store.fetch("t", 54, partition=1).count() == 1
    for start in (56, 10_000):
        with pytest.raises(scan.OffsetOutOfRange):
            store.fetch("t", start)
    with pytest.raises(append.InvalidRecords):
        store.append(rows(spark, 4).withColumn("ts_ms", F.lit(None).cast("long")), 9)
    assert store.log("t").count() == 110
    plan = store.fetch("t", 10, 12)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(offset,10)" in plan and "LessThan(offset,12)" in plan  # pushed to the files


def test_of_two_appends_one_is_refused(spark, tmp_path, monkeypatch):
    one, two = (LogStore(spark, f"file://{tmp_path}/log9") for _ in range(2))
    one.append(rows(spark, 10), 1)
    planned = two.version()
    one.append(rows(spark, 6), 2)
    monkeypatch.setattr(two, "version", lambda: planned)  # it looked before the other append
    with pytest.raises(ConflictingAppend):
        two.append(rows(spark, 8), 3)
    assert one.log().count() == 16  # what was refused is not seen
    monkeypatch.undo()
    assert sorted(r.base for r in two.append(rows(spark, 8), 3).collect()) == [8, 8] and one.log().count() == 24


def test_numbers_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    got = numbered(df, ["k"], "o", "n", 16).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.o):
        assert r.n == by.get(r.k, 0)
        by[r.k] = r.n + 1
    assert len(got) == 5000 and numbered(df.limit(0), ["k"], "o", "n").count() == 0


def test_subscription_refuses_a_bad_pattern(spark):
    topics = spark.createDataFrame([("a",), ("ab",)], "topic string")
    assert {r.topic for r in scan.subscribed(topics, [], "a.").collect()} == {"ab"}
    with pytest.raises(scan.InvalidRequest):
        scan.subscribed(topics, [], "a(")


def test_epoch_history_is_trimmed_as_it_grows(spark):
    for n in (3, 10, 11, 15, 16, 21, 47):
        kept = []
        for epoch in range(n):
            kept.append(epoch)
            if len(kept) > 10:
                kept = kept[5:]
        df = spark.range(n).select(F.lit(0).alias("partition"), F.col("id").alias("epoch"), F.col("id").alias("start"))
        assert sorted(r.epoch for r in watermarks.trimmed_epochs(df, 10, 5).collect()) == kept


def test_transactions_and_offsets(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/log2")
    store.append(rows(spark, 30), 1)
    store.append(rows(spark, 10, producer_id=7, producer_epoch=0, is_txn=True), 2)
    store.append(rows(spark, 10, producer_id=8, producer_epoch=0, is_txn=True), 3)
    assert store.fetch("t", isolation="read_committed").count() == 30
    store.end_transaction("t", 7, 0, False, 1, 4)
    assert store.fetch("t", isolation="read_committed").count() == 30
    store.end_transaction("t", 8, 0, True, 1, 5)
    assert store.fetch("t", isolation="read_committed").count() == 40 and store.fetch("t").count() == 50
    assert store.aborted("t").count() == 2
    commits = spark.createDataFrame([("g", "t", 0, 5, "")], "group string, topic string, partition long, offset long, metadata string")
    store.commit(commits, 1)
    store.commit(commits.withColumn("offset", F.lit(9).cast("long")), 2)
    assert [(r.offset, r.lag) for r in store.lag().collect()] == [(9, 27 - 9)]
    store.delete_records("t", 0, 20, 1)
    assert store.fetch("t").where("partition = 0").agg(F.min("offset")).first()[0] == 20


def test_segments_are_pruned(spark, tmp_path):
    for base in (0, 10, 20, 30):
        records = [rb.Record(i, i, b"k", b"v") for i in range(10)]
        (tmp_path / f"{base:020d}.log").write_bytes(rb.encode_batch(records, base))
    assert [f[-6:-4] for f in rb.segment_files(spark, str(tmp_path), 12, 21)] == ["10", "20"]
    assert sorted(r.offset for r in rb.read_range(spark, str(tmp_path), 12, 21).select("offset").collect()) == list(range(12, 21))
    assert rb.read_range(spark, str(tmp_path), 35).count() == 5


def test_coordinator(spark):
    names = "txn_id string, seq long, command string, pid long, epoch long, topic string, partition long, offset long, commit boolean"
    steps = [("add_partition", 0, None), ("init", 0, None), ("add_partition", 0, None), ("commit_offset", 0, None), ("end", 0, True), ("end", 0, True), ("end", 0, False), ("add_partition", 0, None), ("init", 0, None), ("end", 0, True), ("end", 2, True), ("commit_offset", 1, None)]
    df = spark.createDataFrame([("x", i, c, 1, e, "t", 3, 40 + i, ok) for i, (c, e, ok) in enumerate(steps)], names)
    got = coordinator.coordinate(df).orderBy("seq").collect()
    assert [r.status for r in got] == ["unknown_id", "ok", "ok", "ok", "ok", "ok", "invalid_state", "ok", "ok", "fenced", "invalid_epoch", "invalid_state"]
    assert (got[4].markers, got[4].offsets, got[5].markers, got[8].markers) == ("t-3", "t-3@43", "", "t-3")


@pytest.mark.parametrize("level", ["read_uncommitted", "read_committed"])
def test_markers_are_never_shown(spark, tmp_path, level):
    store = LogStore(spark, f"file://{tmp_path}/log3")
    store.append(rows(spark, 4, producer_id=7, producer_epoch=0, is_txn=True), 1)
    store.end_transaction("t", 7, 0, True, 1, 2)
    assert store.fetch("t", isolation=level).where("is_control").count() == 0 and store.fetch("t", isolation=level).count() == 4
