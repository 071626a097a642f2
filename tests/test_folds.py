"""The ordered folds: decision tables, and streaming against batch."""

import random

from tidemark.operators import append, groups, security
from tidemark.streaming import processors


def test_producer_state():
    p = append.ProducerState()
    assert p.take(0, 7, 3, 0) == ("accepted", 0)  # any first sequence
    assert p.take(0, 10, 2, 3) == ("accepted", 3)
    assert p.take(0, 10, 2, 5) == ("duplicate", 3)
    assert p.take(0, 7, 3, 5) == ("duplicate", 0)
    assert p.take(0, 13, 1, 5) == ("out_of_order", -1)
    assert p.take(0, 5, 1, 5) == ("duplicate_sequence", -1)
    assert p.take(1, 0, 1, 5) == ("accepted", 5)
    assert p.take(0, 12, 1, 6) == ("fenced", -1)
    for i in range(1, 7):
        assert p.take(1, i, 1, 5 + i)[0] == "accepted"
    assert p.take(1, 0, 1, 20) == ("duplicate_sequence", -1)  # out of the remembered batches


def test_sticky_keeps_and_spreads():
    parts = [("t", i) for i in range(6)]
    got = groups.sticky(["a", "b", "c"], {m: {"t"} for m in "abc"}, parts, {p: "a" for p in parts})
    assert [got[p] for p in parts].count("a") == 2 and set(got.values()) == {"a", "b", "c"}
    assert all(got[p] == "a" for p in parts[:2])
    only = groups.sticky(["a", "b"], {"a": {"t"}, "b": {"u"}}, parts, {})
    assert set(only.values()) == {"a"}


def test_classic_group(spark):
    events = [(0, "join", "a"), (1, "sync", "a"), (2, "join", "b"), (3, "join", "a"), (4, "sync", "b"), (5, "sync", "a"), (6, "leave", "b"), (7, "sync", "z")]
    df = spark.createDataFrame([("g", *e) for e in events], "group string, seq long, kind string, member string")
    rows = groups.classic_group(df).orderBy("seq").collect()
    assert [(r.state, r.generation) for r in rows] == [("CompletingSync", 1), ("Stable", 1), ("PreparingRebalance", 1), ("CompletingSync", 2), ("CompletingSync", 2), ("Stable", 2), ("PreparingRebalance", 2), ("PreparingRebalance", 2)]
    assert rows[-1].status == "unknown_member"


def test_heartbeats(spark):
    events = [(0, "a", 0, ["t"], None), (1, "b", 0, ["t"], None), (2, "a", 7, None, ["t-0", "t-1"]), (3, "b", 2, None, None), (4, "c", 5, None, None), (5, "a", -1, None, None), (6, "b", 2, None, None), (7, "d", 0, None, None)]
    df = spark.createDataFrame([("g", *e) for e in events], "group string, seq long, member string, epoch long, topics array<string>, owned array<string>")
    rows = groups.heartbeats(df, {"t": 2}).orderBy("seq").collect()
    assert [r.error for r in rows] == [0, 0, 82, 0, 25, 0, 0, 42]
    assert rows[0].assigned == ["t-0", "t-1"] and rows[1].assigned == []  # not before the old owner lets go
    assert rows[6].assigned == ["t-0", "t-1"]


def test_merged_ranges(spark):
    df = spark.createDataFrame([("g", a, b) for a, b in [(0, 5), (2, 3), (6, 8), (10, 12), (11, 20)]], "group string, first long, last long")
    rows = groups.merged(df, ["group"]).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in rows] == [(0, 8), (10, 20)]


def test_share_deliveries_limit(spark):
    events = []
    for i in range(7):
        events += [("g", 0, 2 * i, i * 1000, "fetch", "m", 0, 0), ("g", 0, 2 * i + 1, i * 1000, "release", "m", 0, 0)]
    df = spark.createDataFrame(events, "group string, partition long, seq long, ts_ms long, kind string, member string, first long, last long")
    assert [r.deliveries for r in groups.share_deliveries(df).orderBy("seq").collect()] == [1, 2, 3, 4, 5]


def test_quota(spark):
    df = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 0, 50), (1, 2, 1000, 0), (1, 3, 10_000, 200)], "user long, seq long, ts_ms long, bytes long")
    assert [r.delay_ms for r in security.bucket_delays(df, 100.0).orderBy("seq").collect()] == [0, 500, 0, 0]


def stream(spark, tmp_path, df, parts, build):
    schema = df.schema
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(out)


def test_streamed_dedup_is_the_batch_fold(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.PROVIDER)
    rng, rows, seq = random.Random(5), [], 0
    for producer in range(3):
        at, epoch = 0, 0
        for _ in range(25):
            kind = rng.random()
            if kind < 0.1:
                epoch, at = epoch + 1, 0
            base = at if kind < 0.7 else max(0, at - rng.choice([2, 4, 30])) if kind < 0.9 else at + 3
            rows.append((0, producer, seq, epoch if kind < 0.97 else epoch - 1, base, 2))
            at = base + 2 if base == at else at
            seq += 1
    df = spark.createDataFrame(rows, "partition long, producer_id long, seq long, producer_epoch int, base_sequence long, records long")
    parts = [df.where("seq % 25 < 9"), df.where("seq % 25 >= 9")]
    wanted = sorted(map(tuple, append.idempotent(df).collect()))
    got = stream(spark, tmp_path, df, parts, processors.deduplicated)
    assert sorted(map(tuple, got.collect())) == wanted


def test_streamed_marks(spark, tmp_path, sf_dir):
    from tidemark.operators import transactions, watermarks
    from tidemark.plans.logview import load

    log = load(spark, sf_dir).select("partition", "offset", "producer_id", "producer_epoch", "is_txn", "is_control", "control_type")
    parts = [log.where("offset < 120"), log.where("offset >= 120")]
    got = stream(spark, tmp_path, log, parts, processors.stable_offsets).collect()
    closed = sorted((r.partition, r.producer_id, r.producer_epoch, r.first_offset, r.last_offset) for r in got if r.kind == "closed" and r.control_type == 0)
    bad = transactions.aborted_ranges(log).select("partition", "producer_id", "producer_epoch", "first_offset", "last_offset").collect()
    assert closed == sorted(map(tuple, bad))
    last = {}
    for r in got:
        if r.kind == "mark" and r.last_offset >= last.get(r.partition, (0, 0))[1]:
            last[r.partition] = (r.first_offset, r.last_offset)
    assert last == {r.partition: (r.lso, r.leo) for r in watermarks.watermarks(log).collect()}
