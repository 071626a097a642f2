"""The engine's query catalogue on the canonical log, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import append, cluster, control, coordinator, groups, offsets, retention, scan, security, transactions, watermarks
from tidemark.functions import checks, scram
from tidemark.plans.logview import LOG_SQL, kept_aborts, kept_marks, load
from tidemark.sources import controllog, recordbatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Views that several oracles read, on top of the log.
MARKS = """
opn AS (SELECT "partition", producer_id, producer_epoch, min("offset") AS first_offset FROM log l WHERE is_txn AND NOT is_control AND NOT EXISTS
        (SELECT 1 FROM log m WHERE m.is_control AND m."partition" = l."partition" AND m.producer_id = l.producer_id AND m.producer_epoch = l.producer_epoch) GROUP BY ALL),
marks AS (SELECT e."partition", 0::BIGINT AS log_start, leo, leo AS hw, least(leo, coalesce(f, leo)) AS lso
          FROM (SELECT "partition", max("offset") + 1 AS leo FROM log GROUP BY ALL) e
          LEFT JOIN (SELECT "partition", min(first_offset) AS f FROM opn GROUP BY ALL) o USING ("partition")),
txns AS (SELECT "partition", producer_id, producer_epoch, min("offset") FILTER (NOT is_control) AS first_offset, max("offset") FILTER (NOT is_control) AS last_offset,
         count(*) FILTER (NOT is_control) AS records, max(control_type) AS control_type FROM log WHERE is_txn GROUP BY ALL),
bad AS (SELECT * FROM txns WHERE control_type = 0),
seen AS (SELECT l.* FROM log l JOIN marks USING ("partition") WHERE "offset" < lso AND NOT is_control AND NOT EXISTS
         (SELECT 1 FROM bad b WHERE l.is_txn AND b."partition" = l."partition" AND b.producer_id = l.producer_id AND b.producer_epoch = l.producer_epoch
          AND l."offset" BETWEEN b.first_offset AND b.last_offset)),
bt AS (SELECT "partition", batch, min("offset") AS base_offset, max("offset") AS last_offset, (sum(bytes) + 61)::BIGINT AS bytes, count(*) AS records,
       max(ts_ms) AS max_ts, min(ts_ms) AS first_ts FROM log WHERE NOT is_control GROUP BY ALL),
seg AS (SELECT "partition", batch // 12 AS segment, min(base_offset) AS base, max(last_offset) AS last_offset, sum(bytes)::BIGINT AS bytes, sum(records)::BIGINT AS records,
        max(max_ts) AS max_ts FROM bt GROUP BY ALL),
sg AS (SELECT *, segment < max(segment) OVER (PARTITION BY "partition") AS sealed, max_ts + 1000 * (segment % 3) AS mtime_ms FROM seg)
"""


def query(sql: str | None = None, log: bool = True):
    """Registers a query and its oracle; ``log`` puts the log view and its marks in front."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {LOG_SQL}, {MARKS} {sql}" if log else sql).strip()
        return f

    return add


#: Requests, commands and members are derived from every event (i: its id, u: its user) and every user.
EV, US = "(SELECT event_id AS i, user_id AS u FROM events)", "(SELECT DISTINCT user_id AS i FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("i"), F.col("user_id").alias("u"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("u").alias("i")).distinct()


def segment_table(log: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window

    rows = scan.segments(log, 12)
    return rows.withColumn("sealed", F.col("segment") < F.max("segment").over(Window.partitionBy("partition"))).withColumn("mtime_ms", F.col("max_ts") + 1000 * (F.col("segment") % 3))


# -- scans ----------------------------------------------------------------------------------------------------------


@query('SELECT "partition", count(*) AS records, sum(bytes)::BIGINT AS bytes, min("offset") AS first_offset, max("offset") AS last_offset FROM seen GROUP BY ALL')
def q_committed_summary(spark, sf_dir):
    rows = scan.read_committed(load(spark, sf_dir), kept_marks(spark, sf_dir), kept_aborts(spark, sf_dir))
    return rows.groupBy("partition").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query('SELECT "partition", "offset", key, value, ts_ms, producer_id FROM seen')
def q_fetch_committed(spark, sf_dir):
    return scan.read_committed(load(spark, sf_dir), kept_marks(spark, sf_dir), kept_aborts(spark, sf_dir)).select("partition", "offset", "key", "value", "ts_ms", "producer_id")


@query('SELECT "partition", "offset", key, value, ts_ms, producer_id FROM log JOIN marks USING ("partition") WHERE "offset" < hw AND NOT is_control AND "offset" BETWEEN 100 AND 899')
def q_fetch_uncommitted(spark, sf_dir):
    return scan.read_uncommitted(scan.range_scan(load(spark, sf_dir), 100, 900), kept_marks(spark, sf_dir)).select("partition", "offset", "key", "value", "ts_ms", "producer_id")


@query('SELECT "partition", batch, base_offset, last_offset, bytes, records FROM (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY "partition" ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bt WHERE last_offset >= 55) WHERE before < 4096 OR before = 0')
def q_fetch_max_bytes(spark, sf_dir):
    return scan.budgeted(scan.batches(load(spark, sf_dir)), 55, 4096).select("partition", "batch", "base_offset", "last_offset", "bytes", "records")


@query('SELECT "partition", log_start, leo, hw, lso FROM marks')
def q_watermarks(spark, sf_dir):
    return watermarks.watermarks(load(spark, sf_dir))


AT = 1704100000000


@query("""SELECT "partition", coalesce(min("offset") FILTER (late), -1) AS "offset", coalesce(arg_min(ts_ms, "offset") FILTER (late), -1) AS ts_ms
FROM (SELECT *, NOT is_control AND ts_ms >= (SELECT min(ts_ms) + (max(ts_ms) - min(ts_ms)) // 3 FROM log) AS late FROM log) GROUP BY "partition" """)
def q_list_offsets_ts(spark, sf_dir):
    log = load(spark, sf_dir)
    low, high = log.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return scan.list_offsets(log, low + (high - low) // 3)


@query('SELECT "partition", -1::BIGINT AS ts_ms, hw AS "offset" FROM marks UNION ALL SELECT "partition", -2, log_start FROM marks')
def q_list_offsets_ends(spark, sf_dir):
    log = load(spark, sf_dir)
    return scan.list_offsets(log, -1).unionByName(scan.list_offsets(log, -2))


@query("""SELECT p."partition", p.probe, coalesce(max(segment) FILTER (base <= probe), -1) AS segment, coalesce(max(base) FILTER (base <= probe), -1) AS base
FROM (SELECT DISTINCT user_id % 4 AS "partition", event_id // 4 - 3 AS probe FROM events) p LEFT JOIN seg s ON s."partition" = p."partition" GROUP BY ALL""")
def q_segment_of_offset(spark, sf_dir):
    probes = events(spark, sf_dir).select((F.col("u") % 4).alias("partition"), (F.floor(F.col("i") / 4) - 3).alias("probe")).distinct()
    return scan.segment_of(scan.segments(load(spark, sf_dir), 12), probes)


@query('SELECT "partition", segment, base, last_offset, bytes, records, max_ts FROM seg')
def q_segment_summary(spark, sf_dir):
    return scan.segments(load(spark, sf_dir), 12)


@query("""SELECT l."partition", l."offset", l.bytes FROM log l JOIN (SELECT "partition", (leo // 2) AS first_local FROM marks) USING ("partition")""")
def q_tier_union_scan(spark, sf_dir):
    log = load(spark, sf_dir)
    firsts = watermarks.watermarks(log).select("partition", F.floor(F.col("leo") / 2).alias("first_local"))
    halves = log.join(F.broadcast(firsts), "partition")
    local, tier = halves.where("offset >= first_local").drop("first_local"), halves.where("offset < first_local + 5").drop("first_local")
    return scan.tiered_union(local, tier, firsts).select("partition", "offset", "bytes")


TOPICS_SQL = f"topics AS (SELECT 'topic-' || i AS topic, 1 + i % 5 AS partitions, 1 + i % 3 AS rf FROM {US})"


def topic_table(spark, sf_dir):
    return users(spark, sf_dir).select(F.concat(F.lit("topic-"), F.col("i")).alias("topic"), (1 + F.col("i") % 5).alias("partitions"), (1 + F.col("i") % 3).alias("rf"))


@query(f"WITH {TOPICS_SQL} SELECT topic FROM topics WHERE topic IN ('topic-3') OR regexp_full_match(topic, 'topic-1.*')", log=False)
def q_topic_regex(spark, sf_dir):
    return scan.subscribed(topic_table(spark, sf_dir), ["topic-3"], "topic-1.*").select("topic")


@query('SELECT "partition", bytes, error FROM (SELECT "partition", sum(CASE WHEN "partition" % 2 = 0 THEN bytes ELSE 0 END)::BIGINT AS bytes, CASE WHEN "partition" = 3 THEN 6 ELSE 0 END AS error FROM log GROUP BY ALL) WHERE bytes > 0 OR error <> 0')
def q_fetch_session_changes(spark, sf_dir):
    sums = load(spark, sf_dir).groupBy("partition").agg(F.sum(F.when(F.col("partition") % 2 == 0, F.col("bytes")).otherwise(0)).alias("bytes"))
    return scan.changed_partitions(sums.withColumn("error", F.when(F.col("partition") == 3, 6).otherwise(0)))


@query('SELECT "partition", key, count(*) AS records, sum(bytes)::BIGINT AS bytes FROM log WHERE NOT is_control GROUP BY ALL')
def q_traffic_counters(spark, sf_dir):
    return load(spark, sf_dir).where("NOT is_control").groupBy("partition", "key").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))


# -- transactions ---------------------------------------------------------------------------------------------------


@query('SELECT "partition", producer_id, producer_epoch, first_offset, last_offset FROM bad')
def q_aborted_ranges(spark, sf_dir):
    return transactions.aborted_ranges(load(spark, sf_dir))


@query('SELECT "partition", producer_id, producer_epoch, first_offset FROM opn')
def q_open_txns(spark, sf_dir):
    return watermarks.open_transactions(load(spark, sf_dir))


@query("""SELECT "partition", producer_id, max(producer_epoch) AS last_epoch, max("offset") FILTER (NOT is_control) > coalesce(max("offset") FILTER (is_control), -1) AS is_open,
coalesce(max("offset") FILTER (is_control), -1) AS last_marker, coalesce(arg_max(control_type, "offset") FILTER (is_control), -1)::INT AS last_control_type FROM log WHERE is_txn GROUP BY ALL""")
def q_producer_state(spark, sf_dir):
    return transactions.producer_state(load(spark, sf_dir))


TXN_SQL = f"""jx AS (SELECT i, i % 28 AS j, i // 28 * 7 + i % 28 % 7 AS id FROM {EV}),
txl AS (SELECT i AS seq, 'txn-' || id AS txn_id, CASE WHEN j // 7 = 0 THEN 1 WHEN j // 7 = 1 THEN 2 WHEN j // 7 = 2 AND j % 7 <> 3 THEN 3 WHEN j // 7 = 3 AND j % 7 NOT IN (2, 3, 5) THEN 4 ELSE 5 END AS kind,
CASE WHEN j // 7 IN (0, 1) THEN 1000 + id END AS pid, CASE WHEN j // 7 = 0 THEN j % 3 END AS epoch, CASE WHEN j // 7 >= 2 THEN 1 + j % 7 % 2 END AS outcome FROM jx)"""


def txn_log(spark, sf_dir):
    i = F.col("i")
    j = i % 28
    round_, own, name = F.floor(j / 7), j % 7, F.floor(i / 28) * 7 + i % 28 % 7
    kind = F.when(round_ == 0, 1).when(round_ == 1, 2).when((round_ == 2) & (own != 3), 3).when((round_ == 3) & ~own.isin(2, 3, 5), 4).otherwise(5)
    return events(spark, sf_dir).select(i.alias("seq"), F.concat(F.lit("txn-"), name).alias("txn_id"), kind.alias("kind"), F.when(round_ < 2, 1000 + name).alias("pid"), F.when(round_ == 0, j % 3).alias("epoch"), F.when(round_ >= 2, 1 + own % 2).alias("outcome"))


STATE_SQL = """st AS (SELECT txn_id, arg_max(kind, seq) FILTER (kind <> 5) AS kind, arg_max(outcome, seq) FILTER (outcome IS NOT NULL) AS outcome,
arg_max(pid, seq) FILTER (pid IS NOT NULL) AS pid, arg_max(epoch, seq) FILTER (epoch IS NOT NULL) AS epoch FROM txl GROUP BY ALL),
nm AS (SELECT *, CASE kind WHEN 1 THEN 'Empty' WHEN 2 THEN 'Ongoing' WHEN 3 THEN 'Prepare' || CASE outcome WHEN 1 THEN 'Commit' ELSE 'Abort' END ELSE 'Complete' || CASE outcome WHEN 1 THEN 'Commit' ELSE 'Abort' END END AS state FROM st)"""


@query(f"WITH {TXN_SQL}, {STATE_SQL} SELECT txn_id, pid, epoch, state, CASE WHEN kind = 3 THEN 'replay' WHEN kind = 2 THEN 'abort' ELSE 'ready' END AS takeover FROM nm", log=False)
def q_txn_state(spark, sf_dir):
    return transactions.coordinator_state(txn_log(spark, sf_dir))


@query(f"WITH {TXN_SQL}, {STATE_SQL} SELECT txn_id, pid, state FROM nm WHERE state IN ('Ongoing', 'PrepareCommit', 'PrepareAbort')", log=False)
def q_list_transactions(spark, sf_dir):
    return transactions.list_transactions(transactions.coordinator_state(txn_log(spark, sf_dir)), ["Ongoing", "PrepareCommit", "PrepareAbort"])


@query("""SELECT l."partition", batch, l.producer_id, l.producer_epoch, bool_or(is_txn AND (coalesce(f.marker_epoch > l.producer_epoch, false) OR coalesce(f.in_flight, false))) AS rejected
FROM log l LEFT JOIN (SELECT "partition", producer_id, max(producer_epoch) AS marker_epoch, ("partition" + producer_id) % 5 = 0 AS in_flight FROM log WHERE is_control GROUP BY "partition", producer_id) f
USING ("partition", producer_id) WHERE NOT l.is_control GROUP BY ALL""")
def q_zombie_fence(spark, sf_dir):
    log = load(spark, sf_dir)
    fences = log.where("is_control").groupBy("partition", "producer_id").agg(F.max("producer_epoch").alias("marker_epoch")).withColumn("in_flight", (F.col("partition") + F.col("producer_id")) % 5 == 0)
    writes = log.where("NOT is_control").select("partition", "batch", "producer_id", "producer_epoch", "is_txn").distinct()
    return transactions.fenced(writes, fences).select("partition", "batch", "producer_id", "producer_epoch", "rejected")


@query(f"""WITH m AS (SELECT i AS seq, u % 4 AS "partition", 1000 + u AS producer_id, i // 400 AS epoch, i % 3 % 2 AS outcome, i % 5 = 0 AS reopened FROM {EV}),
w AS (SELECT *, max(epoch) OVER p AS newest, last_value(outcome) OVER p AS last FROM m WINDOW p AS (PARTITION BY "partition", producer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT "partition", seq, CASE WHEN newest IS NULL OR epoch > newest THEN 'applied' WHEN epoch < newest THEN 'stale' WHEN reopened THEN 'applied' WHEN outcome = last THEN 'repeated' ELSE 'conflicting' END AS effect FROM w""", log=False)
def q_marker_effects(spark, sf_dir):
    i, u = F.col("i"), F.col("u")
    markers = events(spark, sf_dir).select(i.alias("seq"), (u % 4).alias("partition"), (1000 + u).alias("producer_id"), F.floor(i / 400).alias("epoch"), (i % 3 % 2).alias("outcome"), (i % 5 == 0).alias("reopened"))
    return transactions.marker_effects(markers).select("partition", "seq", "effect")


@query(f"""SELECT 'txn-' || i AS txn_id, 1000 + i AS pid, i % 3 + 1 AS epoch, 'abort' AS action FROM {EV} WHERE i % 4 = 1 AND i * 7919 % 1000000 + 1500 <= 600000""", log=False)
def q_txn_timeouts(spark, sf_dir):
    i = F.col("i")
    states = events(spark, sf_dir).select(F.concat(F.lit("txn-"), i).alias("txn_id"), (1000 + i).alias("pid"), (i % 3).alias("epoch"), F.when(i % 4 == 1, "Ongoing").otherwise("Empty").alias("state"), (i * 7919 % 1000000).alias("started_ms"), F.lit(1500).alias("timeout_ms"))
    return coordinator.timed_out(states, 600000)


@query()
def q_coordinator(spark, sf_dir):
    i = F.col("i")
    turn = i % 8
    command = F.when(turn == 0, "init").when(turn.isin(1, 2), "add_partition").when(turn == 3, "add_offsets").when(turn.isin(4, 5), "commit_offset").otherwise("end")
    rows = events(spark, sf_dir).select(F.concat(F.lit("txn-"), F.floor(i / 32)).alias("txn_id"), i.alias("seq"), command.alias("command"), F.floor(i % 32 / 8).alias("epoch"), F.lit("t").alias("topic"), (i % 3).alias("partition"), i.alias("offset"), (F.floor(i / 8) % 2 == 0).alias("commit"))
    return coordinator.coordinate(rows)


# -- offsets --------------------------------------------------------------------------------------------------------

COMMITS = """cm AS (SELECT 'group-' || (user_id % 5) AS "group", event_type AS topic, user_id % 4 AS "partition", event_id AS seq, event_id // 3 AS "offset", props AS metadata FROM events),
lc AS (SELECT "group", topic, "partition", arg_max("offset", seq) AS "offset", arg_max(metadata, seq) AS metadata FROM cm GROUP BY ALL)"""


def commits(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.concat(F.lit("group-"), F.col("user_id") % 5).alias("group"), F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 3).alias("offset"), F.col("props").alias("metadata"))


@query(f"WITH {COMMITS} SELECT * FROM lc", log=False)
def q_committed_offsets(spark, sf_dir):
    return offsets.latest(commits(spark, sf_dir))


@query(f"""WITH {COMMITS} SELECT g."group", g.topic, p AS "partition", coalesce(lc."offset", -1) AS "offset" FROM (SELECT DISTINCT "group", topic FROM cm) g, range(6) t(p) LEFT JOIN lc ON lc."group" = g."group" AND lc.topic = g.topic AND lc."partition" = p""", log=False)
def q_offset_fetch(spark, sf_dir):
    rows = commits(spark, sf_dir)
    wanted = rows.select("group", "topic").distinct().withColumn("partition", F.explode(F.expr("sequence(0L, 5L)")))
    return offsets.fetch(offsets.latest(rows), wanted)


LAG = f"""{COMMITS}, ends AS (SELECT event_type AS topic, user_id % 4 AS "partition", max(event_id) + 1 AS end_offset FROM events WHERE user_id % 4 < 3 GROUP BY ALL),
lg AS (SELECT "group", topic, "partition", "offset", coalesce(end_offset, -1) AS end_offset, CASE WHEN "offset" >= 0 AND coalesce(end_offset, -1) >= 0 THEN end_offset - "offset" ELSE -1 END AS lag FROM lc LEFT JOIN ends USING (topic, "partition"))"""


def lags(spark, sf_dir):
    rows = commits(spark, sf_dir)
    ends = rows.where("partition < 3").groupBy("topic", "partition").agg((F.max("seq") + 1).alias("end_offset"))
    return offsets.lag(offsets.latest(rows), ends)


@query(f"WITH {LAG} SELECT * FROM lg", log=False)
def q_consumer_lag(spark, sf_dir):
    return lags(spark, sf_dir)


@query(f'WITH {LAG} SELECT "group", sum(CASE WHEN lag > 0 THEN lag ELSE 0 END)::BIGINT AS total_lag FROM lg GROUP BY ALL', log=False)
def q_total_lag(spark, sf_dir):
    return offsets.total_lag(lags(spark, sf_dir))


@query(f"""WITH r AS (SELECT i, 'group-' || (u % 40) AS "group", 'm-' || (i % 6) AS member, i % 3 AS generation FROM {EV}),
g AS (SELECT DISTINCT 'group-' || (u % 40) AS "group", CASE WHEN u % 40 % 2 = 0 THEN 'Stable' ELSE 'PreparingRebalance' END AS state, 1 AS current_generation FROM {EV})
SELECT i, CASE WHEN i % 6 > 4 THEN 'unknown_member' WHEN state = 'Stable' AND generation <> current_generation THEN 'illegal_generation' ELSE 'ok' END AS status FROM r LEFT JOIN g USING ("group")""", log=False)
def q_commit_status(spark, sf_dir):
    i, g = F.col("i"), F.col("u") % 40
    requests = events(spark, sf_dir).select("i", F.concat(F.lit("group-"), g).alias("group"), F.concat(F.lit("m-"), i % 6).alias("member"), (i % 3).alias("generation"))
    states = events(spark, sf_dir).select(F.concat(F.lit("group-"), g).alias("group"), F.when(g % 2 == 0, "Stable").otherwise("PreparingRebalance").alias("state"), F.lit(1).alias("current_generation")).distinct()
    members = requests.where(i % 6 <= 4).select("group", "member").distinct()
    return offsets.judged_commits(requests, states, members).select("i", "status")


@query(f"""WITH p AS (SELECT i AS seq, 'g-' || (u % 7) AS "group", 'topic-' || u AS topic, i % 3 AS "partition", i * 10 AS "offset" FROM {EV})
SELECT "group", topic, "partition", arg_max("offset", seq) AS "offset" FROM p WHERE seq // 6 % 3 <> 1 GROUP BY ALL""", log=False)
def q_txn_offsets(spark, sf_dir):
    i, u, txn = F.col("i"), F.col("u"), F.floor(F.col("i") / 6)
    pending = events(spark, sf_dir).select(i.alias("seq"), F.concat(F.lit("txn-"), txn).alias("txn_id"), F.concat(F.lit("g-"), u % 7).alias("group"), F.concat(F.lit("topic-"), u).alias("topic"), (i % 3).alias("partition"), (i * 10).alias("offset"))
    outcomes = events(spark, sf_dir).select(F.concat(F.lit("txn-"), txn).alias("txn_id"), F.when(txn % 3 == 1, 2).otherwise(1).alias("outcome")).distinct()
    return transactions.promoted_offsets(pending, outcomes)


# -- appends --------------------------------------------------------------------------------------------------------


@query("""SELECT "partition", seq, 100 * ("partition" % 3) + coalesce(sum(records) OVER (PARTITION BY "partition" ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base_offset,
100 * ("partition" % 3) + sum(records) OVER (PARTITION BY "partition" ORDER BY seq)::BIGINT - 1 AS last_offset FROM (SELECT "partition", batch AS seq, records FROM bt)""")
def q_assign_offsets(spark, sf_dir):
    rows = scan.batches(load(spark, sf_dir)).select("partition", F.col("batch").alias("seq"), "records")
    ends = rows.select("partition").distinct().withColumn("leo", 100 * (F.col("partition") % 3)).where("leo > 0")
    return append.assign_offsets(rows, ends).select("partition", "seq", "base_offset", "last_offset")


@query("""SELECT "partition", base_offset, expected FROM (SELECT "partition", base_offset, 1 + lag(last_offset) OVER (PARTITION BY "partition" ORDER BY base_offset) AS expected FROM bt WHERE batch % 5 <> 2) WHERE expected <> base_offset""")
def q_contiguity_violations(spark, sf_dir):
    return append.contiguity_violations(scan.batches(load(spark, sf_dir)).where("batch % 5 <> 2"))


@query("""SELECT "partition", 1000 + batch % 3 AS producer_id, base_offset, last_offset FROM bt QUALIFY row_number() OVER (PARTITION BY "partition", batch % 3 ORDER BY base_offset DESC) <= 5""")
def q_dedup_ring(spark, sf_dir):
    rows = scan.batches(load(spark, sf_dir)).withColumn("producer_id", 1000 + F.col("batch") % 3)
    return append.last_batches(rows).select("partition", "producer_id", "base_offset", "last_offset")


def retried_writes(spark, sf_dir):
    """Every batch once, every fifth one again, every seventh one skipped at first and late."""
    rows = scan.batches(load(spark, sf_dir)).withColumn("producer_id", 1000 + F.col("batch") % 3)
    turn = F.floor(F.col("batch") / 3)
    rows = rows.select("partition", "producer_id", (turn * 10).alias("seq"), F.floor(turn / 16).alias("producer_epoch"), ((turn % 16) * 10).alias("base_sequence"), F.lit(10).cast("long").alias("records"))
    again = rows.where((F.col("seq") / 10) % 5 == 0).withColumn("seq", F.col("seq") + 15)
    stale = rows.where((F.col("seq") / 10) % 16 == 3).withColumn("seq", F.col("seq") + 161)
    return rows.unionByName(again).unionByName(stale)


@query(""", bx AS (SELECT "partition", 1000 + batch % 3 AS producer_id, batch // 3 AS turn FROM bt),
w0 AS (SELECT "partition", producer_id, turn * 10 AS seq, turn // 16 AS epoch, turn % 16 * 10 AS first FROM bx),
wr AS (SELECT * FROM w0 UNION ALL SELECT "partition", producer_id, seq + 15, epoch, first FROM w0 WHERE seq // 10 % 5 = 0 UNION ALL SELECT "partition", producer_id, seq + 161, epoch, first FROM w0 WHERE seq // 10 % 16 = 3),
rn AS (SELECT *, row_number() OVER (PARTITION BY "partition", producer_id ORDER BY seq) AS r FROM wr),
fo AS (SELECT "partition", producer_id, seq, r, epoch, [{'f': first, 'b': 0::BIGINT}] AS held, 10::BIGINT AS e, 'accepted' AS status, 0::BIGINT AS base FROM rn WHERE r = 1 UNION ALL
SELECT "partition", producer_id, seq, r, greatest(pe, epoch), CASE WHEN status = 'accepted' THEN list_slice(list_append(own, {'f': first, 'b': e}), -5, -1) ELSE own END, e + CASE WHEN status = 'accepted' THEN 10 ELSE 0 END, status,
CASE status WHEN 'accepted' THEN e WHEN 'duplicate' THEN list_filter(own, lambda x: x.f = first)[1].b ELSE -1 END
FROM (SELECT *, CASE WHEN epoch < pe THEN 'fenced' WHEN len(own) = 0 OR first = own[-1].f + 10 THEN 'accepted' WHEN len(list_filter(own, lambda x: x.f = first)) > 0 THEN 'duplicate' WHEN first <= own[-1].f + 9 THEN 'duplicate_sequence' ELSE 'out_of_order' END AS status
FROM (SELECT n.*, f.epoch AS pe, f.e, CASE WHEN n.epoch > f.epoch THEN [] ELSE f.held END AS own FROM fo f JOIN rn n ON n."partition" = f."partition" AND n.producer_id = f.producer_id AND n.r = f.r + 1)))
SELECT "partition", producer_id, seq, status, base FROM fo""")
def q_idempotent_dedup(spark, sf_dir):
    return append.idempotent(retried_writes(spark, sf_dir))


@query(""", rn AS (SELECT "partition", base_offset, bytes, row_number() OVER (PARTITION BY "partition" ORDER BY base_offset) AS r FROM bt),
fo AS (SELECT "partition", base_offset, r, bytes AS size, 0::BIGINT AS segment FROM rn WHERE r = 1 UNION ALL
SELECT n."partition", n.base_offset, n.r, CASE WHEN f.size + n.bytes > 4096 THEN n.bytes ELSE f.size + n.bytes END, f.segment + CASE WHEN f.size + n.bytes > 4096 THEN 1 ELSE 0 END FROM fo f JOIN rn n ON n."partition" = f."partition" AND n.r = f.r + 1)
SELECT "partition", base_offset, segment FROM fo""")
def q_roll_segments(spark, sf_dir):
    return append.roll_segments(scan.batches(load(spark, sf_dir)), 4096)


# -- retention ------------------------------------------------------------------------------------------------------


@query("""SELECT "partition", segment, min(CASE WHEN sealed AND max_ts < lim AND mtime_ms < lim THEN 1 ELSE 0 END) OVER (PARTITION BY "partition" ORDER BY base) = 1 AS deleted
FROM sg, (SELECT max(max_ts) - (max(max_ts) - min(max_ts)) // 2 AS lim FROM seg)""")
def q_retention_time(spark, sf_dir):
    rows = segment_table(load(spark, sf_dir))
    low, high = rows.agg(F.min("max_ts"), F.max("max_ts")).first()
    return retention.by_time(rows, high, (high - low) // 2).select("partition", "segment", "deleted")


@query("""SELECT "partition", segment, sealed AND sum(bytes) OVER w > 12000 AND sum(sealed::INT) OVER w > 1 AS deleted FROM sg WINDOW w AS (PARTITION BY "partition" ORDER BY base ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def q_retention_bytes(spark, sf_dir):
    return retention.by_bytes(segment_table(load(spark, sf_dir)), 12000).select("partition", "segment", "deleted")


@query("""SELECT "partition", before, CASE WHEN t > hw THEN 'out_of_range' WHEN t <= log_start THEN 'unchanged' ELSE 'moved' END AS status, CASE WHEN t <= hw AND t > log_start THEN t ELSE log_start END AS log_start
FROM (SELECT "partition", b.before, hw, log_start, CASE WHEN b.before = -1 THEN hw ELSE b.before END AS t FROM marks, (VALUES (-1), (0), (50), (100000000)) b(before))""")
def q_delete_records(spark, sf_dir):
    marks = watermarks.watermarks(load(spark, sf_dir)).select("partition", "log_start", "hw")
    wanted = marks.select("partition", F.explode(F.array(*[F.lit(x).cast("long") for x in (-1, 0, 50, 100000000)])).alias("before"))
    return retention.delete_records(marks, wanted).withColumn("before", F.col("before").cast("int"))


@query('SELECT "partition", segment FROM sg WHERE sealed AND last_offset < 130 + "partition" * 10')
def q_droppable_segments(spark, sf_dir):
    rows = segment_table(load(spark, sf_dir))
    starts = rows.select("partition").distinct().withColumn("log_start", 130 + F.col("partition") * 10)
    return retention.droppable(rows, starts).select("partition", "segment")


@query("""SELECT "partition", coalesce(e, 0) AS leo, least(hw, coalesce(e, 0)) AS hw, least(log_start, coalesce(e, 0)) AS log_start FROM marks LEFT JOIN (SELECT "partition", max(last_offset) + 1 AS e FROM bt WHERE last_offset + 1 <= 95 GROUP BY ALL) USING ("partition")""")
def q_truncate(spark, sf_dir):
    log = load(spark, sf_dir)
    return retention.truncated_marks(watermarks.watermarks(log).select("partition", "log_start", "hw"), retention.truncate(scan.batches(log), 95))


TIER = """tr AS (SELECT "partition", base, last_offset, bytes, "partition" || '/' || base || '-' || e AS key, e AS epoch, max_ts FROM seg, range(2) t(e) WHERE e = 0 OR segment % 2 = 0),
rg AS (SELECT "partition", base, arg_max(last_offset, epoch) AS last_offset, arg_max(key, epoch) AS key, max(epoch) AS epoch FROM tr GROUP BY ALL)"""


def tier_records(log):
    rows = scan.segments(log, 12).withColumn("epoch", F.explode(F.expr("sequence(0L, 1L)"))).where("epoch = 0 OR segment % 2 = 0")
    return rows.withColumn("key", F.concat(F.col("partition"), F.lit("/"), F.col("base"), F.lit("-"), F.col("epoch")))


@query(f', {TIER} SELECT "partition", base, last_offset, key, epoch FROM rg')
def q_tier_registry(spark, sf_dir):
    return retention.tier_registry(tier_records(load(spark, sf_dir))).select("partition", "base", "last_offset", "key", "epoch")


@query(f', {TIER} SELECT key FROM tr WHERE key NOT IN (SELECT key FROM rg) AND base % 3 <> 1')
def q_tier_orphans(spark, sf_dir):
    rows = tier_records(load(spark, sf_dir))
    objects = rows.select("key", F.when(F.col("base") % 3 == 1, 990).otherwise(100).alias("mtime_ms"))
    return retention.tier_orphans(objects, retention.tier_registry(rows), 1000, 60)


@query("""SELECT "partition", segment FROM seg WHERE last_offset < 60 OR max_ts < (SELECT max(max_ts) - 86400000 FROM seg)""")
def q_tier_purge(spark, sf_dir):
    rows = scan.segments(load(spark, sf_dir), 12)
    starts = rows.select("partition").distinct().withColumn("log_start", F.lit(60))
    newest = rows.agg(F.max("max_ts")).first()[0]
    return retention.tier_purge(rows, starts, newest, 86400000).select("partition", "segment")


@query("""SELECT r."partition", requested, coalesce(max(epoch) FILTER (epoch <= requested), -1) AS epoch, coalesce(arg_max(end_offset, epoch) FILTER (epoch <= requested), -1) AS end_offset
FROM (SELECT "partition", i AS requested FROM marks, range(-1, 6) t(i)) r LEFT JOIN
(SELECT "partition", epoch, coalesce(lead(start) OVER (PARTITION BY "partition" ORDER BY epoch), leo) AS end_offset FROM (SELECT "partition", win AS epoch, min("offset") AS start FROM log WHERE win % 2 = 0 GROUP BY ALL) JOIN marks USING ("partition")) e
ON e."partition" = r."partition" GROUP BY ALL""")
def q_epoch_end_offset(spark, sf_dir):
    log = load(spark, sf_dir)
    epochs = log.where("win % 2 = 0").groupBy("partition", F.col("win").alias("epoch")).agg(F.min("offset").alias("start"))
    ends = log.groupBy("partition").agg((F.max("offset") + 1).alias("leo"))
    wanted = ends.select("partition", F.explode(F.expr("sequence(-1L, 5L)")).alias("requested"))
    return watermarks.epoch_end_offsets(epochs, wanted, ends)


# -- replication and control ----------------------------------------------------------------------------------------

REPLICAS = """rp AS (SELECT "partition", r AS replica, leo, greatest(0, leo - r * (1 + "partition") * 3) AS follower_leo, (r * 7 + "partition" * 5) % 20 * 1000 AS silent_ms, (r + "partition") % 2 = 0 AS was, lso AS old_hw FROM marks, range(3) t(r)),
ir AS (SELECT *, (was AND silent_ms <= 10000) OR (NOT was AND follower_leo >= leo) AS in_sync FROM rp)"""


def replica_table(log):
    rows = watermarks.watermarks(log).withColumn("replica", F.explode(F.expr("sequence(0L, 2L)")))
    p, r = F.col("partition"), F.col("replica")
    return rows.select("partition", "replica", "leo", F.greatest(F.lit(0), F.col("leo") - r * (1 + p) * 3).alias("follower_leo"), ((r * 7 + p * 5) % 20 * 1000).alias("silent_ms"), ((r + p) % 2 == 0).alias("was_in_sync"), F.col("lso").alias("hw"))


@query(f', {REPLICAS} SELECT "partition", max(leo) AS leo, coalesce(greatest(max(old_hw), least(max(leo), min(follower_leo) FILTER (in_sync))), max(old_hw)) AS hw FROM ir GROUP BY ALL')
def q_isr_hw(spark, sf_dir):
    return watermarks.replicated_hw(watermarks.in_sync(replica_table(load(spark, sf_dir)), 10000))


@query(f', {REPLICAS} SELECT "partition", replica, in_sync FROM ir')
def q_isr_members(spark, sf_dir):
    return watermarks.in_sync(replica_table(load(spark, sf_dir)), 10000).select("partition", "replica", "in_sync")


@query(f', {REPLICAS} SELECT "partition", arg_max(replica, follower_leo * 100 - replica) AS replica, max(follower_leo) AS follower_leo FROM rp GROUP BY ALL')
def q_leader_reconcile(spark, sf_dir):
    return cluster.longest_replica(replica_table(load(spark, sf_dir)))


@query(f"SELECT i, 1 + i % 4 >= greatest(1 + i % 3, (1 + i % 5) // 2 + 1) AS accepted FROM {EV}", log=False)
def q_acks_gate(spark, sf_dir):
    i = F.col("i")
    rows = events(spark, sf_dir).select("i", (i % 4).alias("isr_followers"), (1 + i % 3).alias("min_insync"), (1 + i % 5).alias("replicas"))
    return watermarks.acks_all(rows).select("i", "accepted")


PLACED = f"""{TOPICS_SQL}, pl AS (SELECT topic, p AS "partition", list_transform(range(0, rf), lambda k: ((p + k) % 3 + 1)) AS replicas FROM topics, range(5) t(p) WHERE p < partitions)"""


@query(f"WITH {PLACED} SELECT topic, \"partition\", array_to_string(replicas, ',') AS replicas FROM pl", log=False)
def q_replica_placement(spark, sf_dir):
    return cluster.placement(topic_table(spark, sf_dir), [1, 2, 3]).select("topic", "partition", F.concat_ws(",", F.col("replicas").cast("array<string>")).alias("replicas"))


def led(spark, sf_dir):
    return cluster.placement(topic_table(spark, sf_dir), [1, 2, 3]).withColumn("leader", F.col("replicas")[0]).withColumn("epoch", F.col("partition"))


@query(f"""WITH {PLACED}, f AS (SELECT topic, "partition", replicas[1] AS leader, list_filter(replicas, lambda r: r IN (1, 3) AND r <> replicas[1]) AS live FROM pl WHERE replicas[1] = 2)
SELECT topic, "partition", coalesce(live[1], -1)::INT AS leader, CASE WHEN len(live) > 0 THEN "partition" + 1 ELSE "partition" END AS epoch FROM f""", log=False)
def q_failover_choice(spark, sf_dir):
    return cluster.failover(led(spark, sf_dir), [1, 3])


@query(f"""WITH {PLACED} SELECT q.topic, q."partition", q.target, CASE WHEN replicas IS NULL THEN 'unknown_partition' WHEN NOT list_contains(replicas, target) THEN 'not_a_replica' WHEN target = replicas[1] THEN 'already_leader'
WHEN target NOT IN (1, 3) THEN 'not_alive' ELSE 'moved' END AS status FROM (SELECT topic, p AS "partition", t AS target FROM topics, range(2) x(p), range(1, 4) y(t)) q LEFT JOIN pl ON pl.topic = q.topic AND pl."partition" = q."partition" """, log=False)
def q_transfer_leader(spark, sf_dir):
    wanted = topic_table(spark, sf_dir).select("topic", F.explode(F.expr("sequence(0L, 1L)")).alias("partition")).withColumn("target", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return cluster.transfer(wanted, led(spark, sf_dir), [1, 3]).select("topic", "partition", F.col("target").cast("long").alias("target"), "status")


@query(f"WITH {TOPICS_SQL}, r AS (SELECT 'topic-' || i * 2 AS topic, 1 + i % 4 AS rf FROM {US}) SELECT r.topic, r.rf, CASE WHEN t.topic IS NOT NULL THEN 'exists' WHEN r.rf > 2 THEN 'too_few_brokers' ELSE 'created' END AS status FROM r LEFT JOIN topics t ON t.topic = r.topic", log=False)
def q_create_topic(spark, sf_dir):
    wanted = users(spark, sf_dir).select(F.concat(F.lit("topic-"), F.col("i") * 2).alias("topic"), (1 + F.col("i") % 4).alias("rf"))
    return cluster.creatable(wanted, topic_table(spark, sf_dir).select("topic"), 2)


@query(f"WITH {TOPICS_SQL}, r AS (SELECT 'topic-' || i * 2 AS topic FROM {US}) SELECT topic, coalesce(partitions, 0) AS partitions, CASE WHEN partitions IS NULL THEN 3 ELSE 0 END AS error FROM r LEFT JOIN topics USING (topic)", log=False)
def q_metadata_lookup(spark, sf_dir):
    return cluster.look_up(users(spark, sf_dir).select(F.concat(F.lit("topic-"), F.col("i") * 2).alias("topic")), topic_table(spark, sf_dir))


RECORDS = f"""rec AS (SELECT i AS version, CASE WHEN j < 6 THEN 'CreateTopic' WHEN j < 9 THEN 'DeleteTopic' WHEN j < 12 THEN 'CreateTopic' ELSE 'LeaderChange' END AS kind,
't' || (i // 30) || '-' || (j % 6 % CASE WHEN j BETWEEN 6 AND 8 THEN 3 ELSE 6 END) AS topic, 2 + j % 2 AS partitions, 1 + j % 3 AS rf, CASE WHEN j >= 12 THEN j % 2 END AS "partition", j % 3 AS leader, j // 6 AS epoch FROM (SELECT i, i % 30 AS j FROM {EV}))"""


@query(f"""WITH {RECORDS}, dl AS (SELECT topic, max(version) AS d FROM rec WHERE kind = 'DeleteTopic' GROUP BY ALL),
al AS (SELECT topic, min(version) AS created, arg_min(partitions, version) AS partitions, arg_min(rf, version) AS rf FROM rec LEFT JOIN dl USING (topic) WHERE kind = 'CreateTopic' AND (d IS NULL OR version > d) GROUP BY ALL)
SELECT a.topic, p AS "partition", any_value(a.rf) AS rf, any_value(a.created) AS created, arg_max(r.leader, r.version) AS leader, arg_max(r.epoch, r.version) AS epoch FROM al a JOIN range(5) t(p) ON p < a.partitions
LEFT JOIN rec r ON r.kind = 'LeaderChange' AND r.topic = a.topic AND r."partition" = p AND r.version > a.created GROUP BY a.topic, p""", log=False)
def q_metadata_image(spark, sf_dir):
    i, j = F.col("i"), F.col("i") % 30
    kind = F.when(j < 6, "CreateTopic").when(j < 9, "DeleteTopic").when(j < 12, "CreateTopic").otherwise("LeaderChange")
    topic = F.concat(F.lit("t"), F.floor(i / 30), F.lit("-"), j % 6 % F.when(j.between(6, 8), 3).otherwise(6))
    rows = events(spark, sf_dir).select(i.alias("version"), kind.alias("kind"), topic.alias("topic"), (2 + j % 2).alias("partitions"), (1 + j % 3).alias("rf"), F.when(j >= 12, j % 2).cast("int").alias("partition"), (j % 3).alias("leader"), F.floor(j / 6).alias("epoch"))
    return cluster.image(rows)


@query(f"SELECT i AS version, 'k' || i % 3 AS kind FROM {EV} WHERE (SELECT max(i) FROM {EV}) > 15", log=False)
def q_snapshot_sync(spark, sf_dir):
    return coordinator.newer_image(events(spark, sf_dir).select(F.col("i").alias("version"), F.concat(F.lit("k"), F.col("i") % 3).alias("kind")), 15)


@query(f"""SELECT \'topic-\' || i AS topic, CASE WHEN i % 3 = 0 THEN i * 1000 END AS retention_ms, CASE WHEN i % 4 = 1 THEN i * 10 END AS retention_bytes, i % 2 = 0 AS tiered FROM {US}""", log=False)
def q_topic_configs(spark, sf_dir):
    i = F.col("i")
    configs = F.create_map(F.lit("retention.ms"), F.when(i % 3 == 0, (i * 1000).cast("string")).when(i % 3 == 1, "-1").otherwise(""), F.lit("retention.bytes"), F.when(i % 4 == 1, (i * 10).cast("string")), F.lit("tiered"), F.when(i % 2 == 0, "true").otherwise("false"))
    return coordinator.topic_configs(users(spark, sf_dir).select(F.concat(F.lit("topic-"), i).alias("topic"), configs.alias("configs")))


@query(f"""WITH {PLACED}, rq AS (SELECT i, CASE WHEN i % 2 = 0 THEN 'topic-' || (u + i % 3) END AS topic, u + i % 3 AS topic_id, i % 3 AS "partition" FROM {EV})
SELECT i, coalesce(replicas[1], -1)::INT AS leader FROM rq LEFT JOIN pl ON pl.topic = 'topic-' || rq.topic_id AND pl."partition" = rq."partition" """, log=False)
def q_routes(spark, sf_dir):
    i = F.col("i")
    parts = led(spark, sf_dir).withColumn("topic_id", F.regexp_extract("topic", "[0-9]+", 0).cast("long"))
    name = F.col("u") + i % 3
    wanted = events(spark, sf_dir).select("i", F.when(i % 2 == 0, F.concat(F.lit("topic-"), name)).alias("topic"), name.alias("topic_id"), (i % 3).alias("partition"))
    return cluster.routes(wanted, parts).select("i", "leader")


@query('SELECT "partition", "offset", is_control, bytes FROM log WHERE "offset" >= 200')
def q_replica_slice(spark, sf_dir):
    return scan.range_scan(load(spark, sf_dir), 200).select("partition", "offset", "is_control", "bytes")


# -- groups ---------------------------------------------------------------------------------------------------------

MEMBERS = f"""{TOPICS_SQL}, mb AS (SELECT 'group-' || (u % 7) AS "group", 'member-' || (i % 11) AS member, 'topic-' || u AS topic FROM {EV}), md AS (SELECT DISTINCT * FROM mb)"""


def member_table(spark, sf_dir):
    i, u = F.col("i"), F.col("u")
    return events(spark, sf_dir).select(F.concat(F.lit("group-"), u % 7).alias("group"), F.concat(F.lit("member-"), i % 11).alias("member"), F.concat(F.lit("topic-"), u).alias("topic"))


@query(f"""WITH {MEMBERS}, s AS (SELECT *, row_number() OVER w - 1 AS rank, count(*) OVER (PARTITION BY "group", topic) AS n FROM md WINDOW w AS (PARTITION BY "group", topic ORDER BY member)),
c AS (SELECT "group", member, topic, rank * (partitions // n) + least(rank, partitions % n) AS first, partitions // n + CASE WHEN rank < partitions % n THEN 1 ELSE 0 END AS size FROM s JOIN topics USING (topic))
SELECT "group", member, topic, first + k AS "partition" FROM c, range(5) t(k) WHERE k < size""", log=False)
def q_range_assign(spark, sf_dir):
    return groups.range_assign(member_table(spark, sf_dir), topic_table(spark, sf_dir))


@query(f"""WITH {MEMBERS}, sm AS (SELECT "group", member, row_number() OVER (PARTITION BY "group" ORDER BY member) - 1 AS seat, count(*) OVER (PARTITION BY "group") AS n FROM (SELECT DISTINCT "group", member FROM md)),
pt AS (SELECT "group", topic, p AS "partition", row_number() OVER (PARTITION BY "group" ORDER BY topic, p) - 1 AS i FROM (SELECT DISTINCT "group", topic FROM md) JOIN topics USING (topic), range(5) t(p) WHERE p < partitions)
SELECT pt."group", member, topic, "partition" FROM pt JOIN sm ON sm."group" = pt."group" AND pt.i % n = seat""", log=False)
def q_share_rotation(spark, sf_dir):
    return groups.share_rotation(member_table(spark, sf_dir), topic_table(spark, sf_dir))


@query()
def q_sticky_assign(spark, sf_dir):
    members, topics = member_table(spark, sf_dir), topic_table(spark, sf_dir)
    owned = groups.range_assign(members, topics).where("partition % 2 = 0").select("group", "topic", "partition", "member")
    return groups.sticky_assign(members, topics, owned)


ACKS = f"""ak AS (SELECT 'g' || (u % 3) AS "group", u % 2 AS "partition", i AS seq, i // 2 + i * 7 % 90 AS first, i // 2 + i * 7 % 90 + i % 6 AS last, 1 + i % 7 % 3 AS ack_type FROM {EV}),
ao AS (SELECT *, unnest(range(first, last + 1)) AS "offset" FROM ak WHERE ack_type <> 2),
fs AS (SELECT "group", "partition", "offset", arg_min(ack_type, seq) AS ack_type FROM ao GROUP BY ALL)"""


def acks(spark, sf_dir):
    i, u = F.col("i"), F.col("u")
    first = F.floor(i / 2) + i * 7 % 90
    return events(spark, sf_dir).select(F.concat(F.lit("g"), u % 3).alias("group"), (u % 2).alias("partition"), i.alias("seq"), first.alias("first"), (first + i % 6).alias("last"), (1 + i % 7 % 3).alias("ack_type"))


@query(f"""WITH {ACKS} SELECT "group", "partition", "offset", CASE ack_type WHEN 1 THEN 'accepted' ELSE 'archived' END AS state FROM fs""", log=False)
def q_share_state(spark, sf_dir):
    return groups.share_state(acks(spark, sf_dir))


@query(f"""WITH {ACKS}, ac AS (SELECT "group", "partition", "offset", "offset" - row_number() OVER (PARTITION BY "group", "partition" ORDER BY "offset") AS run FROM fs WHERE ack_type = 1),
ru AS (SELECT "group", "partition", min("offset") AS first, max("offset") AS last FROM ac GROUP BY "group", "partition", run),
cs AS (SELECT DISTINCT "group", "partition", 7::BIGINT AS cursor FROM ak)
SELECT "group", "partition", greatest(cursor, coalesce((SELECT max(last) + 1 FROM ru WHERE ru."group" = cs."group" AND ru."partition" = cs."partition" AND first <= cursor), cursor)) AS cursor FROM cs""", log=False)
def q_share_cursor(spark, sf_dir):
    rows = acks(spark, sf_dir)
    done = groups.share_state(rows).where("state = 'accepted'").select("group", "partition", F.col("offset").alias("first"), F.col("offset").alias("last"))
    return groups.share_cursor(done, rows.select("group", "partition").distinct().withColumn("cursor", F.lit(7).cast("long")))


@query(""", k AS (SELECT "partition", "offset", "offset" - row_number() OVER (PARTITION BY "partition" ORDER BY "offset") AS run FROM log WHERE "offset" >= 20 + "partition" AND "offset" % 9 <> 4)
SELECT "partition", min("offset") AS first, max("offset") AS last, count(*) AS records FROM k GROUP BY "partition", run""")
def q_share_runs(spark, sf_dir):
    log = load(spark, sf_dir).select("partition", "offset")
    cursors = log.select("partition").distinct().withColumn("cursor", 20 + F.col("partition"))
    return groups.share_slice(log, cursors, log.where("offset % 9 = 4"), ["partition"])


@query(f"""WITH d AS (SELECT 'g' || (u % 2) AS "group", u % 3 AS "partition", i * i % 1009 AS first FROM {EV}) SELECT "group", "partition", first, least(count(*), 5) AS deliveries FROM d GROUP BY ALL""", log=False)
def q_delivery_counts(spark, sf_dir):
    i, u = F.col("i"), F.col("u")
    return groups.delivery_counts(events(spark, sf_dir).select(F.concat(F.lit("g"), u % 2).alias("group"), (u % 3).alias("partition"), (i * i % 1009).alias("first")))


@query()
def q_classic_group(spark, sf_dir):
    i = F.col("i")
    kind = F.when(i % 10 < 3, "join").when(i % 10 < 6, "join").when(i % 10 < 9, "sync").otherwise("leave")
    return groups.classic_group(events(spark, sf_dir).select(F.concat(F.lit("group-"), F.floor(i / 20)).alias("group"), i.alias("seq"), kind.alias("kind"), F.concat(F.lit("m-"), i % 3).alias("member")))


@query()
def q_group_heartbeats(spark, sf_dir):
    i = F.col("i")
    epoch = F.when(i % 20 < 3, 0).when(i % 20 == 19, -1).otherwise(F.floor(i % 20 / 5))
    rows = events(spark, sf_dir).select(F.concat(F.lit("group-"), F.floor(i / 20)).alias("group"), i.alias("seq"), F.concat(F.lit("m-"), i % 3).alias("member"), epoch.alias("epoch"), F.when(i % 20 < 3, F.array(F.lit("a"), F.lit("b"))).alias("topics"), F.lit(None).cast("array<string>").alias("owned"))
    return groups.heartbeats(rows, {"a": 4, "b": 2})


@query(f"""WITH RECURSIVE se AS (SELECT 'g' || (i // 80) AS "group", i % 2 AS "partition", i AS seq, i * 4000 AS ts, CASE WHEN i % 3 = 0 THEN 'fetch' WHEN i % 7 = 1 THEN 'reject' WHEN i % 5 = 2 THEN 'release' ELSE 'accept' END AS kind, 'm-' || (i % 2) AS member, unnest(range(i * 3 % 20, i * 3 % 20 + 4)) AS o FROM {EV}),
rn AS (SELECT *, row_number() OVER (PARTITION BY "group", "partition", o ORDER BY seq) AS r FROM se),
fo AS (SELECT "group", "partition", o, r, seq, member, kind = 'fetch' AS told, CASE WHEN kind = 'fetch' THEN member END AS holder, CASE WHEN kind = 'fetch' THEN ts + 30000 END AS until, CASE WHEN kind = 'fetch' THEN 1 ELSE 0 END AS n, false AS done FROM rn WHERE r = 1 UNION ALL
SELECT "group", "partition", o, r, seq, member, told, CASE WHEN told THEN member WHEN own THEN NULL ELSE h END, CASE WHEN told THEN ts + 30000 WHEN own THEN NULL ELSE until END, n + told::INT, done OR (own AND kind <> 'release')
FROM (SELECT *, kind = 'fetch' AND NOT done AND h IS NULL AND n < 5 AS told, kind <> 'fetch' AND NOT done AND coalesce(h = member, false) AS own
FROM (SELECT x.*, f.n, f.done, f.until, CASE WHEN f.until > x.ts THEN f.holder END AS h FROM fo f JOIN rn x ON x."group" = f."group" AND x."partition" = f."partition" AND x.o = f.o AND x.r = f.r + 1)))
SELECT "group", "partition", seq, o AS "offset", member, n AS deliveries FROM fo WHERE told""", log=False)
def q_share_deliveries(spark, sf_dir):
    i = F.col("i")
    kind = F.when(i % 3 == 0, "fetch").when(i % 7 == 1, "reject").when(i % 5 == 2, "release").otherwise("accept")
    return groups.share_deliveries(events(spark, sf_dir).select(F.concat(F.lit("g"), F.floor(i / 80)).alias("group"), (i % 2).alias("partition"), i.alias("seq"), (i * 4000).alias("ts_ms"), kind.alias("kind"), F.concat(F.lit("m-"), i % 2).alias("member"), (i * 3 % 20).alias("first"), (i * 3 % 20 + 3).alias("last")))


# -- indexes, errors, counters ---------------------------------------------------------------------------------------


@query("""SELECT p."partition", p.start, CASE WHEN start < 130 + p."partition" * 10 OR start > hw THEN 1 ELSE 0 END AS error, start >= 130 + p."partition" * 10 AND start < hw AS has_rows
FROM (SELECT DISTINCT user_id % 4 AS "partition", event_id // 3 AS start FROM events) p JOIN marks USING ("partition")""")
def q_fetch_errors(spark, sf_dir):
    marks = kept_marks(spark, sf_dir).withColumn("log_start", 130 + F.col("partition") * 10)
    requests = events(spark, sf_dir).select((F.col("u") % 4).alias("partition"), F.floor(F.col("i") / 3).alias("start")).distinct()
    return scan.fetch_status(marks, requests)


BS = """, bs AS (SELECT *, batch // 12 AS segment FROM bt),
bp AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY "partition", segment ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM bs)"""


@query(BS + """ SELECT "partition", segment, base_offset, position FROM (SELECT *, lag(position // 1024) OVER (PARTITION BY "partition", segment ORDER BY base_offset) AS b FROM bp) WHERE b IS NULL OR b < position // 1024""")
def q_offset_index(spark, sf_dir):
    rows = scan.batches(load(spark, sf_dir)).withColumn("segment", F.floor(F.col("batch") / 12))
    return scan.offset_index(rows, 1024)


@query("""SELECT "partition", base_offset, max_ts FROM (SELECT *, max(max_ts) OVER (PARTITION BY "partition" ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM bt) WHERE b IS NULL OR max_ts > b""")
def q_time_index(spark, sf_dir):
    return scan.time_index(scan.batches(load(spark, sf_dir)))


@query("""SELECT connection, count(*) AS messages, sum(bytes)::BIGINT AS bytes FROM (SELECT user_id AS connection, user_id % 4 AS "partition", event_id // 4 AS start FROM events) r
JOIN log ON log."partition" = r."partition" AND "offset" BETWEEN start AND start + 4 AND NOT is_control GROUP BY ALL""")
def q_consumed(spark, sf_dir):
    requests = events(spark, sf_dir).select(F.col("u").alias("connection"), (F.col("u") % 4).alias("partition"), F.floor(F.col("i") / 4).alias("start"), F.lit(5).alias("records"))
    return scan.consumed(load(spark, sf_dir), requests)


@query("""SELECT "partition", epoch, start FROM (SELECT *, count(*) OVER (PARTITION BY "partition") AS n, row_number() OVER (PARTITION BY "partition" ORDER BY epoch) AS place
FROM (SELECT "partition", win AS epoch, min("offset") AS start FROM log GROUP BY ALL)) WHERE place > CASE WHEN n > 10 THEN 5 * ((n - 11) // 5 + 1) ELSE 0 END""")
def q_epoch_trim(spark, sf_dir):
    epochs = load(spark, sf_dir).groupBy("partition", F.col("win").alias("epoch")).agg(F.min("offset").alias("start"))
    return watermarks.trimmed_epochs(epochs, 10, 5).select("partition", "epoch", "start")


# -- requests and limits ---------------------------------------------------------------------------------------------


@query(f"""SELECT i, CASE WHEN i % 7 - 3 NOT IN (-1, 0, 1) THEN 21 WHEN i % 11 = 4 THEN 3 WHEN u % 5 = 3 THEN 29 WHEN u % 17 = 1 THEN 56 WHEN i % 7 - 3 = -1 AND i % 4 = 0 THEN 19 ELSE 0 END AS error FROM {EV}""", log=False)
def q_produce_status(spark, sf_dir):
    i, u = F.col("i"), F.col("u")
    rows = events(spark, sf_dir).select("i", (i % 7 - 3).alias("acks"), (i % 11 != 4).alias("known"), (u % 5 != 3).alias("allowed"), (u % 17 == 1).alias("read_only"), (i % 4 != 0).alias("enough_replicas"))
    return append.produce_status(rows).select("i", "error")


@query(f"""SELECT i, CASE WHEN n > 8388608 THEN 16777216 ELSE greatest(4096, CASE WHEN n <= 1 THEN 1 ELSE 2 ** ceil(log2(n)) END) END::BIGINT AS class FROM (SELECT i, i * 997 % 30000000 AS n FROM {EV})""", log=False)
def q_buffer_class(spark, sf_dir):
    return events(spark, sf_dir).select("i", checks.buffer_class(F.col("i") * 997 % 30000000).alias("class"))


@query(f"""SELECT u AS connection, i AS seq, max(ts + i * 37 % 5000) OVER (PARTITION BY u ORDER BY i) AS sent_ms FROM (SELECT event_id AS i, user_id AS u, epoch_us(ts) // 1000 AS ts FROM events)""", log=False)
def q_response_order(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    done = ev.select(F.col("user_id").alias("connection"), F.col("event_id").alias("seq"), (F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") * 37 % 5000).alias("done_ms"))
    return cluster.in_request_order(done)


@query(f"""SELECT 'f' || i AS field, v AS version FROM {US}, range(10) t(v) WHERE v BETWEEN i % 5 AND i % 5 + i % 7 AND NOT i % 4 = 0""", log=False)
def q_version_fields(spark, sf_dir):
    i = F.col("i")
    fields = users(spark, sf_dir).select(F.concat(F.lit("f"), i).alias("field"), (i % 5).alias("first_version"), (i % 5 + i % 7).alias("last_version"), (i % 4 == 0).alias("tagged"))
    return cluster.fields_of_versions(fields, 0, 9)


@query("""SELECT "partition", segment, recorded = bytes AND coalesce(before + 1 = base, true) AS trusted FROM (SELECT *, bytes + CASE WHEN segment % 5 = 2 THEN 1 ELSE 0 END AS recorded, lag(last_offset) OVER (PARTITION BY "partition" ORDER BY base) AS before FROM seg)""")
def q_checkpoint_skip(spark, sf_dir):
    rows = scan.segments(load(spark, sf_dir), 12).withColumn("recorded_bytes", F.col("bytes") + F.when(F.col("segment") % 5 == 2, 1).otherwise(0))
    return append.trusted_segments(rows).select("partition", "segment", "trusted")


@query("""SELECT "partition", segment, "partition" || '/' || lpad(base::VARCHAR, 20, '0') || '-' || 7 AS key, bytes FROM sg WHERE sealed AND segment % 3 <> 0""")
def q_tier_uploads(spark, sf_dir):
    rows = segment_table(load(spark, sf_dir))
    return retention.tier_uploads(rows, rows.where("segment % 3 = 0").select("partition", "base"), 7)


@query("""SELECT o."partition", o.producer_id, o.first_offset, CASE WHEN o."partition" % 3 = 1 THEN 'local' ELSE 'remote' END AS route FROM opn o""")
def q_marker_routes(spark, sf_dir):
    log = load(spark, sf_dir)
    leaders = log.select("partition").distinct().withColumn("leader", F.col("partition") % 3)
    return cluster.marker_routes(watermarks.open_transactions(log), leaders, 1).select("partition", "producer_id", "first_offset", "route")


# -- the binary format -----------------------------------------------------------------------------------------------


def encoded(spark, sf_dir):
    """Every batch of the log in the binary format, each kind of compression in turn."""
    return recordbatch.encode_rows(load(spark, sf_dir), F.pmod(F.coalesce("batch", F.lit(0)), F.lit(5)))


@query('SELECT "partition", "offset", ts_ms, key, value, producer_id, producer_epoch, is_txn, is_control, control_type FROM log')
def q_codec_records(spark, sf_dir):
    rows = recordbatch.explode_records(encoded(spark, sf_dir), ["partition"])
    text = lambda c: F.when(~F.col("is_control"), F.decode(F.col(c), "UTF-8")).alias(c)
    return rows.select("partition", "offset", "ts_ms", text("key"), text("value"), "producer_id", F.col("producer_epoch").cast("long").alias("producer_epoch"), "is_txn", "is_control", "control_type")


@query("""SELECT "partition", min("offset") AS base_offset, (max("offset") - min("offset"))::INT AS last_offset_delta, count(*)::INT AS record_count, min(ts_ms) AS first_timestamp, max(ts_ms) AS max_timestamp,
any_value(producer_id) AS producer_id, (CASE WHEN is_control THEN 0 ELSE batch % 5 END)::INT AS compression, any_value(is_txn) AS is_txn, is_control, true AS crc_ok
FROM log GROUP BY "partition", batch, is_control, CASE WHEN is_control THEN "offset" END""")
def q_codec_headers(spark, sf_dir):
    rows = recordbatch.read_headers(encoded(spark, sf_dir), ["partition"])
    a = F.col("attributes")
    return rows.select("partition", "base_offset", "last_offset_delta", "record_count", "first_timestamp", "max_timestamp", "producer_id", checks.compression(a).cast("int").alias("compression"), checks.is_transactional(a).alias("is_txn"), checks.is_control(a).alias("is_control"), "crc_ok")


@query("""SELECT "partition", count(*) AS batches, max(e) AS end_offset FROM (SELECT "partition", min("offset") AS b, max("offset") + 1 AS e FROM log GROUP BY "partition", batch, is_control, CASE WHEN is_control THEN "offset" END)
WHERE b < 150 + "partition" * 20 GROUP BY ALL""")
def q_codec_recovery(spark, sf_dir):
    """Of each partition's batches those before the first broken one: here the first from an offset on has a bit turned."""
    torn = F.col("base_offset") >= 150 + F.col("partition") * 20
    data = F.when(torn, F.concat(F.expr("substring(data, 1, 70)"), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.expr("substring(data, 71, 1)")), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0")), F.expr("substring(data, 72, 1000000)"))).otherwise(F.col("data"))
    broken = encoded(spark, sf_dir).withColumn("data", data)
    rows = recordbatch.read_headers(broken, ["partition"]).withColumn("path", F.col("partition").cast("string")).withColumn("position", F.col("base_offset"))
    kept = recordbatch.recovered(rows)
    return kept.groupBy("partition").agg(F.count("*").alias("batches"), F.max(F.col("base_offset") + F.col("last_offset_delta") + 1).alias("end_offset"))


CRC32C = """tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: xor(c >> 1, (CASE WHEN c % 2 = 1 THEN 2197175160 ELSE 0 END)), i) AS c FROM range(256) x(i))),
bv AS (SELECT event_id, list_transform(range(strlen(props)), lambda k: ('0x' || substr(hex(encode(props)), 2 * k + 1, 2))::BIGINT) AS b FROM events)"""


@query(f"""WITH {CRC32C} SELECT event_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS crc FROM bv, tb""", log=False)
def q_crc32c(spark, sf_dir):
    return checks.with_crc32c(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props"), "props", "crc").select("event_id", "crc")


@query(f"""SELECT i, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS zigzag, v AS back, greatest(1, ceil(bit_length(bin(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END)) / 8 / 7))::INT AS size FROM (SELECT i, i * (CASE WHEN i % 2 = 0 THEN 7919 ELSE -104729 END) AS v FROM {EV})""", log=False)
def q_varints(spark, sf_dir):
    i = F.col("i")
    rows = events(spark, sf_dir).select("i", (i * F.when(i % 2 == 0, 7919).otherwise(-104729)).cast("long").alias("v"))
    z = checks.zigzag(F.col("v"))
    return rows.select("i", z.alias("zigzag"), checks.unzigzag(z).alias("back"), checks.varint_size(z).alias("size"))


@query(f"""SELECT i, ((u % 256) << 40) | i AS producer_id, substr(sha256('topic-' || u || chr(0) || i), 1, 32) AS topic_id FROM {EV}""", log=False)
def q_identifiers(spark, sf_dir):
    return events(spark, sf_dir).select("i", checks.producer_id(F.col("u"), F.col("i")).alias("producer_id"), checks.topic_id(F.concat(F.lit("topic-"), F.col("u")), F.col("i")).alias("topic_id"))


@query(f"""SELECT count(DISTINCT m) AS kinds FROM (SELECT "group", string_agg(member, ',' ORDER BY member) AS m FROM (SELECT DISTINCT i // 5 AS "group", 'm-' || (i % 5 * (i // 5) % 7) AS member FROM {EV}) GROUP BY ALL)""", log=False)
def q_membership_kinds(spark, sf_dir):
    i = F.col("i")
    members = events(spark, sf_dir).select(F.floor(i / 5).alias("group"), F.concat(F.lit("m-"), i % 5 * F.floor(i / 5) % 7).alias("member"))
    return groups.membership(members).agg(F.count_distinct("signature").alias("kinds"))


# -- access ---------------------------------------------------------------------------------------------------------

ACLS = f"""al AS (SELECT i, 2 AS resource_type, CASE i % 4 WHEN 0 THEN '*' WHEN 1 THEN 'topic-1' ELSE 'topic-' || i % 6 END AS resource_name, CASE WHEN i % 4 = 1 THEN 4 ELSE 3 END AS pattern_type, 'User:' || CASE WHEN i % 5 = 0 THEN '*' ELSE 'u' || i % 4 END AS principal,
CASE WHEN i % 6 = 0 THEN 2 ELSE 3 + i % 3 END AS operation, CASE WHEN i % 9 = 2 THEN 2 ELSE 3 END AS permission, CASE WHEN i = 7 THEN 'host' ELSE '*' END AS host FROM {US}),
rq AS (SELECT DISTINCT 'User:u' || u % 5 AS principal, 2 AS resource_type, 'topic-' || u AS resource_name, 3 + i % 3 AS operation FROM {EV})"""


def acl_table(spark, sf_dir):
    i = F.col("i")
    name = F.when(i % 4 == 0, "*").when(i % 4 == 1, "topic-1").otherwise(F.concat(F.lit("topic-"), i % 6))
    return users(spark, sf_dir).select(F.lit(2).alias("resource_type"), name.alias("resource_name"), F.when(i % 4 == 1, 4).otherwise(3).alias("pattern_type"), F.concat(F.lit("User:"), F.when(i % 5 == 0, "*").otherwise(F.concat(F.lit("u"), i % 4))).alias("principal"), F.when(i % 6 == 0, 2).otherwise(3 + i % 3).alias("operation"), F.when(i % 9 == 2, 2).otherwise(3).alias("permission"), F.when(i == 7, "host").otherwise("*").alias("host"))


@query(f"""WITH {ACLS} SELECT r.principal, r.resource_name, r.operation, r.principal = 'User:u4' OR (coalesce(bool_or(permission = 3), false) AND NOT coalesce(bool_or(permission = 2), false)) AS allowed
FROM rq r LEFT JOIN al ON al.host = '*' AND (al.principal = 'User:*' OR al.principal = r.principal) AND (al.operation = 2 OR al.operation = r.operation) AND ((pattern_type = 3 AND al.resource_name IN ('*', r.resource_name)) OR (pattern_type = 4 AND starts_with(r.resource_name, al.resource_name)))
GROUP BY r.principal, r.resource_name, r.operation""", log=False)
def q_acl_decision(spark, sf_dir):
    asked = events(spark, sf_dir).select(F.concat(F.lit("User:u"), F.col("u") % 5).alias("principal"), F.lit(2).alias("resource_type"), F.concat(F.lit("topic-"), F.col("u")).alias("resource_name"), (3 + F.col("i") % 3).alias("operation")).distinct()
    return security.decide(asked, acl_table(spark, sf_dir), ["User:u4"]).select("principal", "resource_name", "operation", "allowed")


@query(f"WITH {ACLS} SELECT resource_type, resource_name, pattern_type, count(*) AS entries, min(principal) AS first_principal FROM al WHERE resource_type = 2 GROUP BY ALL", log=False)
def q_acl_describe(spark, sf_dir):
    return security.describe(acl_table(spark, sf_dir), resource_type=2)


@query(f"SELECT name, name IS NOT NULL AND length(name) BETWEEN 1 AND 249 AND name NOT IN ('.', '..') AND regexp_full_match(name, '[A-Za-z0-9._-]+') AS valid FROM (SELECT CASE i % 6 WHEN 0 THEN 'topic-' || i WHEN 1 THEN '.' WHEN 2 THEN 'a b' WHEN 3 THEN repeat('x', (240 + i % 20)::INT) WHEN 4 THEN '' ELSE 'ü' || i END AS name FROM {EV})", log=False)
def q_topic_names(spark, sf_dir):
    i = F.col("i")
    name = F.when(i % 6 == 0, F.concat(F.lit("topic-"), i)).when(i % 6 == 1, ".").when(i % 6 == 2, "a b").when(i % 6 == 3, F.expr("repeat('x', cast(240 + i % 20 as int))")).when(i % 6 == 4, "").otherwise(F.concat(F.lit("ü"), i))
    return events(spark, sf_dir).select(name.alias("name")).withColumn("valid", security.valid_topic(F.col("name")))


@query("""WITH RECURSIVE rq AS (SELECT user_id AS u, event_id AS seq, epoch_us(ts) // 1000 AS ts, trunc(value * 10)::BIGINT AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
fo AS (SELECT u, seq, ts, r, 50.0::DOUBLE - b AS level FROM rq WHERE r = 1 UNION ALL
SELECT n.u, n.seq, n.ts, n.r, least(100.0::DOUBLE, f.level + 50.0::DOUBLE * greatest(0, n.ts - f.ts) / 1000) - n.b FROM fo f JOIN rq n ON n.u = f.u AND n.r = f.r + 1)
SELECT u AS "user", seq, greatest(0, round_even(-level / 50.0 * 1000, 0))::BIGINT AS delay_ms FROM fo""", log=False)
def q_quota_delay(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return security.bucket_delays(ev.select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("value") * 10).cast("long").alias("bytes")), 50.0)


# -- decisions of a node ---------------------------------------------------------------------------------------------


@query("""SELECT i AS request, CASE WHEN late THEN asked + wait ELSE greatest(asked, ready) END AS sent_ms, late AS timed_out FROM
(SELECT q.*, l.ts_ms AS ready, coalesce(l.ts_ms > asked + wait, true) AS late FROM
(SELECT event_id AS i, user_id % 4 AS "partition", event_id // 4 + 5 AS "offset", epoch_us(ts) // 1000 - 400 AS asked, 250 * (event_id % 5) AS wait FROM events) q LEFT JOIN log l USING ("partition", "offset"))""")
def q_long_poll(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    asked = F.unix_millis(F.col("ts").cast("timestamp")) - 400
    requests = ev.select(i.alias("request"), (F.col("user_id") % 4).alias("partition"), (F.floor(i / 4) + 5).alias("offset"), asked.alias("asked_ms"), (i % 5 * 250).alias("wait_ms"))
    ready = load(spark, sf_dir).select("partition", "offset", F.col("ts_ms").alias("ready_ms"))
    return control.long_polls(requests, ready).select("request", "sent_ms", "timed_out")


@query(f"""SELECT i, step, CASE step WHEN 'truncate' THEN lead WHEN 'retry' THEN leo WHEN 'append' THEN base + i % 10 + 1 ELSE nxt END AS then_offset FROM
(SELECT *, CASE WHEN i % 29 = 0 THEN 'stop' WHEN i % 31 = 0 OR i % 13 = 0 THEN 'wait' WHEN lead < nxt THEN 'truncate' WHEN base IS NULL THEN 'poll' WHEN base <> leo THEN 'retry' ELSE 'append' END AS step FROM
(SELECT i, i // 4 AS nxt, i // 4 - (i % 7 = 0)::INT AS leo, i // 4 + u % 5 - 1 AS lead, CASE WHEN i % 3 <> 0 THEN i // 4 END AS base FROM {EV}))""", log=False)
def q_pull_steps(spark, sf_dir):
    i, at = F.col("i"), F.floor(F.col("i") / 4)
    came = i % 3 != 0
    pulls = events(spark, sf_dir).select(
        "i", at.alias("next_offset"), (at - (i % 7 == 0).cast("long")).alias("local_leo"), (i % 29 == 0).alias("blocked"), (i % 31 == 0).alias("failed"),
        F.when(i % 13 == 0, 6).otherwise(0).alias("error"), (at + F.col("u") % 5 - 1).alias("leader_next"), F.when(came, at).alias("base"), F.when(came, at + i % 10).alias("last"),
    )
    return control.pull_steps(pulls).select("i", "step", "then_offset")


@query(f"""SELECT topic, "partition", step, CASE WHEN step IN ('start', 'update') THEN CASE WHEN nl = 1 THEN 'leader' ELSE 'follower' END END AS role,
coalesce(step = 'update' AND nl = 1 AND ne > oe, false) AS reconcile,
CASE WHEN step NOT IN ('start', 'update') THEN 'none' WHEN nl = 1 THEN CASE step WHEN 'start' THEN 'none' ELSE 'stop' END WHEN step = 'start' THEN CASE WHEN nl <> 4 THEN 'start' ELSE 'none' END
WHEN nl <> 4 AND (ol IS NULL OR ol <> nl OR nl = 2 OR ol = 1) THEN 'restart' ELSE 'keep' END AS pull
FROM (SELECT *, CASE WHEN coalesce(had, false) AND has IS NULL THEN 'drop' WHEN has AND NOT coalesce(had, false) THEN 'start' WHEN has THEN 'update' ELSE 'none' END AS step FROM
(SELECT 't' || i AS topic, u % 4 AS "partition", CASE WHEN i % 13 <> 0 THEN list_contains([u % 5 + 1, (u + 1) % 5 + 1, (u + 2) % 5 + 1], 1) END AS had, CASE WHEN i % 13 <> 0 THEN u % 5 + 1 END AS ol, CASE WHEN i % 13 <> 0 THEN 1 END AS oe,
CASE WHEN i % 11 <> 0 THEN list_contains([(u + i % 3) % 5 + 1, (u + i % 3 + 1) % 5 + 1, (u + i % 3 + 2) % 5 + 1], 1) END AS has, CASE WHEN i % 11 <> 0 THEN (u + i % 3) % 5 + 1 END AS nl, CASE WHEN i % 11 <> 0 THEN 1 + i % 2 END AS ne
FROM {EV} WHERE i % 11 <> 0 OR i % 13 <> 0))""", log=False)
def q_image_steps(spark, sf_dir):
    def image(rows, first, epoch):
        replicas = F.array(*[((first + k) % 5 + 1).cast("int") for k in range(3)])
        return rows.select(F.concat(F.lit("t"), "i").alias("topic"), (F.col("u") % 4).alias("partition"), replicas.alias("replicas"), F.get(replicas, F.lit(0)).alias("leader"), epoch.cast("long").alias("epoch"))

    ev, i, u = events(spark, sf_dir), F.col("i"), F.col("u")
    nodes = spark.range(1, 6).select(F.col("id").cast("int").alias("node"), F.concat(F.lit("h"), "id").alias("address"))
    moved = nodes.where("node <> 4").withColumn("address", F.when(F.col("node") == 2, "elsewhere").otherwise(F.col("address")))
    return control.image_steps(image(ev.where(i % 13 != 0), u, F.lit(1)), image(ev.where(i % 11 != 0), u + i % 3, 1 + i % 2), nodes, moved, 1)


@query(f"SELECT i, i % 3 <> 0 OR u % 40 IN (17, 18, 36) AS admitted FROM {EV}", log=False)
def q_admitted(spark, sf_dir):
    requests = events(spark, sf_dir).select("i", (F.col("u") % 40).alias("api_key"), F.when(F.col("i") % 3 != 0, F.col("u").cast("string")).alias("user"))
    return control.admitted(requests).select("i", "admitted")


@query("""WITH RECURSIVE rq AS (SELECT user_id AS u, event_id AS seq, epoch_us(ts) // 10000000 AS ts, trunc(value * 10)::BIGINT AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
fo AS (SELECT u, seq, r, ts AS start, CASE WHEN b <= 5000 THEN b ELSE 0 END AS used, CASE WHEN b <= 5000 THEN 0 ELSE greatest(1, (b - 5000) * 1000 // 5000) END AS delay_ms FROM rq WHERE r = 1 UNION ALL
SELECT n.u, n.seq, n.r, CASE WHEN n.ts - f.start >= 1000 THEN n.ts ELSE f.start END, CASE WHEN n.ts - f.start >= 1000 THEN 0 WHEN f.used + n.b <= 5000 THEN f.used + n.b ELSE f.used END,
CASE WHEN n.ts - f.start >= 1000 OR f.used + n.b <= 5000 THEN 0 ELSE greatest(1, (f.used + n.b - 5000) * 1000 // 5000) END FROM fo f JOIN rq n ON n.u = f.u AND n.r = f.r + 1)
SELECT u AS store, seq, delay_ms FROM fo""", log=False)
def q_upload_delays(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 10000)
    return control.upload_delays(ev.select(F.col("user_id").alias("store"), F.col("event_id").alias("seq"), at.alias("at_ms"), (F.col("value") * 10).cast("long").alias("bytes")), 5000)


@query(f"SELECT 'user-' || i AS \"user\", substr(sha256('user-' || i), 1, 32) AS salt, i % 4 NOT IN (0, 1) AS accepted FROM {US}", log=False)
def q_logins(spark, sf_dir):
    i = F.col("i")
    word = F.concat(F.lit("secret "), i)
    attempts = users(spark, sf_dir).select(F.concat(F.lit("user-"), i).alias("user"), F.when(i % 4 != 0, word).alias("password"), F.when(i % 4 == 1, "guess").otherwise(word).alias("offered"))
    return scram.logins(attempts)


@query("""SELECT event_id // 1000 AS segment, kind, event_id // 500 + 1 AS term, CASE kind WHEN 1 THEN 0 ELSE event_id END AS "index", CASE kind WHEN 1 THEN user_id END AS vote,
CASE kind WHEN 1 THEN event_id - 1 END AS "commit", CASE kind WHEN 2 THEN props END AS payload FROM (SELECT *, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 2 END AS kind FROM events WHERE event_id > 0)""", log=False)
def q_control_log(spark, sf_dir):
    i = F.col("event_id")
    entries = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id > 0").select(
        F.floor(i / 1000).alias("segment"), i.alias("seq"), F.when(i % 10 == 0, 1).otherwise(2).alias("kind"), (F.floor(i / 500) + 1).alias("term"), i.alias("index"),
        F.col("user_id").alias("vote"), (i - 1).alias("commit"), F.encode("props", "UTF-8").alias("payload"),
    )
    return controllog.replay(controllog.write_segments(entries)).withColumn("payload", F.decode("payload", "UTF-8"))


@query(f"""SELECT i AS version, 'topic-' || u AS topic, k::INT AS "partition", (u % 5)::INT AS leader, (i % 100)::INT AS epoch, i % 2 = 0 AS tiered, CASE WHEN i % 3 = 0 THEN i * 1000 END AS retention_ms,
CASE WHEN i % 4 = 0 THEN u END AS retention_bytes, 'höst-' || u AS host, (9000 + u % 1000)::INT AS port FROM {EV}, unnest(range(1 + i % 3)) AS t(k)""", log=False)
def q_image_codec(spark, sf_dir):
    images = events(spark, sf_dir).selectExpr(
        "i AS version",
        "array(named_struct('node', cast(u % 5 AS int), 'host', concat('höst-', u), 'port', cast(9000 + u % 1000 AS int))) AS nodes",
        "transform(sequence(0, cast(i % 3 AS int)), k -> named_struct('topic', concat('topic-', u), 'partition', k, 'replicas', array(cast(u % 5 AS int), 7), 'leader', cast(u % 5 AS int), 'epoch', cast(i % 100 AS int), "
        "'tiered', i % 2 = 0, 'retention_ms', if(i % 3 = 0, i * 1000, null), 'retention_bytes', if(i % 4 = 0, u, null))) AS assignments",
    )
    rows = controllog.read_images(controllog.write_images(images)).select("version", F.explode("assignments").alias("a"), F.get("nodes", F.lit(0)).alias("n"))
    return rows.select("version", "a.topic", "a.partition", "a.leader", "a.epoch", "a.tiered", "a.retention_ms", "a.retention_bytes", "n.host", "n.port")


# -- invariants: each must return no row ------------------------------------------------------------------------------


@query('SELECT "partition", \'lso_above_hw\' AS broken FROM marks WHERE lso > hw OR hw > leo')
def inv_marks_ordered(spark, sf_dir):
    return watermarks.watermarks(load(spark, sf_dir)).where("lso > hw OR hw > leo OR log_start > lso").select("partition", F.lit("lso_above_hw").alias("broken"))


@query('SELECT s."partition", s."offset" FROM seen s JOIN bad b ON b."partition" = s."partition" AND b.producer_id = s.producer_id AND b.producer_epoch = s.producer_epoch')
def inv_no_aborted_visible(spark, sf_dir):
    log = load(spark, sf_dir)
    bad = transactions.aborted_ranges(log).select("partition", "producer_id", "producer_epoch")
    return scan.read_committed(log).join(bad, ["partition", "producer_id", "producer_epoch"]).select("partition", "offset")


@query('SELECT "partition", producer_id, producer_epoch FROM log WHERE is_control GROUP BY ALL HAVING count(*) > 1')
def inv_one_marker(spark, sf_dir):
    keys = ["partition", "producer_id", "producer_epoch"]
    return load(spark, sf_dir).where("is_control").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
