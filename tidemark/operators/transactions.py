"""Transactions as data: ranges between markers, fences, and the coordinator's log folded to its last state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INIT, BEGIN, PREPARE, COMPLETE, PENDING = 1, 2, 3, 4, 5
COMMIT, ABORT = 1, 2


def transaction_ranges(log: DataFrame) -> DataFrame:
    """Every transaction of a partition: its data's range, rows and outcome (null: open)."""
    key = ["partition", "producer_id", "producer_epoch"]
    txn = log.where("is_txn")
    outcome = F.max(F.when(F.col("is_control"), F.col("control_type")))
    data = ~F.col("is_control")
    return txn.groupBy(*key).agg(F.min(F.when(data, F.col("offset"))).alias("first_offset"), F.max(F.when(data, F.col("offset"))).alias("last_offset"), F.count(F.when(data, 1)).alias("records"), outcome.alias("control_type"))


def aborted_ranges(log: DataFrame) -> DataFrame:
    return transaction_ranges(log).where("control_type = 0 AND first_offset IS NOT NULL").select("partition", "producer_id", "producer_epoch", "first_offset", "last_offset")


def producer_state(log: DataFrame) -> DataFrame:
    """What recovery harvests for each producer: last epoch, whether a transaction is open, last marker."""
    key = ["partition", "producer_id"]
    newest = F.max("producer_epoch").alias("last_epoch")
    marker = F.max(F.when(F.col("is_control"), F.col("offset")))
    data = F.max(F.when(~F.col("is_control"), F.col("offset")))
    kind = F.max_by("control_type", F.when(F.col("is_control"), F.col("offset")))
    found = log.where("is_txn").groupBy(*key).agg(newest, marker.alias("last_marker"), kind.alias("last_control_type"), data.alias("_data"))
    return found.select(*key, "last_epoch", (F.col("_data") > F.coalesce("last_marker", F.lit(-1))).alias("is_open"), F.coalesce("last_marker", F.lit(-1)).cast("long").alias("last_marker"), F.coalesce("last_control_type", F.lit(-1)).cast("int").alias("last_control_type"))


def fenced(writes: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds ``rejected``: a transactional write of an epoch below the producer's newest marker epoch, or while a
    marker is in flight.  ``fences``: partition, producer_id, marker_epoch, in_flight."""
    joined = writes.join(fences, ["partition", "producer_id"], "left")
    bad = F.coalesce((F.col("marker_epoch") > F.col("producer_epoch")) | F.col("in_flight"), F.lit(False))
    return joined.withColumn("rejected", F.col("is_txn") & bad).drop("marker_epoch", "in_flight")


def coordinator_state(txn_log: DataFrame) -> DataFrame:
    """The last state of each transactional id, and what a new coordinator does about it.

    ``txn_log``: seq, kind, txn_id, pid, epoch, outcome.  States follow the last record; an init keeps pid and epoch.
    """
    order = F.col("seq")
    folded = txn_log.groupBy("txn_id").agg(
        F.max_by("kind", F.when(F.col("kind") != PENDING, order)).alias("kind"),
        F.max_by("outcome", F.when(F.col("outcome").isNotNull(), order)).alias("outcome"),
        F.max_by("pid", F.when(F.col("pid").isNotNull(), order)).alias("pid"),
        F.max_by("epoch", F.when(F.col("epoch").isNotNull(), order)).alias("epoch"),
    )
    done = F.col("outcome") == COMMIT
    state = F.when(F.col("kind") == INIT, "Empty").when(F.col("kind") == BEGIN, "Ongoing").when(F.col("kind") == PREPARE, F.when(done, "PrepareCommit").otherwise("PrepareAbort")).otherwise(F.when(done, "CompleteCommit").otherwise("CompleteAbort"))
    named = folded.withColumn("state", state)
    return named.select("txn_id", "pid", "epoch", "state", takeover(F.col("state")).alias("takeover"))


def takeover(state):
    """Finished transactions are ready, prepared ones are replayed, running ones are aborted."""
    return F.when(state.startswith("Prepare"), "replay").when(state == "Ongoing", "abort").otherwise("ready")


def list_transactions(states: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids in order; an empty list of states means all."""
    rows = states.where(F.col("state").isin(wanted)) if wanted else states
    return rows.select("txn_id", "pid", "state").orderBy("txn_id")


def marker_effects(markers: DataFrame) -> DataFrame:
    """What each marker does, in order of ``seq``: applied, repeated (same outcome again), conflicting (another
    outcome for a transaction that is over) or stale (an older epoch).  ``markers``: partition, producer_id, seq,
    epoch, outcome, reopened (data came since the last marker)."""
    order = Window.partitionBy("partition", "producer_id").orderBy("seq")
    newest = F.max("epoch").over(order.rowsBetween(Window.unboundedPreceding, -1))
    last = F.last("outcome").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = F.when(newest.isNull() | (F.col("epoch") > newest), "applied").when(F.col("epoch") < newest, "stale").when(F.col("reopened"), "applied").when(F.col("outcome") == last, "repeated").otherwise("conflicting")
    return markers.withColumn("effect", told)


def promoted_offsets(pending: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Offsets sent inside transactions that committed, the last one for each (group, topic, partition).

    ``pending``: txn_id, seq, group, topic, partition, offset; ``outcomes``: txn_id, outcome.
    """
    good = pending.join(outcomes.where(F.col("outcome") == COMMIT).select("txn_id"), "txn_id", "left_semi")
    return good.groupBy("group", "topic", "partition").agg(F.max_by("offset", "seq").alias("offset"))
