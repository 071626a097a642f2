"""Consumer groups: assignors, rotation, and what share groups acknowledge."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_assign(members: DataFrame, topics: DataFrame, compat: bool = False) -> DataFrame:
    """Contiguous chunks of each topic's partitions, the remainder to the first members.

    ``members``: group, member, topic; ``topics``: topic, partitions.  Chunks are sized by the topic's subscribers;
    with ``compat`` by all members of the group, so chunks of others stay unassigned.
    """
    every = members.select("group", "member").distinct()
    if compat:
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy("member")) - 1)
        sizes = every.groupBy("group").agg(F.count("*").alias("n"))
        seats = members.select("group", "member", "topic").distinct().join(ranked, ["group", "member"]).join(sizes, "group")
    else:
        seats = members.select("group", "member", "topic").distinct()
        own = Window.partitionBy("group", "topic")
        seats = seats.withColumn("rank", F.row_number().over(own.orderBy("member")) - 1).withColumn("n", F.count("*").over(own))
    joined = seats.join(topics, "topic")
    size, more = F.floor(F.col("partitions") / F.col("n")), F.col("partitions") % F.col("n")
    first = F.col("rank") * size + F.least(F.col("rank").cast("long"), more.cast("long"))
    count = size + F.when(F.col("rank") < more, 1).otherwise(0)
    return joined.withColumn("first", first).withColumn("size", count).where("size > 0").select("group", "member", "topic", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("partition"))


def sticky(members: list[str], wanted: dict[str, list[str]], partitions: list[tuple[str, int]], owned: dict[tuple[str, int], str]) -> dict[tuple[str, int], str]:
    """Owners keep what they had up to their quota; the rest goes to subscribers with the least, in turn."""
    members = sorted(members)
    open_to = {p: [m for m in members if p[0] in wanted[m]] for p in sorted(partitions)}
    quota = -(-len(partitions) // len(members)) if members else 0
    load, out = dict.fromkeys(members, 0), {}
    for p, who in open_to.items():
        old = owned.get(p)
        if old in who and load[old] < quota:
            out[p], load[old] = old, load[old] + 1
    for p, who in open_to.items():
        if p not in out and who:
            free = [m for m in who if load[m] < quota] or who  # a subscription goes before the quota
            best = min(free, key=lambda m: (load[m], m))
            out[p], load[best] = best, load[best] + 1
    return out


def sticky_assign(members: DataFrame, topics: DataFrame, owned: DataFrame) -> DataFrame:
    """Sticky assignment per group.  ``members``: group, member, topic; ``owned``: group, topic, partition, member.
    A group's state is its members and partitions, which the group itself bounds."""
    want = members.join(topics, "topic").select("group", "member", "topic", "partitions")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        wanted = left.groupby("member").topic.apply(set).to_dict()
        parts = [(t, i) for t, n in left[["topic", "partitions"]].drop_duplicates().itertuples(index=False) for i in range(int(n))]
        had = {(r.had_topic, int(r.had_partition)): r.had_member for r in right.itertuples()}
        got = sticky(list(wanted), wanted, parts, had)
        return pd.DataFrame([(key[0], m, t, p) for (t, p), m in sorted(got.items())], columns=["group", "member", "topic", "partition"])

    had = owned.toDF(*[f"had_{c}" for c in owned.columns])  # both sides may come from one table
    return want.groupBy("group").cogroup(had.groupBy("had_group")).applyInPandas(run, "group string, member string, topic string, partition long")


def share_rotation(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Of the group's subscribed partitions in order the i-th goes to member i mod n."""
    ranked = members.select("group", "member").distinct().withColumn("seat", F.row_number().over(Window.partitionBy("group").orderBy("member")) - 1)
    sizes = ranked.groupBy("group").agg(F.count("*").alias("n"))
    parts = members.select("group", "topic").distinct().join(topics, "topic").where("partitions > 0")
    parts = parts.select("group", "topic", F.explode(F.sequence(F.lit(0), F.col("partitions").cast("int") - 1)).alias("partition"))
    parts = parts.withColumn("i", F.row_number().over(Window.partitionBy("group").orderBy("topic", "partition")) - 1).join(sizes, "group")
    return parts.withColumn("seat", F.col("i") % F.col("n")).join(ranked, ["group", "seat"]).select("group", "member", "topic", F.col("partition").cast("long").alias("partition"))


def share_state(events: DataFrame) -> DataFrame:
    """The first terminal outcome of every offset: accepted or archived (rejected); released offsets have none.

    ``events``: group, partition, seq, first, last, ack_type (1 accept, 2 release, 3 reject).
    """
    each = events.where("ack_type <> 2").withColumn("offset", F.explode(F.sequence("first", "last")))
    done = each.groupBy("group", "partition", "offset").agg(F.min_by("ack_type", "seq").alias("ack_type"))
    return done.withColumn("state", F.when(F.col("ack_type") == 1, "accepted").otherwise("archived")).drop("ack_type")


def islands(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive offsets: keys, first, last, records."""
    run = F.col("offset") - F.row_number().over(Window.partitionBy(*keys).orderBy("offset"))
    return offsets.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count("*").alias("records")).drop("_run")


def merged(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching [first, last] ranges joined, by the running maximum of their ends."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("_new", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    numbered = starts.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")


def share_cursor(accepted: DataFrame, starts: DataFrame) -> DataFrame:
    """The cursor behind the accepted ranges' contiguous prefix.  ``starts``: group, partition, cursor."""
    spans = merged(accepted, ["group", "partition"]).join(starts, ["group", "partition"])
    over = spans.where("first <= cursor").groupBy("group", "partition").agg((F.max("last") + 1).alias("end"))
    return starts.join(over, ["group", "partition"], "left").select("group", "partition", F.greatest("cursor", F.coalesce("end", "cursor")).alias("cursor"))


def share_slice(log: DataFrame, cursors: DataFrame, archived: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a partition's offsets at or behind the cursor that are not archived."""
    ahead = log.join(cursors, "partition").where(F.col("offset") >= F.col("cursor"))
    return islands(ahead.join(archived.select(*keys, "offset"), [*keys, "offset"], "left_anti").select(*keys, "offset"), keys)


def delivery_counts(deliveries: DataFrame, limit: int = 5) -> DataFrame:
    """Deliveries of each range head, capped at the limit."""
    return deliveries.groupBy("group", "partition", "first").agg(F.least(F.count("*"), F.lit(limit)).alias("deliveries"))


# -- ordered folds --------------------------------------------------------------------------------------------------


def classic_group(events: DataFrame) -> DataFrame:
    """The classic group's state after each of its events, in order of ``seq``: joins and leaves start a rebalance,
    a sync of the leader makes it stable.  ``events``: group, seq, kind (join|sync|leave|expire), member."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        members: dict[str, None] = {}
        waiting: set[str] = set()
        state, generation, out = "Empty", 0, []
        for r in rows.sort_values("seq").itertuples():
            status = "ok"
            if r.kind == "join":
                members.setdefault(r.member)
                waiting.add(r.member)
                state = "PreparingRebalance"
                if waiting >= set(members):
                    state, generation, waiting = "CompletingSync", generation + 1, set()
            elif r.member not in members:
                status = "unknown_member"
            elif r.kind == "sync":
                if state == "CompletingSync" and r.member == next(iter(members)):
                    state = "Stable"
                elif state == "PreparingRebalance":
                    status = "rebalance_in_progress"
            else:  # leave, expire
                members.pop(r.member)
                waiting.discard(r.member)
                if not members:
                    state, waiting = "Empty", set()
                elif waiting >= set(members):
                    state, generation, waiting = "CompletingSync", generation + 1, set()
                else:
                    state = "PreparingRebalance"
            out.append((key[0], int(r.seq), state, generation, len(members), status))
        return pd.DataFrame(out, columns=["group", "seq", "state", "generation", "members", "status"])

    return events.groupBy("group").applyInPandas(run, "group string, seq long, state string, generation long, members long, status string")


def heartbeats(events: DataFrame, topics: dict[str, int], limit: int = 1000) -> DataFrame:
    """Heartbeats of the incremental protocol, folded in order of ``seq``.

    Epoch 0 joins, -1 and -2 leave (a static member keeps its seat), the current epoch (or the one before, owning no
    more than assigned) goes on, an unknown member gets 25, another epoch 82, a full group 81, a join without topics 42.  A
    partition goes to its new owner once the old one no longer owns it.  ``events``: group, seq, member, epoch,
    topics (array), owned (array of ``topic-partition``; null: as before).
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wanted: dict[str, set[str]] = {}
        epochs: dict[str, int] = {}
        owned: dict[str, set[str]] = {}
        target: dict[str, set[str]] = {}
        epoch, out = 0, []

        def assign() -> None:
            parts = [(t, i) for t in sorted(set().union(*wanted.values())) for i in range(topics.get(t, 0))] if wanted else []
            had = {tuple([p.rpartition("-")[0], int(p.rpartition("-")[2])]): m for m, ps in target.items() for p in ps}
            got = sticky(list(wanted), wanted, parts, had)
            target.clear()
            target.update({m: {f"{t}-{i}" for (t, i), o in got.items() if o == m} for m in wanted})

        for r in rows.sort_values("seq").itertuples():
            error, told = 0, -1
            names = set(r.topics) if r.topics is not None else set()
            if r.epoch in (-1, -2):
                if r.member not in epochs:
                    error = 25
                else:
                    if r.epoch == -1:
                        for table in (wanted, epochs, owned, target):
                            table.pop(r.member, None)
                        epoch += 1
                        assign()
                    else:
                        owned[r.member] = set()
                    told = r.epoch
            elif r.epoch == 0 and r.member not in epochs:
                if not names:
                    error = 42
                elif len(epochs) >= limit:
                    error = 81
                else:
                    epoch += 1
                    wanted[r.member], owned[r.member] = names, set()
                    assign()
                    epochs[r.member] = told = epoch
            elif r.member not in epochs:
                error = 25
            elif r.epoch not in (0, epochs[r.member]) and not (r.epoch == epochs[r.member] - 1 and r.owned is not None and set(r.owned) <= target[r.member]):
                error = 82
            else:
                if r.owned is not None:
                    owned[r.member] = set(r.owned)
                if names and names != wanted[r.member]:
                    epoch += 1
                    wanted[r.member] = names
                    assign()
                epochs[r.member] = told = epoch
            given = sorted(p for p in target.get(r.member, ()) if not any(p in o for m, o in owned.items() if m != r.member)) if not error and told >= 0 else []
            if given:
                owned[r.member] |= set(given)
            out.append((key[0], int(r.seq), r.member, error, told, given))
        return pd.DataFrame(out, columns=["group", "seq", "member", "error", "epoch", "assigned"])

    return events.groupBy("group").applyInPandas(run, "group string, seq long, member string, error int, epoch long, assigned array<string>")


def share_deliveries(events: DataFrame, lock_ms: int = 30_000, limit: int = 5) -> DataFrame:
    """Acquire and acknowledge, folded in order: which offset went to whom, and how often.

    An offset is delivered unless it is accepted, archived, locked by another member or at its limit; a lock that
    runs out is a release.  ``events``: group, partition, seq, ts_ms, kind (fetch|accept|release|reject), member,
    first, last.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        done: dict[int, str] = {}
        locks: dict[int, tuple[str, int]] = {}
        counts: dict[int, int] = {}
        out = []
        for r in rows.sort_values("seq").itertuples():
            for o in range(int(r.first), int(r.last) + 1):
                holder = locks.get(o)
                if holder and holder[1] <= r.ts_ms:
                    del locks[o]
                    holder = None
                if r.kind == "fetch":
                    if o not in done and holder is None and counts.get(o, 0) < limit:
                        counts[o] = counts.get(o, 0) + 1
                        locks[o] = (r.member, int(r.ts_ms) + lock_ms)
                        out.append((key[0], int(key[1]), int(r.seq), o, r.member, counts[o]))
                elif o not in done and holder and holder[0] == r.member:
                    del locks[o]
                    if r.kind != "release":
                        done[o] = r.kind
        return pd.DataFrame(out, columns=["group", "partition", "seq", "offset", "member", "deliveries"])

    return events.groupBy("group", "partition").applyInPandas(run, "group string, partition long, seq long, offset long, member string, deliveries int")


def membership(members: DataFrame) -> DataFrame:
    """group, signature: a 64-bit hash of the group's members in order, which tells whether they changed."""
    return members.groupBy("group").agg(F.xxhash64(F.array_sort(F.collect_set("member"))).alias("signature"))
