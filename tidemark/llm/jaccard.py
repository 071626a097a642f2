"""Exact n-gram Jaccard join: documents whose sets of word shingles overlap by a threshold, and their classes.

1. Equal sets become one node (a grouped minimum, so copies cost no pairs).
2. Sets that reach the threshold share one of their first ``n - ceil(t n) + 1`` tokens in any global order.  The
   order used is (frequent, hash): tokens that many documents hold among their first by hash come last.  So common
   lines and passages bring nobody together, and the order is exact whatever counts as frequent.
3. The nodes of a token form a group; groups of the same nodes are one (told by size, first node and a 64-bit sum); nodes without a neighbour of a fitting size leave it.  Signature trees over the group's bitmaps are traversed against each other and
   tell which nodes have a possible partner at all.
4. Those nodes meet in the group of the smallest node that possible pairs connect them with, now with their sets: trees are traversed again,
   possible pairs are counted exactly, and pairs already joined are skipped.  Only joining links are kept.
   With ``links``, every possible pair is counted instead, in the smallest group where it meets; tasks send how many
   links each node has, and what joins them, not the pairs, whose number grows with the square of a group.
5. Components of the links.

Groups beyond ``BLOCK`` nodes or ``BLOCK_TOKENS`` tokens are dealt into blocks, and each pair of blocks is a group of
its own.

Defined results: a null or wordless text has an empty set and joins nothing; fewer words than a shingle are one
shingle; rows without doc_id come out unjoined (component null); repeated ids share their component; equal texts are
one class, whatever their number; texts are read whole, whatever their length; an empty table gives no rows.  Other
columns, whatever they are named, take no part; ``keep_one`` passes them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import sigtree
from tidemark.llm.components import components
from tidemark.llm.scratch import materialise, partitions_for, quoted, release
from tidemark.llm.workers import sliced, tidy
from tidemark.llm.words import distinct, scramble, shingle_set, slices, word_hashes

BLOCK, BLOCK_TOKENS = 4096, 1 << 22
#: Rows and bytes of whole tasks that a worker holds at a time, beyond the task itself.
HELD_ROWS, HELD_BYTES = 20_000, 16 << 20
#: Classes with more than this share of all rows are joined by broadcast, so there are at most as many.
HOT_CLASSES = 1000
#: A token is frequent from this many documents on; more where the table of frequent tokens would pass its bound.
FREQUENT, FREQUENT_TOKENS = 4, 1 << 20
#: Tasks beyond FEW nodes count pairs on bits, if those take no more than TASK_WORDS; PAIR_WORDS are compared at a time.
FEW, TASK_WORDS, PAIR_WORDS = 8, 1 << 22, 1 << 20


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def each_set(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches, cut small, with the shingle sets of their last column's texts."""
    for batch in (x for whole in batches for x in sliced([whole], whole.num_columns - 1) if x.num_rows):
        texts = [x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()]
        found: list[np.ndarray] = []
        for first, end, data, offsets in slices(texts):
            words, at = word_hashes(data, offsets)
            found += [shingle_set(words[at[i] : at[i + 1]], k) for i in range(end - first)]
        yield batch, found or [np.zeros(0, np.uint64)] * len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def first_tokens(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of a set in the order (frequent, hash)."""
    p = prefix_size(len(tokens), percent)
    if not len(frequent):
        return tokens[:p]
    at = np.searchsorted(frequent, tokens)
    common = frequent[np.minimum(at, len(frequent) - 1)] == tokens
    rare = tokens[~common][:p]
    return rare if len(rare) == p else np.concatenate((rare, tokens[common][: p - len(rare)]))


def blocks(rows: DataFrame, group: str, member: str, counts: DataFrame) -> DataFrame:
    """Each row once per pair of blocks it takes part in: adds task and side (null: all pairs of the task).
    ``counts`` has the members of each group and the sum of their sizes."""
    m = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_TOKENS)).cast("int")
    dealt = rows.join(counts, group).withColumn("m", m).withColumn("own", F.pmod(F.xxhash64(member), F.col("m")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return other.withColumn("task", F.xxhash64(group, low, high)).withColumn("side", F.when(F.col("own") == F.col("other"), F.lit(None)).otherwise((F.col("own") > F.col("other")).cast("int"))).drop("m", "own", "other", "members", "total")


def grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[list]]:
    """Whole tasks, many to a list of columns; the input is sorted by its first column.  A task is bounded by its
    blocks; beyond it a worker holds what ``HELD_ROWS`` and ``HELD_BYTES`` say."""
    held: list[list] = [[] for _ in range(columns)]
    size = 0
    for batch in (x for whole in batches for x in sliced([whole], widest(whole), 4096)):
        for c in range(columns):
            held[c] += batch.column(c).to_pylist()
        size += batch.nbytes
        if (len(held[0]) >= HELD_ROWS or size >= HELD_BYTES) and held[0][0] != held[0][-1]:
            cut = len(held[0])
            while held[0][cut - 1] == held[0][-1]:
                cut -= 1
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
            size = 0
    if held[0]:
        yield held


def widest(batch: pa.RecordBatch) -> int:
    return max(range(batch.num_columns), key=lambda c: batch.column(c).nbytes)


def runs(task: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(task)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(task)], strict=True)


class Meetings:
    """Which rows have a possible partner, and one label for rows that such pairs connect."""

    def __init__(self, n: int):
        self.hit, self.labels = np.zeros(n, bool), np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.hit[i] = self.hit[j] = True
        a, b = self.labels[i], self.labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        new = distinct((low[low != high].astype(np.uint64) << np.uint64(32)) | high[low != high].astype(np.uint64))
        if not len(new):
            return
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = x = root.get(y, y)
            return x

        for x, y in zip((new >> np.uint64(32)).tolist(), (new & np.uint64(0xFFFFFFFF)).tolist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        table = np.arange(len(self.labels))
        table[list(root)] = [find(x) for x in root]
        self.labels = table[self.labels]

    def rows(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(smallest node of the label, node, place) of the rows that were hit."""
        at = np.flatnonzero(self.hit)
        least = np.full(len(self.labels), np.iinfo(np.int64).max)
        np.minimum.at(least, self.labels[at], node[at])
        return least[self.labels[at]], node[at], at


def possible(percent: int) -> Callable:
    """Stage 3: (task, node, size, side, bitmap) -> (leader, node, size) of nodes with a possible partner; nodes of a
    possible pair have the same leader, the smallest node that such pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, node, size, side, raw in grouped(batches, 5):
            task, size = np.array(task, np.int64), np.array(size, np.int64)
            maps = [np.frombuffer(x, dtype="<u8").astype(np.uint64) for x in raw]
            found, spans = Meetings(len(task)), list(runs(task))
            small = np.concatenate([np.arange(a, b) for a, b in spans if b - a <= sigtree.SMALL and side[a] is None] or [np.zeros(0, np.int64)])
            if len(small):
                i, j = sigtree.small_pairs(task[small], size[small], [maps[k] for k in small.tolist()], percent)
                found.add(small[i], small[j])
            for a, b in spans:
                if b - a > sigtree.SMALL or side[a] is not None:
                    own = None if side[a] is None else np.array(side[a:b])
                    for i, j in sigtree.candidates(np.arange(a, b), size[a:b], maps[a:b], own, percent):
                        found.add(i, j)
            leader, member, at = found.rows(np.array(node, np.int64))
            yield pa.RecordBatch.from_pydict({"leader": pa.array(leader, pa.int64()), "node": pa.array(member, pa.int64()), "size": pa.array(size[at], pa.int64())})

    return run


def joined(percent: int) -> Callable:
    """Stage 4: (task, node, side, set) -> links that join nodes of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, node, side, raw in grouped(batches, 4):
            links: list[tuple[int, int]] = []
            sets = [np.frombuffer(x, dtype="<u8").astype(np.uint64) for x in raw]
            sizes = np.array([len(s) for s in sets], np.int64)
            root = list(range(len(sets)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in runs(np.array(task, np.int64)):
                if b - a < 2:
                    continue
                own = None if side[a] is None else np.array(side[a:b])
                maps = [sigtree.bitmap(s, sigtree.size_class(len(s))) for s in sets[a:b]]
                for left, right in sigtree.candidates(np.arange(a, b), sizes[a:b], maps, own, percent):
                    for i, j in zip(left.tolist(), right.tolist(), strict=True):
                        x, y = find(i), find(j)
                        if x == y:
                            continue
                        both = np.sort(np.concatenate((sets[i], sets[j])))
                        shared = int((both[1:] == both[:-1]).sum())
                        if 100 * shared >= percent * (len(both) - shared):
                            root[max(x, y)] = min(x, y)
                            links.append((node[i], node[j]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def bit_rows(keys: list[np.ndarray], most: int) -> np.ndarray | None:
    """A bit for each key that two rows or more hold (keys of a row are distinct); none beyond ``most`` words."""
    _, index, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    twice = counts >= 2
    words = int(twice.sum()) // 64 + 1
    if words * len(keys) > most:
        return None
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[held := twice[index]]
    bit = (np.cumsum(twice) - 1)[index[held]]
    out = np.zeros(len(keys) * words, np.uint64)
    np.bitwise_or.at(out, row * words + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.reshape(len(keys), words)


def in_common(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    step = max(1, PAIR_WORDS // bits.shape[1])
    parts = [np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), step)]
    return np.concatenate(parts or [np.zeros(0, np.int64)])


def counted(percent: int) -> Callable:
    """Stage 4 with links: (task, node, side, set, leader, leaders, copies) -> (a, b, n): node b is joined with a and
    has n links here, copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, node, side, raw, leader, leaders, copies in grouped(batches, 7):
            sets = [np.frombuffer(x, dtype="<u8").astype(np.uint64) for x in raw]
            sizes, weights = np.array([len(s) for s in sets], np.int64), np.array(copies, np.int64)
            found, totals = Meetings(len(sets)), np.zeros(len(sets), np.int64)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def flush(least: int, found: Meetings = found, totals: np.ndarray = totals, weights: np.ndarray = weights, held: list = held) -> None:
                if sum(len(i) for i, _ in held) <= least:
                    return
                i, j = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                np.add.at(totals, i, weights[j])
                np.add.at(totals, j, weights[i])
                found.add(i, j)

            for a, b in runs(np.array(task, np.int64)):
                if b - a < 2:
                    continue
                own = None if side[a] is None else np.array(side[a:b])
                maps = [sigtree.bitmap(s, sigtree.size_class(len(s))) for s in sets[a:b]]
                # a pair that meets in a smaller group too is counted there
                before = [[x for x in leaders[k] if x < leader[a]] for k in range(a, b)]
                seen = bit_rows([np.array(x, np.int64) for x in before], 1 << 62) if any(before) else None
                tokens = bit_rows(sets[a:b], TASK_WORDS) if b - a > FEW else None
                for i, j in sigtree.candidates(np.arange(a, b), sizes[a:b], maps, own, percent):
                    if seen is not None:
                        new = in_common(seen, i - a, j - a) == 0
                        i, j = i[new], j[new]
                    if tokens is not None:
                        shared = in_common(tokens, i - a, j - a)
                    else:
                        shared = np.array([len(sets[x]) + len(sets[y]) - len(distinct(np.concatenate((sets[x], sets[y])))) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
                    good = 100 * shared >= percent * (sizes[i] + sizes[j] - shared)
                    held.append((i[good], j[good]))
                    flush(1 << 16)
            flush(0)
            least, member, at = found.rows(np.array(node, np.int64))
            yield pa.RecordBatch.from_pydict({"a": pa.array(least, pa.int64()), "b": pa.array(member, pa.int64()), "n": pa.array(totals[at], pa.int64())})

    return run


def classes(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links); with
    ``links`` also n_links, the number of other rows that reach the threshold with it (null without doc_id)."""
    sigtree.classes_apart(percent)  # refuses a threshold without a meaning
    spark = df.sparkSession
    own_id = F.col(quoted(id_col)).cast("long")
    if links and repeated(df, id_col, nulls=False):
        return by_row(df, words, percent, id_col, text_col)
    texts = df.select(own_id.alias("doc_id"), F.encode(F.col(quoted(text_col)), "UTF-8").alias("raw"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in each_set(batches, words):
            tokens = [s[: prefix_size(len(s), percent)] for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens or [np.zeros(0, np.uint64)])))], names=["token"])

    counts = texts.select("raw").mapInArrow(tidy(keys), "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    counts = materialise(counts, "frequent")
    release(spark)
    least = FREQUENT
    while counts.where(F.col("count") >= least).count() > FREQUENT_TOKENS:
        least *= 2
    common = np.sort(np.array([r["token"] for r in counts.where(F.col("count") >= least).select("token").toLocalIterator()], dtype=np.int64).view(np.uint64))
    frequent = spark.sparkContext.broadcast(common)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in each_set(batches, words):
            sums = [(int(signed(np.sum(s, keepdims=True))[0]), int(signed(np.sum(scramble(s), keepdims=True))[0])) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in sums], pa.int64()),
                    pa.array([y for _, y in sums], pa.int64()),
                    pa.array([signed(first_tokens(s, frequent.value, percent)) for s in sets], pa.list_(pa.int64())),
                    pa.array([sigtree.bitmap(s, sigtree.size_class(len(s))).astype("<u8").tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "tokens", "bits"],
            )

    described = materialise(texts.mapInArrow(tidy(describe), "doc_id long, n_shingles long, d1 long, d2 long, tokens array<long>, bits binary"), "shingles")
    able = described.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = materialise(able.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("node"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits"), F.count("*").alias("copies")), "nodes")
    members = materialise(described.select("doc_id", "n_shingles", "d1", "d2"), "members")
    release(spark, described, counts)
    held = nodes.select("node", "n_shingles", F.explode("tokens").alias("token"))
    shared = held.groupBy("token").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("sum")).where("members > 1")
    # tokens with the same members, as copies have them by the dozen, make one group
    shared = shared.groupBy("members", "leader", "sum").agg(F.min("token").alias("token"), F.max("total").alias("total")).select("token", "members", "total")
    # sizes alone rule most out: a node has a partner of a fitting size if one of its neighbours by size fits
    by_size = Window.partitionBy("task").orderBy("n_shingles")
    near = blocks(held, "token", "node", shared).withColumn("below", F.lag("n_shingles").over(by_size)).withColumn("above", F.lead("n_shingles").over(by_size))
    near = near.where((100 * F.col("below") >= percent * F.col("n_shingles")) | (100 * F.col("n_shingles") >= percent * F.col("above"))).select("task", "node", "side")
    rows = near.join(nodes.select("node", "n_shingles", "bits"), "node")
    n = partitions_for(spark)
    ready = rows.select("task", "node", "n_shingles", "side", "bits").repartition(n, "task").sortWithinPartitions("task")
    meeting = materialise(ready.mapInArrow(tidy(possible(percent)), "leader long, node long, size long").distinct(), "meeting")
    release(spark)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in each_set(batches, words):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    sets = texts.join(meeting.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(tidy(whole), "node long, tokens binary")
    sizes = meeting.groupBy("leader").agg(F.count("*").alias("members"), F.sum("size").alias("total")).where("members > 1")
    tasks = blocks(meeting, "leader", "node", sizes).join(sets, "node")
    if not links:
        joins = tasks.select("task", "node", "side", "tokens").repartition(n, "task").sortWithinPartitions("task").mapInArrow(tidy(joined(percent)), "a long, b long")
        named = nodes.select("n_shingles", "d1", "d2", "copies", "node").join(components(joins, "a", "b"), "node", "left")
        named = named.select("n_shingles", "d1", "d2", "copies", F.coalesce("component", "node").alias("component_id"), F.lit(0).alias("n_links"))
    else:
        groups = meeting.groupBy("node").agg(F.collect_list("leader").alias("leaders"))
        full = tasks.join(groups, "node").join(nodes.select("node", "copies"), "node").select("task", "node", "side", "tokens", "leader", "leaders", "copies")
        joins = materialise(full.repartition(n, "task").sortWithinPartitions("task").mapInArrow(tidy(counted(percent)), "a long, b long, n long"), "links")
        totals = joins.groupBy(F.col("b").alias("node")).agg(F.sum("n").alias("n"))
        named = nodes.select("n_shingles", "d1", "d2", "node", "copies").join(components(joins, "a", "b"), "node", "left").join(totals, "node", "left")
        named = named.select("n_shingles", "d1", "d2", "copies", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = told(members, materialise(named, "classes"))
    extra = [F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")] if links else []
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *extra)


def told(members: DataFrame, named: DataFrame) -> DataFrame:
    """Each member with what its class is told.  Empty sets are in no class; large classes, few by their size, are
    broadcast, so no class's members meet in one task."""
    key = ["n_shingles", "d1", "d2"]
    least = max(1, members.count() // HOT_CLASSES)
    hot = F.broadcast(named.where(F.col("copies") > least).drop("copies").withColumn("hot", F.lit(True)))
    first = members.where("n_shingles > 0").join(hot, key, "left")
    rest = first.where("hot IS NULL").select("doc_id", *key).join(named.where(F.col("copies") <= least).drop("copies"), key, "left")
    none = [F.lit(None).cast("long").alias(c) for c in ("component_id", "n_links")]
    names = ["doc_id", "n_shingles", "component_id", "n_links"]
    return first.where("hot").select(names).unionAll(rest.select(names)).unionAll(members.where("n_shingles = 0").select("doc_id", "n_shingles", *none))


def repeated(df: DataFrame, id_col: str, nulls: bool) -> bool:
    """Whether an id stands in several rows (or, with ``nulls``, is missing in one)."""
    times = df.groupBy(F.col(quoted(id_col)).cast("long").alias("id")).count()
    twice = (F.col("count") > 1) & F.col("id").isNotNull()
    return not times.where(twice | F.col("id").isNull() if nulls else twice).limit(1).isEmpty()


def by_row(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The classes with links where ids repeat: rows have keys of their own, and each its own class and links."""
    own_id = F.col(quoted(id_col)).cast("long")
    key = F.when(own_id.isNotNull(), F.monotonically_increasing_id())
    rows = materialise(df.select(own_id.alias("doc_id"), F.col(quoted(text_col)).alias("text"), key.alias("row")), "rows")
    found = materialise(classes(rows, words, percent, "row", "text", links=True).withColumnRenamed("doc_id", "row"), "row-classes")
    named = found.join(rows.select("row", "doc_id"), "row")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"), "n_links")
    return named.unionAll(found.where("row IS NULL").select(F.col("row").alias("doc_id"), "n_shingles", "component_id", "n_links"))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``df``, that with the smallest id.  Where ids repeat or are missing, rows are told
    apart by keys of their own: of rows with the smallest id one stays, and rows without an id stand behind others."""
    if not repeated(df, id_col, nulls=True):
        found = classes(df, words, percent, id_col, text_col)
        gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
        return df.join(gone, F.col(quoted(id_col)).cast("long") == F.col("gone"), "left_anti")
    tagged = materialise(df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("key")), "tagged")
    own_id, text = F.col("row")[id_col].cast("long"), F.col("row")[text_col]
    found = classes(tagged.select("key", text.alias("text")), words, percent, "key", "text").select(F.col("doc_id").alias("key"), "component_id")
    first = F.min(F.struct(own_id.isNull(), own_id, "key"))["key"].alias("key")
    stays = found.join(tagged.select("key", "row"), "key").groupBy("component_id").agg(first).select("key")
    return tagged.join(stays, "key", "left_semi").select("row.*")
