"""Nearest neighbours by additive quantisation.

A unit vector is approximated by the sum of one codeword from each of ``BOOKS`` full-dimensional codebooks.  The
books start as residual k-means and are refitted jointly by least squares; codes are found by beam search over
residuals.  A row of the index holds a block of vectors: ids, originals, codes and the norms of their approximations.

A search takes its queries in chunks of bounded size and passes twice over the index.  The first pass reads codes and
norms: a query's inner products with all codewords form its lookup table, a vector is scored by ``BOOKS`` look-ups over
its stored norm, and each task sends the best ``shortlist`` of its rows, from which the best of all are taken.  The
second pass reads the originals and ranks that one shortlist by the exact cosine.

Of vectors that are equal in every component only the ``k + 1`` smallest ids are indexed: they tie with each other
before any later copy, so no later copy can be among the k nearest.

Defined results: null vectors, vectors with a null or non-finite component, zero vectors, rows without an id and
vectors of another length than most take no part; a repeated (id, vector) counts once; an id with several vectors is
ranked by the best of them, and asks with the least of them; rows that share the query's id are its own; components of
any finite size are scaled before they are multiplied; one usable vector has no neighbours, and fewer than k others
all come; an empty table gives no rows; other columns, whatever they are named, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.scratch import bounded_sample, materialise, partitions_for, quoted, release, scratch_path
from tidemark.llm.workers import tidy

BOOKS, WORDS, BEAM = 16, 256, 4
#: The codebooks are fitted on this many rows at most, those with the smallest hash of their id.
SAMPLE = 8192
#: Rows of a block, and of the one shortlist of a query.
BLOCK, SHORTLIST = 4096, 400
#: A row's name is its block's number and these bits of its place there; a partition has a million blocks at most.
PLACE_BITS, BLOCK_BITS = 13, 20
#: Queries that are searched at a time: as many as these bytes hold, with what a task keeps of each.
CHUNK_BYTES = 32 << 20
QUERY_STEP, ENCODED = 64, 512


@dataclass(frozen=True)
class Books:
    words: np.ndarray  # books x words x dimensions

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[2])


def encode(books: Books, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The codes (rows x books) that beam search finds for unit vectors ``x``: each partial sum is kept as what it
    leaves of the vector, and the ``beam`` smallest remainders go on."""
    m, k, d = books.words.shape
    size = np.einsum("mkd,mkd->mk", books.words, books.words)
    out = np.empty((len(x), m), np.uint8)
    for at in range(0, len(x), ENCODED):
        left = x[at : at + ENCODED, None, :].astype(np.float32)
        n = len(left)
        codes = np.zeros((n, 1, 0), np.uint8)
        row = np.arange(n)[:, None]
        for b in range(m):
            width = left.shape[1]
            step = size[b] - 2 * (left.reshape(-1, d) @ books.words[b].T).reshape(n, width, k)
            step += np.einsum("nwd,nwd->nw", left, left)[:, :, None]
            step = step.reshape(n, -1)
            keep = min(beam if b < m - 1 else 1, step.shape[1])
            best = np.argpartition(step, keep - 1, axis=1)[:, :keep] if keep < step.shape[1] else np.tile(np.arange(keep), (n, 1))
            came, word = best // k, best % k
            left = left[row, came] - books.words[b][word]
            codes = np.concatenate([codes[row, came], word[:, :, None].astype(np.uint8)], axis=2)
        out[at : at + n] = codes[:, 0]
    return out


def decode(books: Books, codes: np.ndarray) -> np.ndarray:
    return sum(books.words[b][codes[:, b]] for b in range(books.words.shape[0]))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres**2).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])


def fit(x: np.ndarray, m: int = BOOKS, words: int = WORDS, rounds: int = 2) -> Books:
    """Codebooks for unit vectors ``x`` (one at least)."""
    k = max(1, min(words, len(x) // 4))
    x = x.astype(np.float32)
    rest, books = x.copy(), []
    for b in range(m):
        centres = rest[np.linspace(b % len(rest), len(rest) - 1, k).astype(int)].copy()
        for _ in range(6):
            near = nearest_centre(rest, centres)
            order = np.argsort(near, kind="stable")
            own, starts = np.unique(near[order], return_index=True)
            centres[own] = np.add.reduceat(rest[order], starts, axis=0) / np.diff(np.append(starts, len(order)))[:, None]
        rest -= centres[nearest_centre(rest, centres)]
        books.append(centres)
    found = Books(np.stack(books))
    for _ in range(rounds):
        codes = encode(found, x).astype(np.int64)
        gram = np.zeros((m * k, m * k), np.float32)
        target = np.zeros((m * k, x.shape[1]), np.float32)
        for a in range(m):
            for b in range(m):
                gram[a * k : (a + 1) * k, b * k : (b + 1) * k] = np.bincount(codes[:, a] * k + codes[:, b], minlength=k * k).reshape(k, k)
            order = np.argsort(codes[:, a], kind="stable")
            own, starts = np.unique(codes[order, a], return_index=True)
            target[a * k + own] = np.add.reduceat(x[order], starts, axis=0)
        ridge = np.float32(0.1)
        gram.flat[:: m * k + 1] += ridge  # in place: the matrix is the largest thing that the driver holds
        solved = np.linalg.solve(gram, target + ridge * found.flat)
        del gram
        found = Books(solved.reshape(m, k, -1).astype(np.float32))
    return found


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (lengths["d"] if lengths else 0))


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (lengths["d"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between a half and one: nothing is rounded,
    and products neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(np.asarray(x, dtype=np.float64))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


INDEX = "block long, ids binary, vectors binary, codes binary, norms binary"


def build(rows: DataFrame, k: int, sample: int = SAMPLE) -> tuple[DataFrame, Books | None]:
    """The index (a row per block) of all rows and its codebooks."""
    picked = bounded_sample(rows, sample, "vec_id").select("vector").collect()
    if not picked:
        return rows.sparkSession.createDataFrame([], INDEX), None
    books = fit(unit(np.array([r["vector"] for r in picked])))
    shared = rows.sparkSession.sparkContext.broadcast(books)
    copies = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.groupBy("vec_id", "vector").agg(F.lit(1).alias("one")).withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).select("vec_id", "vector")
    dealt = few.repartition(partitions_for(rows.sparkSession), "vec_id").sortWithinPartitions("vec_id")
    schema = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("ids", "vectors", "codes", "norms")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column(1))
                codes = encode(shared.value, unit(x))
                norms = np.linalg.norm(decode(shared.value, codes), axis=1).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"block": [block], "ids": [part.column(0).to_numpy(zero_copy_only=False).tobytes()], "vectors": [x.tobytes()], "codes": [codes.tobytes()], "norms": [norms.tobytes()]}, schema=schema)
                block += 1

    return materialise(dealt.mapInArrow(tidy(run), INDEX), "ann-index"), books


class Shortlists:
    """The best rows so far of each query, by approximate score; a row is named by its block and place."""

    def __init__(self, names: np.ndarray, q: np.ndarray, books: Books, most: int):
        self.names, self.books, self.most = names, books, most
        self.q = unit(q)
        self.score = np.full((len(names), 0), -np.inf, np.float32)
        self.place = np.zeros((len(names), 0), np.int64)

    def add(self, block: int, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> None:
        n, scale = len(ids), 1 / np.maximum(norms, np.float32(1e-6))
        own = (block << PLACE_BITS) + np.arange(n)
        keep = min(self.most, self.score.shape[1] + n)
        score, place = np.empty((len(self.names), keep), np.float32), np.empty((len(self.names), keep), np.int64)
        for at in range(0, len(self.names), QUERY_STEP):
            end = min(at + QUERY_STEP, len(self.names))
            tables = np.einsum("mkd,qd->mkq", self.books.words, self.q[at:end], optimize=True)
            guess = np.zeros((n, end - at), np.float32)
            for b in range(codes.shape[1]):
                guess += tables[b].take(codes[:, b], axis=0)
            guess *= scale[:, None]
            guess[ids[:, None] == self.names[None, at:end]] = -np.inf
            every = np.concatenate((self.score[at:end], guess.T), axis=1)
            places = np.concatenate((self.place[at:end], np.broadcast_to(own, (end - at, n))), axis=1)
            if keep < every.shape[1]:
                best = np.argpartition(-every, keep - 1, axis=1)[:, :keep]
                every, places = np.take_along_axis(every, best, axis=1), np.take_along_axis(places, best, axis=1)
            score[at:end], place[at:end] = every, places
        self.score, self.place = score, place


def shortlisted(shared, books: Books, most: int):
    """First pass: blocks -> each query's best rows of the task."""
    schema = pa.schema([("query", pa.int32()), ("score", pa.binary()), ("place", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        found = Shortlists(names, q, books.value, most)
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, codes, norms = (column[i].as_py() for column in batch.columns)
                ids = np.frombuffer(ids, np.int64)
                found.add(block, ids, np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(norms, np.float32))
        for at in range(0, len(names) if found.place.shape[1] else 0, 1024):
            end = min(at + 1024, len(names))
            yield pa.RecordBatch.from_pydict({"query": list(range(at, end)), "score": [x.tobytes() for x in found.score[at:end]], "place": [x.tobytes() for x in found.place[at:end]]}, schema=schema)

    return run


def merged(most: int):
    """(query, score, place), sorted by query -> (query, places of its best rows)."""
    schema = pa.schema([("query", pa.int32()), ("place", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, score, place = None, [], []

        def settle() -> pa.RecordBatch:
            s, p = np.concatenate(score), np.concatenate(place)
            own = np.lexsort((p, -s))[:most]
            return pa.RecordBatch.from_pydict({"query": [now], "place": [p[own[s[own] > -np.inf]].tobytes()]}, schema=schema)

        for batch in batches:
            for query, s, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is not None and query != now:
                    yield settle()
                    score, place = [], []
                now = query
                score.append(np.frombuffer(s, np.float32))
                place.append(np.frombuffer(p, np.int64))
        if now is not None:
            yield settle()

    return run


def reranked(shared, short, k: int):
    """Second pass: blocks -> (query_id, vec_id, score) of the shortlisted rows, the k best ids of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        place, query = short.value  # ascending by place
        q = scaled(q)
        long = np.sqrt(np.einsum("nd,nd->n", q, q))
        for batch in batches:
            for i in range(batch.num_rows):
                block, ids, raw = (column[i].as_py() for column in batch.columns)
                first, end = np.searchsorted(place, [block << PLACE_BITS, (block + 1) << PLACE_BITS])
                if first == end:
                    continue
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(raw, np.float64).reshape(len(ids), -1)
                at, own = place[first:end] - (block << PLACE_BITS), query[first:end]
                found = np.empty(len(at))
                for j in range(0, len(at), 8192):
                    a, b = scaled(x[at[j : j + 8192]]), own[j : j + 8192]
                    found[j : j + 8192] = np.einsum("nd,nd->n", a, q[b]) / (np.sqrt(np.einsum("nd,nd->n", a, a)) * long[b])
                order = np.lexsort((ids[at], -found, own))
                own, vec, found = own[order], ids[at][order], found[order]
                # the best of an id's vectors, then the k best ids of a query
                again = np.lexsort((np.arange(len(own)), vec, own))
                same = np.concatenate(([False], (own[again][1:] == own[again][:-1]) & (vec[again][1:] == vec[again][:-1])))
                one = np.sort(again[~same])
                own, vec, found = own[one], vec[one], found[one]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                rank = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
                best = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(names[own[best]], pa.int64()), pa.array(vec[best], pa.int64()), pa.array(found[best], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, rank int, vec_id long, score double"


def search(index: DataFrame, books: Books | None, queries: DataFrame, k: int = 5, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest among its ``shortlist`` best by approximation."""
    spark = queries.sparkSession
    names = materialise(queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "ann-queries")
    n = names.count()
    out = scratch_path(spark, "ann-found")
    if books is None or not n:
        return spark.createDataFrame([], FOUND)
    # a chunk's queries, shortlists and scores are held by the driver and by each task
    chunks = -(-n * (12 * shortlist + 16 * books.words.shape[2]) // CHUNK_BYTES)
    known = spark.sparkContext.broadcast(books)
    for c in range(chunks):
        own = names.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").collect()  # one chunk
        if not own:
            continue
        ids = np.array([r["vec_id"] for r in own], np.int64)
        shared = spark.sparkContext.broadcast((ids, np.array([r["vector"] for r in own])))
        first = index.select("block", "ids", "codes", "norms").mapInArrow(tidy(shortlisted(shared, known, shortlist)), "query int, score binary, place binary")
        whole = first.repartition(partitions_for(spark), "query").sortWithinPartitions("query").mapInArrow(tidy(merged(shortlist)), "query int, place binary")
        lists = {r["query"]: np.frombuffer(r["place"], np.int64) for r in whole.collect()}  # a shortlist a query of the chunk
        place = np.concatenate([*lists.values(), np.zeros(0, np.int64)])
        query = np.repeat(np.array(list(lists), np.int64), [len(p) for p in lists.values()])
        order = np.argsort(place, kind="stable")
        short = spark.sparkContext.broadcast((place[order], query[order]))
        second = index.select("block", "ids", "vectors").mapInArrow(tidy(reranked(shared, short, k)), "query_id long, vec_id long, score double")
        found = second.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    release(spark, names)
    return spark.read.schema(FOUND).parquet(out)
