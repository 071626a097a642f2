"""Language-model scoring by deleted interpolation of word n-grams and a uniform share.

``P(w | u) = sum over n of l_n[b] c_n / x_n + l_0[b] / (V + 1)``: ``c_n`` counts the n words that end in ``w``,
``x_n`` the n - 1 words before it (for n = 1 all tokens), ``b`` is the bucket of the longest context that was seen and
of its frequency (one for each doubling).  The weights of a bucket are learned by expectation-maximisation on held-out
counts: every training token is held out in turn, so its own occurrence is deleted from the counts that predict it.

Counting works on blocks of texts.  A block sends its distinct keys (64-bit hashes of words, word pairs and so on,
sorted, as differences) with their training counts to the parts of the key space; a part adds them up and answers each
block in its own order.  So a frequent word costs one entry a block.  There is a part for every ``BLOCKS_A_PART``
blocks, so that no task holds more than its block or part, whatever the input's size.
The joint counts of a block's tokens are then at hand; their histogram (a bounded table of cells, quarter octaves for
order two) feeds the EM, and the scores follow in one more pass.

Defined results: a null text is just its end token; a null id counts as the empty text for the split; repeated rows
are counted and scored each; texts are read whole, whatever their length; an empty table gives no rows; without
training tokens every score is that of the uniform share; other columns, whatever they are named, take no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise, quoted, release
from tidemark.llm.words import ODD, distinct, scramble, slices, word_hashes
from tidemark.llm.workers import sliced, tidy

BLOCK_BYTES, BLOCKS_A_PART = 8 << 20, 4
START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Counts are below 2 ** 63: a bucket for each doubling, and for no context; chances are above 2 ** -64.
OCTAVES, DEEPEST = 64, 64
EM_ROUNDS, LEAST_WEIGHT = 60, 1e-6
HELD_OUT, FOLDS = 2, 7


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def squeeze(values: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def stretch(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens with ends, index of each text's first token and the end)."""
    tokens, firsts, total = [], [], 0
    for _, _, data, offsets in slices(texts):
        words, at = word_hashes(data, offsets)
        n = len(offsets) - 1
        row = np.full(len(words) + n, END, dtype=np.uint64)
        ends = at[1:] + np.arange(n)
        solid = np.ones(len(row), bool)
        solid[ends] = False
        row[solid] = words
        tokens.append(row)
        firsts.append(np.concatenate(([0], ends[:-1] + 1)) + total)
        total += len(row)
    return np.concatenate(tokens or [np.zeros(0, np.uint64)]), np.concatenate([*firsts, [total]]).astype(np.int64)


def keys_of(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, ... ``order`` words that end at each token; texts begin behind start marks."""
    out = [tokens]
    for _ in range(order - 1):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[first] = START
        out.append(scramble(before * np.uint64(ODD[0]) + tokens * np.uint64(ODD[1])))
    return out


def counted(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how often each stands among the trained ones)."""
    own = distinct(keys)
    ordered = np.sort(keys[trained])
    return own, (np.searchsorted(ordered, own, side="right") - np.searchsorted(ordered, own)).astype(np.uint32)


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts packed into rows: block, ids, nulls, lengths, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, number, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": [(part << 24) + number], "ids": [ids], "lengths": [[len(t) for t in texts]], "payload": [zstandard.ZstdCompressor(level=4).compress(b"".join(texts))]}, schema=pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in sliced(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield flush()

    rows = df.select(F.col(quoted(id_col)).cast("long"), F.encode(F.col(quoted(text_col)), "UTF-8"))
    return materialise(rows.mapInArrow(tidy(run), "block long, ids array<long>, lengths array<long>, payload binary"), "lm-blocks")


def opened(lengths: list[int], payload: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(payload)
    ends = np.cumsum(lengths).tolist()
    return [raw[e - n : e] for e, n in zip(ends, lengths, strict=True)]


def block_keys(ids: list, lengths: list[int], payload: bytes, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys of each order, whether a token is trained on, first token of each text and the end)."""
    tokens, at = tokens_of(opened(lengths, payload))
    trained = np.repeat(np.array([not held_out(i) for i in ids], bool), np.diff(at))
    return keys_of(tokens, at[:-1], order), trained, at


def cuts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the key space begins in sorted keys."""
    marks = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, marks), [len(keys)]))


def ask(parts: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row is a whole block
                block, ids, lengths, payload = (column[i].as_py() for column in batch.columns)
                every, trained, _ = block_keys(ids, lengths, payload, order)
                for kind, keys in enumerate(every):
                    own, times = counted(keys, trained)
                    cut = cuts_of(own, parts)
                    out: dict[str, list] = {"part": [], "block": [], "kind": [], "keys": [], "times": []}
                    for p in range(parts):
                        a, b = cut[p], cut[p + 1]
                        if a < b:
                            for name, x in zip(out, (p, block, kind, squeeze(np.diff(own[a:b], prepend=np.uint64(0))), squeeze(times[a:b])), strict=True):
                                out[name].append(x)
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())]))

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up what a part was sent (sorted by part and kind); answers each block, and tells (V, N) of words as
    the answer to block -1."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("times", pa.binary())])
    now, held = None, []

    def settle() -> Iterator[pa.RecordBatch]:
        part, kind = now
        asked = [np.cumsum(stretch(k, "<u8"), dtype=np.uint64) for _, k, _ in held]
        whole = np.concatenate(asked)
        times = np.concatenate([stretch(t, "<u4") for _, _, t in held]).astype(np.int64)
        own = distinct(whole)
        sums = np.zeros(len(own), np.int64)
        for keys, at in zip(asked, np.cumsum([0] + [len(a) for a in asked[:-1]]).tolist(), strict=True):
            sums[np.searchsorted(own, keys)] += times[at : at + len(keys)]
        if kind == 0:
            yield pa.RecordBatch.from_pydict({"block": [-1], "kind": [0], "part": [part], "times": [struct.pack("<qq", int((sums > 0).sum()), int(sums.sum()))]}, schema=schema)
        for (block, _, _), keys in zip(held, asked, strict=True):
            yield pa.RecordBatch.from_pydict({"block": [block], "kind": [kind], "part": [part], "times": [squeeze(sums[np.searchsorted(own, keys)])]}, schema=schema)

    for batch in batches:
        for part, block, kind, keys, times in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if now is not None and now != (part, kind):
                yield from settle()
                held = []
            now = (part, kind)
            held.append((block, keys, times))
    if held:
        yield from settle()


def bucket(contexts: list[np.ndarray]) -> np.ndarray:
    """The bucket of each token by the frequencies of its contexts of one word, two words and so on: 0 if none was
    seen, else that of the longest one, by the whole part of its frequency's logarithm."""
    out = np.zeros(len(contexts[0]) if contexts else 0, np.int64)
    for level, x in enumerate(contexts):
        out = np.where(x > 0, level * OCTAVES + 1 + np.frexp(np.maximum(x, 1).astype(float))[1] - 1, out)
    return out


def an_octave(order: int) -> int:
    """Cells to each halving of a chance: the table of cells is bounded by their power."""
    return 4 if order <= 2 else 1


def cell(p: np.ndarray, fine: int) -> np.ndarray:
    """0 for no chance, else 1 + parts of octaves below 1."""
    return np.where(p > 0, 1 + np.minimum(np.rint(-fine * np.log2(np.maximum(p, 1e-300))), fine * DEEPEST), 0).astype(np.int64)


def cells_of(counts: list[np.ndarray], contexts: list[np.ndarray], fine: int) -> np.ndarray:
    """One number for a token's bucket and chances by order, all with the token's own occurrence deleted.  ``contexts``
    begin with the number of all tokens."""
    left = [np.asarray(x) - 1 for x in contexts]
    spots = bucket(left[1:]) if len(left) > 1 else np.zeros(len(counts[0]), np.int64)
    for c, x in zip(counts, left, strict=True):
        spots = spots * (2 + fine * DEEPEST) + cell(np.where(x > 0, (c - 1) / np.maximum(x, 1), 0.0), fine)
    return spots


def learn(cells: np.ndarray, times: np.ndarray, vocabulary: int, order: int) -> np.ndarray:
    """Weights of each bucket - uniform share, words, pairs and so on - from the histogram of held-out tokens."""
    fine = an_octave(order)
    wide = 2 + fine * DEEPEST
    chance = np.concatenate(([0.0], 2.0 ** (-np.arange(wide - 1) / fine)))
    weights = np.zeros((1 + (order - 1) * OCTAVES, order + 1))
    for b in range(len(weights)):
        seen = 1 if b == 0 else 2 + (b - 1) // OCTAVES  # orders whose contexts were seen
        fresh = np.zeros(order + 1)
        fresh[: seen + 1] = [0.2, 0.8] if seen == 1 else [0.1, *[0.5 / (seen - 1)] * (seen - 1), 0.4]
        own = cells // wide**order == b
        if not own.any():
            same = b > 1 and (b - 1) % OCTAVES  # the bucket before has contexts of the same length
            weights[b] = weights[b - 1] if same else fresh
            continue
        p = np.stack([np.full(own.sum(), 1.0 / (vocabulary + 1)), *[chance[cells[own] // wide ** (order - 1 - i) % wide] for i in range(order)]], axis=1)
        n = times[own].astype(float)[:, None]
        w = fresh
        for _ in range(EM_ROUNDS):
            share = p * w
            w = (n * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        w[:2] = np.maximum(w[:2], LEAST_WEIGHT)
        weights[b] = w / w.sum()
    return weights


def chance_of(weights: np.ndarray, counts: list[np.ndarray], contexts: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """The model's chance of tokens with these counts behind contexts with these (the first: all tokens)."""
    w = weights[bucket(contexts[1:]) if len(contexts) > 1 else np.zeros(len(counts[0]), np.int64)]
    out = w[:, 0] / (vocabulary + 1)
    for i, (c, x) in enumerate(zip(counts, contexts, strict=True)):
        out = out + w[:, i + 1] * c / np.maximum(x, 1)
    return out


def contexts_of(counts: list[np.ndarray], first: np.ndarray, n: int, starts: int) -> list[np.ndarray]:
    """The counts of the contexts, by order: all tokens, then what stands before; ``starts`` texts begin."""
    out = [np.full(len(counts[0]), n, np.int64)]
    for c in counts[:-1]:
        before = np.concatenate(([starts], c[:-1]))[: len(c)]
        before[first] = starts
        out.append(before)
    return out


def joint(totals: tuple[int, int, int], order: int):
    """Blocks with their answers (sorted by block, the block's own row first) -> a row per block with the counts of
    all its tokens, and the cells of its training tokens with one occurrence deleted."""
    _, n, starts = totals
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("counts", pa.list_(pa.binary())), ("cells", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, told = None, {}

        def settle() -> pa.RecordBatch:
            ids, lengths, payload = own
            keys, trained, at = block_keys(ids, lengths, payload, order)
            counts = []
            for kind in range(order):
                times = np.concatenate([stretch(t, "<i8") for t in told[kind]] or [np.zeros(0, np.int64)])
                counts.append(times[np.searchsorted(distinct(keys[kind]), keys[kind])] if len(times) else np.zeros(0, np.int64))
            contexts = contexts_of(counts, at[:-1], n, starts)
            spots = np.sort(cells_of([c[trained] for c in counts], [x[trained] for x in contexts], an_octave(order)))
            edge = np.flatnonzero(np.concatenate(([True], spots[1:] != spots[:-1]))) if len(spots) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_pydict({"ids": [ids], "sizes": [np.diff(at).tolist()], "counts": [[squeeze(c) for c in counts]], "cells": [spots[edge].tolist()], "times": [np.diff(np.append(edge, len(spots))).tolist()]}, schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                _, kind, _, times, ids, lengths, payload = (column[i].as_py() for column in batch.columns)
                if kind < 0:
                    if own is not None:
                        yield settle()
                    own, told = (ids, lengths, payload), {k: [] for k in range(order)}
                else:
                    told[kind].append(times)
        if own is not None:
            yield settle()

    return run


def scored(totals: tuple[int, int, int], weights: np.ndarray):
    vocabulary, n, starts = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, raw = (column[i].as_py() for column in batch.columns)
                counts = [stretch(c, "<i8") for c in raw]
                first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
                chance = chance_of(weights, counts, contexts_of(counts, first, n, starts), vocabulary)
                base = np.log10((counts[0] + 1) / (n + 1 * (vocabulary + 1)))
                m = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), first)), pa.array(np.full(m, n, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(chance), first))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one words), score (the model's log10)."""
    if order < 1:
        raise ValueError("the order must be positive")
    spark = df.sparkSession
    rows = blocks(df, id_col, text_col)
    parts = max(1, -(-rows.count() // BLOCKS_A_PART))
    asked = rows.select("block", "ids", "lengths", "payload").mapInArrow(tidy(ask(parts, order)), "part int, block long, kind int, keys binary, times binary")
    told = materialise(asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind").mapInArrow(tidy(answer), "block long, kind int, part int, times binary"), "lm-counts")
    del asked
    release(spark)
    sums = [struct.unpack("<qq", r["times"]) for r in told.where("block = -1").select("times").collect()]  # one row a part
    ids = df.select(F.coalesce(F.col(quoted(id_col)).cast("long").cast("string"), F.lit("")).alias("id"))
    starts = ids.where(F.crc32(F.col("id").cast("binary")) % FOLDS != HELD_OUT).count()
    totals = (sum(v for v, _ in sums), sum(n for _, n in sums), starts)
    own = rows.select("block", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("times"), "ids", "lengths", "payload")
    back = told.where("block >= 0").select("block", "kind", "part", "times", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<bigint>").alias("lengths"), F.lit(None).cast("binary").alias("payload"))
    together = own.unionAll(back).repartition(BLOCKS_A_PART * parts, "block").sortWithinPartitions("block", "kind", "part")
    counts = materialise(together.mapInArrow(tidy(joint(totals, order)), "ids array<long>, sizes array<long>, counts array<binary>, cells array<long>, times array<long>"), "lm-joint")
    del own, back, together
    release(spark, rows, told)
    seen = counts.select(F.explode(F.arrays_zip("cells", "times")).alias("x")).groupBy("x.cells").agg(F.sum("x.times").alias("times")).collect()  # a bounded table of cells
    weights = learn(np.array([r["cells"] for r in seen], np.int64), np.array([r["times"] for r in seen], np.int64), totals[0], order)
    if not totals[1]:
        weights[:] = [1.0] + [0.0] * order
    return counts.select("ids", "sizes", "counts").mapInArrow(tidy(scored(totals, weights)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
