"""Packing token sequences into windows.

Documents are dealt into shards as they are read (a shard is a run of one input partition with about
``SHARD_TOKENS`` tokens), and each shard is packed by itself, so nothing is shuffled, memory is bounded by the shard
and a lost task packs its own rows again:

1. whole windows are cut off documents longer than a window;
2. the rests are counted by length level (``LEVELS`` of them); all combinations of two or three levels that can fill a
   window exactly are enumerated, and non-negative least squares finds how often each is to be repeated to use up the
   histogram;
3. counts are rounded down, and each repetition takes rests of the combination's levels whose lengths add up to the
   window, so it cuts no document and needs no padding; it is left out where there are none;
4. the residual rests are packed greedily, longest first: with one, two or three others that fill the window exactly,
   wherever there are some; what finds no partners is put end to end and chopped into windows, and what is left at
   the end into powers of two, which need no padding either.

So a document is cut only where it is longer than a window or finds no partners, and nothing is padded.

Defined results: a null text is a document of one end id; a null doc_id is kept as null; repeated rows are packed
each; an empty table gives no pieces; a text longer than a shard is a shard of its own, whole; other columns, whatever
they are named, take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import quoted
from tidemark.llm.tokens import encoder
from tidemark.llm.workers import sliced, tidy

WINDOW = 4096
LEVELS = 64
SHARD_TOKENS = 4_000_000
END_ID = 2
#: Lengths that are tried as the third partner, and cuts of words that a worker remembers.
TRIED, CACHED = 8, 300_000


def patterns(levels: int = LEVELS) -> list[tuple[int, ...]]:
    """Every multiset of two or three levels whose lengths can fill a window: a level's lengths reach from above the
    level before to its own, so ``k`` of them can do so if they sum to ``levels`` or up to ``k - 1`` more."""
    return [c for k in (2, 3) for c in combinations_with_replacement(range(levels, 0, -1), k) if levels <= sum(c) < levels + k]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by active sets: the column with the steepest descent enters, columns that a
    step would make negative leave.  Each step lowers the residual, so no set comes twice; it ends where no column
    descends, or where rounding leaves nothing to gain."""
    gram, target = a.T @ a + 1e-9 * np.eye(a.shape[1]), a.T @ b  # columns may depend on each other
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    least = 0.0
    while True:
        slope = target - gram @ x
        slope[inside] = -np.inf
        enters = int(np.argmax(slope))
        if slope[enters] <= 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0))):
            return x
        before = x.copy()
        inside[enters] = True
        while inside.any():
            own = np.flatnonzero(inside)
            best = np.linalg.solve(gram[np.ix_(own, own)], target[own])
            if best.min() > 0:
                x[:] = 0
                x[own] = best
                break
            down = best <= 0
            now = x[own]
            step = float(np.min(now[down] / np.maximum(now[down] - best[down], 1e-300)))
            x[own] = now + step * (best - now)
            gone = own[down & (x[own] <= 1e-12)]
            if not len(gone):
                gone = own[[int(np.argmin(np.where(down, x[own], np.inf)))]]
            x[gone] = 0
            inside[gone] = False
            x[~inside] = 0
        value = float(x @ gram @ x / 2 - target @ x)
        if not value < least:
            return before
        least = value


class Rests:
    """The rests of one shard by exact length."""

    def __init__(self, window: int):
        self.window = window
        self.stacks: list[list[tuple[int, int]]] = [[] for _ in range(window)]  # (document, start)
        self.count = np.zeros(window, dtype=np.int64)

    def add(self, doc: int, start: int, n: int) -> None:
        self.stacks[n].append((doc, start))
        self.count[n] += 1

    def take(self, lengths: list[int]) -> list[tuple[int, int, int]] | None:
        """A rest (document, start, length) of each length; none if they are not all there."""
        if any(self.count[n] < k for n, k in Counter(lengths).items()):
            return None
        for n in lengths:
            self.count[n] -= 1
        return [(*self.stacks[n].pop(), n) for n in lengths]

    def fill(self, kind: tuple[int, ...], unit: int) -> list[tuple[int, int, int]] | None:
        """Rests of the levels of ``kind`` that fill the window: all but the last level are tried against the length
        that is missing."""
        spans = [((level - 1) * unit + 1, min(level * unit, self.window - 1)) for level in kind]
        own = [low + np.flatnonzero(self.count[low : high + 1]) for low, high in spans[:-1]]
        sums = own[0] if len(kind) == 2 else own[0][:, None] + own[1][None, :]
        missing = self.window - sums
        low, high = spans[-1]
        fits = (missing >= low) & (missing <= high)
        fits &= self.count[np.where(fits, missing, 0)] > 0
        for at in np.argwhere(fits):
            lengths = [int(o[i]) for o, i in zip(own, at, strict=True)]
            if found := self.take([*lengths, self.window - sum(lengths)]):
                return found
        return None

    def pair(self, total: int) -> list[int] | None:
        """Two lengths that sum to ``total``, as near to each other as there are."""
        there = self.count[1:total] > 0
        half = total // 2
        both = np.flatnonzero(there[:half] & there[::-1][:half]) + 1
        for a in both[::-1][:2].tolist():
            if 2 * a < total or self.count[a] > 1:
                return [a, total - a]
        return None

    def partners(self, n: int) -> list[int] | None:
        """One, two or three lengths that fill the window beside ``n``, which is taken out already."""
        missing = self.window - n
        if self.count[missing]:
            return [missing]
        if found := self.pair(missing):
            return found
        for c in (np.flatnonzero(self.count[:missing])[::-1][:TRIED]).tolist():
            self.count[c] -= 1
            found = self.pair(missing - c)
            self.count[c] += 1
            if found:
                return [c, *found]
        return None


def pack(lengths: list[int], window: int = WINDOW, levels: int = LEVELS) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths; every token in one piece."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    unit = window // levels
    rests = Rests(window)
    for doc, n in enumerate(lengths):
        whole = n - n % window
        for start in range(0, whole, window):
            out.append((doc, start, window, sequence, 0))
            sequence += 1
        if n > whole:
            rests.add(doc, whole, n - whole)

    def put(pieces: list[tuple[int, int, int]]) -> None:
        nonlocal sequence
        at = 0
        for doc, start, n in pieces:
            out.append((doc, start, n, sequence, at))
            at += n
        sequence += 1

    kinds = patterns(levels)
    use = np.zeros((levels, len(kinds)))
    for j, kind in enumerate(kinds):
        for level in kind:
            use[level - 1, j] += 1
    have = np.bincount(-(-np.arange(window) // unit), weights=rests.count, minlength=levels + 1)[1 : levels + 1]
    counts = nnls(use, have) if have.any() else np.zeros(len(kinds))
    for j in np.argsort(-counts, kind="stable").tolist():
        for _ in range(int(counts[j])):
            if not (found := rests.fill(kinds[j], unit)):
                break
            put(found)
    alone: deque[tuple[int, int, int]] = deque()
    for n in range(window - 1, 0, -1):
        while rests.count[n]:
            own = rests.take([n])
            others = rests.partners(n)
            if not others:
                alone += own
                break
            put(own + rests.take(others))
        while found := rests.take([n]):  # a length without partners stays without
            alone += found
    spare = sum(n for _, _, n in alone)
    while spare:
        size = window if spare >= window else 1 << (spare.bit_length() - 1)
        pieces, at = [], 0
        while at < size:
            doc, start, n = alone.popleft()
            taken = min(n, size - at)
            pieces.append((doc, start, taken))
            if taken < n:
                alone.appendleft((doc, start + taken, n - taken))
            at += taken
        put(pieces)
        spare -= size
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``sequence_id`` joins the pieces of a sequence.  ``with_ids`` adds the piece's
    ids as little-endian 32-bit words.  ``vocabulary`` is a tokenizer file that every executor can read."""
    if window < LEVELS or window % LEVELS:
        raise ValueError(f"the window must be a multiple of {LEVELS}")
    schema = PIECES + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, tool = TaskContext.get().partitionId() << 32, encoder(vocabulary, CACHED)
        docs: list[tuple[int | None, bytes]] = []
        size, used = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            pieces = pack([len(ids) // 4 for _, ids in docs], window)
            for i in range(0, len(pieces), 10_000):
                part = pieces[i : i + 10_000]
                cuts = [docs[doc][1][4 * start : 4 * (start + n)] for doc, start, n, _, _ in part]
                columns = [[docs[p[0]][0] for p in part], [p[1] for p in part], [p[2] for p in part], [zlib.crc32(c) for c in cuts], [len(docs[p[0]][1]) // 4 for p in part], [own + used + p[3] for p in part], [p[4] for p in part]]
                arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(cuts, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=names)
            return 1 + max((p[3] for p in pieces), default=-1)

        for batch in sliced(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tool.encode(text) + end
                docs.append((doc_id, ids))
                size += len(ids) // 4
                if size >= shard_tokens:
                    used += yield from flush()
                    docs, size = [], 0
        if docs:
            yield from flush()

    return df.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).cast("string")).mapInArrow(tidy(run, keep="tokens"), schema)
