"""Token-id files compressed by Re-Pair.

A file holds a run of documents: a header, the rules, a table of documents (id, symbols, tokens) and the symbols.
Rules replace pairs inside a document only, so any document - and, by the lengths that the rules expand to, any
stretch of its tokens - can be decoded from its own symbols.

Re-Pair works in rounds over the symbols of one file: all pairs are counted exactly, those used twice or more compete
for the places where they overlap, and the winners become nonterminals.  Rounds go on until no pair is used twice
without overlap, whatever the number of rules; symbols and rules take as many bits as the largest symbol needs.  A
round's rules name only ids and nonterminals of earlier rounds.

Spark's writers carry the files as rows of a Parquet table in the shared folder.  Documents are cut into ranges of
ascending doc_id by quantiles; a task writes the files of its range, and each file knows how many tokens its task
wrote before it.  An id (or null) that holds more than a range's share is cut by a hash of the text.

Defined results: a null text is a document of just its end id; null doc_ids come first; repeated rows are written
each, those of one id next to each other; an empty table gives no files; a text longer than a file is in a file of its
own, whole; other columns, whatever they are named, take no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise, partitions_for, quoted
from tidemark.llm.sharding import cells_of, constants
from tidemark.llm.tokens import encoder
from tidemark.llm.workers import sliced, tidy

MAGIC = b"TIDERP02"
HEAD = struct.Struct("<8sIIQQQII")  # magic, first nonterminal, rounds, documents, symbols, tokens, rules, bits a symbol
FILE_TOKENS = 2_000_000
#: A rule takes the place of two symbols in the file, so a pair pays from its second use on.
LEAST_USES = 2
#: Cuts of words that a worker remembers.
CACHED = 1_000_000


def groups_of(left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int, at_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct pairs as 64-bit keys ascending, how often each occurs, the positions ``at`` in order of pairs)."""
    keys = left.astype(np.uint64)
    if 2 * bits + at_bits <= 64:  # one sort of pair and position together
        keys <<= np.uint64(bits)
        keys |= right
        keys <<= np.uint64(at_bits)
        keys |= at.view(np.uint64)
        keys.sort()
        at = (keys & np.uint64((1 << at_bits) - 1)).view(np.int64)
        keys >>= np.uint64(at_bits)
    else:
        bits = 32
        keys <<= np.uint64(32)
        keys |= right
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    edges = np.flatnonzero(new)
    first = keys[edges]
    pairs = ((first >> np.uint64(bits)) << np.uint64(32)) | (first & np.uint64((1 << bits) - 1))
    return pairs, np.diff(edges, append=len(keys)), at


def repair(symbols: np.ndarray, last: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, last marks, rules of each round).  ``last`` marks the last symbol of each document.

    Symbols close up after each round.  A round sorts only the positions that may still hold a pair used twice: those
    that held one in the round before, and the neighbours of new symbols."""
    symbols, last = symbols.copy(), last.copy()
    live = ~last
    rounds: list[np.ndarray] = []
    while len(at := np.flatnonzero(live)):
        n = len(symbols)
        left, right = symbols[at], symbols[at + 1]
        # in a run of one symbol every other position can begin a pair
        twin = np.flatnonzero(left == right)
        count = np.arange(len(twin))
        odd = twin[(count - np.maximum.accumulate(np.where(np.diff(at[twin], prepend=-2) != 1, count, 0))) % 2 == 1]
        skipped = at[odd]
        if len(odd):
            left, right, at = (np.delete(x, odd) for x in (left, right, at))
        pairs, uses, places = groups_of(left, right, at, (base - 1).bit_length(), n.bit_length())
        often = uses >= LEAST_USES
        if not often.any():
            break
        which = np.zeros(n, np.int32)
        which[places] = np.repeat(np.cumsum(often, dtype=np.int32) * often, uses)  # 0: used once
        pairs, uses = pairs[often], uses[often]
        which = which[at]  # in order of positions from here on
        at, which = at[which > 0], which[which > 0]
        # of overlapping pairs the more frequent wins, by powers of two; a bijective mix orders the others
        mix = (np.arange(len(pairs), dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64((1 << 27) - 1)
        own = ((np.frexp(uses)[1].astype(np.uint32) << np.uint32(27)) | mix.astype(np.uint32))[which - 1]
        weight = np.zeros(n + 1, np.uint32)  # the place behind all is before the first as well
        weight[at] = own
        wins = (weight[at - 1] < own) & (weight[at + 1] < own)
        used = np.bincount(which[wins], minlength=len(pairs) + 1) >= LEAST_USES
        wins &= used[which]
        hit = at[wins]
        rank = np.cumsum(used, dtype=np.uint32) + np.uint32(base - 1)
        symbols[hit] = rank[which[wins]]
        last[hit] = last[hit + 1]
        live = np.zeros(n, bool)
        live[at] = live[skipped] = live[hit - 1] = True  # the one before the first is the last of all, which ends
        stays = np.ones(n, bool)
        stays[hit + 1] = False
        symbols, last, live = symbols[stays], last[stays], live[stays]
        live &= ~last
        rounds.append(pairs[used[1:]])
        base += len(rounds[-1])
    return symbols, last, rounds


def sizes_of(base: int, rounds: list[np.ndarray]) -> np.ndarray:
    """Tokens that each symbol expands to."""
    sizes = np.ones(base + sum(len(r) for r in rounds), dtype=np.int64)
    at = base
    for pairs in rounds:
        sizes[at : at + len(pairs)] = sizes[pairs >> np.uint64(32)] + sizes[pairs & np.uint64(0xFFFFFFFF)]
        at += len(pairs)
    return sizes


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every symbol's tokens, each written to its place."""
    ends = np.cumsum(sizes[symbols])
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    at = ends - sizes[symbols]
    while len(symbols):
        token = symbols < base
        out[at[token]] = symbols[token]
        which, at = rules[symbols[~token] - base], at[~token]
        left = (which >> np.uint64(32)).astype(np.uint32)
        symbols = np.concatenate((left, (which & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
        at = np.concatenate((at, at + sizes[left]))
    return out


def joined(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``at``, end to end."""
    skipped = at - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(skipped, sizes) + np.arange(int(sizes.sum()))]


def expand_all(symbols: np.ndarray, base: int, rounds: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """As ``expand``, for many symbols: rules are expanded first, each round's from what stands before it."""
    ends = np.cumsum(sizes)
    flat, at = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32), ends - sizes
    flat[:base] = np.arange(base)
    done = base
    for pairs in rounds:
        sides = np.column_stack((pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF))).astype(np.int64).ravel()
        whole = joined(flat, at[sides], sizes[sides])
        flat[done : done + len(whole)] = whole
        done += len(whole)
    return joined(flat, at[symbols], sizes[symbols])


def packed(values: np.ndarray, bits: int) -> bytes:
    """Whole bytes of each value first, then the bits above them."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    whole, rest = divmod(bits, 8)
    high = np.packbits(np.unpackbits(raw[:, whole : whole + 1], axis=1)[:, 8 - rest :]).tobytes() if rest else b""
    return raw[:, :whole].tobytes() + high


def unpacked(content: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """(values, where the next field begins)."""
    whole, rest = divmod(bits, 8)
    raw = np.zeros((n, 4), np.uint8)
    raw[:, :whole] = np.frombuffer(content, np.uint8, n * whole, at).reshape(n, whole)
    at += n * whole
    if rest:
        high = np.frombuffer(content, np.uint8, -(-n * rest // 8), at)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, 8 - rest :] = np.unpackbits(high, count=n * rest).reshape(n, rest)
        raw[:, whole] = np.packbits(wide, axis=1)[:, 0]
        at += len(high)
    return raw.view("<u4")[:, 0].astype(np.uint32), at


def write_file(docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file of documents given as (id, little-endian 32-bit token ids, at least one)."""
    tokens = np.array([len(ids) // 4 for _, ids in docs], dtype=np.uint32)
    ids = np.frombuffer(b"".join(x for _, x in docs), dtype="<u4").astype(np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(tokens, dtype=np.int64) - 1] = True
    base = int(ids.max(initial=0)) + 1
    symbols, marks, rounds = repair(ids, last, base)
    per_doc = np.diff(np.concatenate(([-1], np.flatnonzero(marks)))).astype("<u4")
    bits = (base + sum(len(r) for r in rounds) - 1).bit_length()
    rules = np.concatenate(rounds) if rounds else np.zeros(0, np.uint64)
    body = b"".join([
        HEAD.pack(MAGIC, base, len(rounds), len(docs), len(symbols), len(ids), len(rules), bits),
        np.array([len(r) for r in rounds], dtype="<u4").tobytes(),
        packed(np.concatenate((rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF))), bits),
        np.array([i is None for i, _ in docs], dtype=np.uint8).tobytes(),
        np.array([i or 0 for i, _ in docs], dtype="<i8").tobytes(),
        per_doc.tobytes(),
        tokens.astype("<u4").tobytes(),
        packed(symbols, bits),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, content: bytes):
        if len(content) < HEAD.size + 4 or zlib.crc32(content[:-4]) != struct.unpack("<I", content[-4:])[0]:
            raise ValueError("the file's checksum differs")
        magic, self.base, n_rounds, n_docs, n_symbols, self.n_tokens, n_rules, bits = HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            found = np.frombuffer(content, dtype=kind, count=n, offset=self.at)
            self.at += found.nbytes
            return found

        cuts = np.cumsum(take("<u4", n_rounds).astype(np.int64))[:-1]
        sides, self.at = unpacked(content, self.at, 2 * n_rules, bits)
        self.rules = (sides[:n_rules].astype(np.uint64) << np.uint64(32)) | sides[n_rules:]
        self.rounds = np.split(self.rules, cuts)
        self.sizes = sizes_of(self.base, self.rounds)
        nulls, ids = take("u1", n_docs), take("<i8", n_docs)
        self.doc_ids = [None if n else int(i) for n, i in zip(nulls, ids, strict=True)]
        self.first = np.concatenate(([0], np.cumsum(take("<u4", n_docs).astype(np.int64))))
        self.tokens = take("<u4", n_docs).astype(np.int64)
        self.symbols, self.at = unpacked(content, self.at, n_symbols, bits)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.first[i] : self.first[i + 1]], self.base, self.rules, self.sizes)

    def stretch(self, i: int, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end`` of document ``i``: only the symbols that cover them are expanded."""
        own = self.symbols[self.first[i] : self.first[i + 1]]
        ends = np.cumsum(self.sizes[own])
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, end, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(own[a:b], self.base, self.rules, self.sizes)[start - skipped : end - skipped]

    def all_tokens(self) -> np.ndarray:
        return expand_all(self.symbols, self.base, self.rounds, self.sizes)


def write_files(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """All documents as files: part, number, docs, tokens, tokens_before (of the same part), content."""
    spark = df.sparkSession
    source = df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    n, total = partitions_for(spark), source.count()
    cell, counts = cells_of(source, F.col("doc_id"), [F.col("text")], n, total)
    # cells side by side share a partition
    parts, before = [], 0
    for size in counts:
        parts.append(min(n - 1, before * n // max(total, 1)))
        before += size
    dealt = source.select("doc_id", "text", cell.alias("cell"))
    ranged = dealt.repartitionById(n, F.get(constants(parts), F.col("cell")).cast("int")).sortWithinPartitions("cell", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()).select("doc_id", "text")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        tool = encoder(vocabulary, CACHED)
        docs: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "docs": [len(docs)], "tokens": [size], "tokens_before": [before], "content": [write_file(docs)]})

        for batch in sliced(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tool.encode(text) + end
                docs.append((doc_id, ids))
                size += len(ids) // 4
                if size >= file_tokens:
                    yield flush()
                    docs, size, number, before = [], 0, number + 1, before + size
        if docs:
            yield flush()

    return materialise(ranged.mapInArrow(tidy(run, keep="tokens"), "part int, number int, docs long, tokens long, tokens_before long, content binary"), "token-files")


def read_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 (and the ids as little-endian 32-bit words)."""
    spark = files.sparkSession
    sizes = {r["part"]: r["tokens"] for r in files.groupBy("part").agg(F.sum("tokens").alias("tokens")).collect()}  # one row a part
    starts, at = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(part, 0)
    offsets = spark.sparkContext.broadcast(starts)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                file = TokenFile(content)
                raw = memoryview(file.all_tokens().astype("<u4").tobytes())
                ends = np.cumsum(file.tokens)
                begins = ends - file.tokens
                parts = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                arrays = [pa.array(file.doc_ids, pa.int64()), pa.array(begins + offsets.value[part] + before, pa.int64()), pa.array(file.tokens, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                arrays += [pa.array([bytes(p) for p in parts], pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return files.select("part", "tokens_before", "content").mapInArrow(tidy(run, keep="tokens"), schema)
