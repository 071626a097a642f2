"""Sharding, packing, mixing, token files, WARC and the pipeline."""

import base64
import hashlib
import random
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.common import docs, write
from tidemark.llm import mixing, packing, queries, sharding, tokenfile, tokens, warc

WORDS, BYTES = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
ODD = ["a  b", "x\n y", " lead", "tail ", "", "it's 'll  12 3", "<|endoftext|> hi", "é ́x", "\t a", "İstanbul ΑΣ ς", "日本 語。 x", "a\x1cb c", "a\nb c\n\nd", "\n", "x\n", "a \nb", "Ünïcode ÀÉ. don't", "e.g. 3.5% (x)", "Foo, BAR!? ab\u00a0cd  ", "ﬁ ﬂ Ⅷ ½"]
ODD += [f"ab{m}c {m}d éf{m}{n} x{m}{n}'s y'{m}" for m in string.punctuation for n in "'.$_~1é"]


ENCODERS = {p: tokens.Encoder(p) for p in (WORDS, BYTES)}


def library(path, texts):
    tool = Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    return [np.array([*x.ids, 2], dtype="<u4").tobytes() for x in tool.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_is_the_library(path, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for bound in (1_000_000, 50):
        own = tokens.Encoder(path, bound)
        assert own.known
        assert [own.encode(t) + b"\2\0\0\0" for t in texts] == library(path, texts)
    assert own.encode(None) == b""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB é\n\t.,'!\u00a0\u3000\u0301日7\x1c", max_size=24))
def test_encoder_on_any_text(text):
    for path in (BYTES, WORDS):
        assert [ENCODERS[path].encode(text) + b"\2\0\0\0"] == library(path, [text])


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_other_vocabularies_go_to_the_library(change, tmp_path):
    import json

    path = str(tmp_path / "other.json")
    with open(BYTES) as file, open(path, "w") as out:
        json.dump(json.load(file) | change, out)
    own = tokens.Encoder(path)
    texts = [*ODD, "The Cat sat. ON the mat"]
    assert not own.known and [own.encode(t) + b"\2\0\0\0" for t in texts] == library(path, texts)


def test_surplus_places_are_walked_off(spark, monkeypatch):
    """However long the walk: here up to 9,999 steps, where the search for a good size is turned off."""
    monkeypatch.setattr(sharding, "halves", lambda n: (100, 100))
    for n in (9_990, 120, 2):
        places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 1)).collect()]
        assert sorted(places) == list(range(n))


def test_halves_leave_few_places_over():
    for n in (1, 2, 7, 1000, 4099, 10**6 + 3, 10**9 + 7, 10**12 + 39):
        a, b = sharding.halves(n)
        assert 0 <= a * b - n < max(2, n ** 0.5 / 50, 64) and (n < 100 or 0.6 < a / b < 1.7)


def test_hot_and_missing_keys_are_cut(spark, monkeypatch):
    """No window holds more than a few ranges' shares, though a third of the rows has one key and a third none."""
    monkeypatch.setattr(sharding, "RANGES", 8)
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else i, f"t{i}", "x") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cell string")
    cell, counts = sharding.cells_of(df, F.col("doc_id"), [F.col("text")], 8, 900)
    assert sum(counts) == 900 and max(counts) < 300
    numbered, n = sharding.row_numbers(df, ["doc_id", "text"])
    got = numbered.orderBy("row_number").collect()
    assert [r.row_number for r in got] == list(range(900)) == list(range(n))
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and numbered.columns == [*df.columns, "row_number"]


def test_shard_columns_are_kept(spark):
    names = ["doc_id", "_band", "_row", "_place", "shard", "slot", "row", "number", "cell", "place"]
    df = spark.createDataFrame([(i, *[f"{c}{i}" for c in names[1:]]) for i in range(40)], "doc_id long, " + ", ".join(f"{c} string" for c in names[1:]))
    got = sharding.shard_rows(df, 4, ["doc_id", "slot"])
    assert got.columns == [*names, "shard_", "slot_"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(40)) and all(tuple(r)[1:10] == tuple(f"{c}{r.doc_id}" for c in names[1:]) for r in rows)
    assert Counter(r.shard_ for r in rows) == Counter({s: 10 for s in range(4)})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4099])
def test_permutation(spark, n):
    places = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(places) == list(range(n))
    assert n < 64 or sum(abs(a - b) == 1 for a, b in zip(places, places[1:])) < 0.2 * n


def test_shards(spark):
    rows = [(i % 700 if i % 9 else None, f"t{i % 40}" if i % 11 else None) for i in range(1500)]
    df = docs(spark, rows).withColumnRenamed("lang", "shard_name").withColumnRenamed("n_chars", "count")
    got = sharding.shard_rows(df, 16, ["doc_id", "text"], seed=3)
    found = defaultdict(list)
    for r in got.collect():
        found[r.shard].append(r.slot)
    assert set(found) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in found.values())
    sizes = [len(s) for s in found.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1500
    key = lambda d: sorted(map(str, d.select("doc_id", "text", "shard", "slot").collect()))
    assert key(got) == key(sharding.shard_rows(df.repartition(7), 16, ["doc_id", "text"], seed=3))
    assert sharding.shard_rows(df.limit(0), 16, ["doc_id"]).count() == 0
    assert got.columns[:5] == df.columns


def test_nnls():
    rng = np.random.default_rng(1)
    a, x = rng.random((20, 30)), np.maximum(rng.normal(size=30), 0)
    found = packing.nnls(a, a @ x)
    assert (found >= 0).all() and np.linalg.norm(a @ found - a @ x) < 1e-4


def check_pieces(lengths, pieces, window):
    covered, placed = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pieces:
        assert n > 0
        covered[doc].append((start, n))
        placed[sequence].append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(covered[doc]):
            assert start == at
            at += k
        assert at == n
    padding = 0
    for spans in placed.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(placed) == list(range(len(placed)))
    return padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=60))
def test_pack_any_lengths(lengths):
    assert check_pieces(lengths, packing.pack(lengths, 256), 256) == 0


def chopped(lengths, window=4096):
    """(pieces, sequences) of putting all documents end to end and chopping."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return int(((ends - 1) // window - starts // window + 1).sum()), -(-int(ends[-1]) // window)


def test_combinations_save_cuts(spark, sf_dir):
    rng = np.random.default_rng(3)
    real = [len(raw) // 4 for raw in library(WORDS, [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])]
    for lengths in ([int(x) for x in np.clip(rng.lognormal(6, 1.1, 3000), 1, 30_000)], [int(x) for x in rng.choice([1000, 1048, 2048, 3000, 4096], 2000)], real * 3):
        pieces = packing.pack(lengths)
        assert check_pieces(lengths, pieces, 4096) == 0
        cuts, sequences = chopped(np.array(lengths))
        needed = sum(-(-n // 4096) for n in lengths)  # no way does with fewer
        assert len(pieces) - needed < 0.4 * (cuts - needed) + 12
        assert len({p[3] for p in pieces}) <= sequences + 12  # powers of two at the end
    assert all(64 <= sum(c) < 64 + len(c) for c in packing.patterns()) and len(set(packing.patterns())) == len(packing.patterns())


def test_nnls_ends_on_hard_problems():
    rng = np.random.default_rng(2)
    for n in (5, 40):
        a = rng.integers(0, 3, (n, 4 * n)).astype(float)
        a[:, n:] = a[:, rng.integers(0, n, 3 * n)]  # columns repeat
        b = rng.random(n) * 10**6
        found = packing.nnls(a, b)
        slope = a.T @ (b - a @ found)
        assert (found >= 0).all() and slope.max() <= 1e-4 * np.abs(a.T @ b).max()
    assert packing.nnls(np.ones((3, 4)), np.zeros(3)).tolist() == [0] * 4


def test_packed_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(9001, None), (9002, ""), (None, "x y"), (9003, "word " * 30_000), (9003, "again")]
    df = docs(spark, rows).withColumnRenamed("lang", "start")
    ids = defaultdict(list)
    for (i, t), raw in zip(rows, library(WORDS, [t or "" for _, t in rows])):
        ids[i].append(raw)
    got = packing.pack_texts(df, WORDS, shard_tokens=20_000, with_ids=True).collect()
    seen = Counter()
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        assert any(raw[4 * r.start : 4 * (r.start + r.length)] == bytes(r.ids) and len(raw) == 4 * r.doc_tokens for raw in ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == Counter({i: sum(map(len, raws)) // 4 for i, raws in ids.items()})
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert packing.pack_texts(df.limit(0), WORDS).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=20), st.data())
def test_token_file_round_trip(docs_, data):
    rows = [(i if i % 3 else None, np.array(d, dtype="<u4").tobytes()) for i, d in enumerate(docs_ * 4)]
    file = tokenfile.TokenFile(tokenfile.write_file(rows))
    assert file.doc_ids == [i for i, _ in rows]
    for i, (_, raw) in enumerate(rows):
        assert file.document(i).astype("<u4").tobytes() == raw
    assert file.all_tokens().astype("<u4").tobytes() == b"".join(r for _, r in rows)
    i = data.draw(st.integers(0, len(rows) - 1))
    n = len(rows[i][1]) // 4
    a = data.draw(st.integers(0, n - 1))
    b = data.draw(st.integers(a + 1, n))
    assert file.stretch(i, a, b).tolist() == file.document(i)[a:b].tolist()


def test_token_file_compresses_and_checks():
    rng = random.Random(2)
    raw = np.array([rng.choice([[1, 2, 3], [4, 5], [9]]) for _ in range(1)][0] * 5000, dtype="<u4").tobytes()
    content = tokenfile.write_file([(1, raw)])
    assert len(content) < len(raw) / 4
    with pytest.raises(ValueError):
        tokenfile.TokenFile(content[:-1])


def test_token_file_replaces_every_repeat():
    rng = np.random.default_rng(5)
    fresh = rng.integers(0, 60_000, 40_000)  # twice: tens of thousands of pairs, each of two uses only
    phrase = rng.integers(0, 60_000, 1_000)  # a repeat of ten levels
    rare = [np.array([7, 7, 7, 7, 7, 9] * k) for k in range(1, 6)]
    docs_ = [fresh, phrase, fresh, *[np.concatenate((rng.integers(0, 60_000, 3), phrase)) for _ in range(30)], *rare, np.arange(59_000, 60_000), np.arange(59_000, 60_000)]
    file = tokenfile.TokenFile(tokenfile.write_file([(i, np.asarray(d, dtype="<u4").tobytes()) for i, d in enumerate(docs_)]))
    uses = Counter()
    for i, d in enumerate(docs_):
        assert file.document(i).tolist() == list(d)
        own = file.symbols[file.first[i] : file.first[i + 1]].tolist()
        end = {}
        for at, pair in enumerate(zip(own, own[1:])):
            if end.get(pair, -1) < at:
                uses[pair] += 1
                end[pair] = at + 1
    assert max(uses.values()) == 1


def test_token_files(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(5000, None), (5001, "word " * 30_000)]
    df = docs(spark, rows).withColumnRenamed("lang", "part")
    files = tokenfile.write_files(df, BYTES, file_tokens=10_000)
    got = {r.doc_id: r for r in tokenfile.read_files(files, with_ids=True).collect()}
    at = 0
    for (i, _), raw in zip(sorted(rows), library(BYTES, [t or "" for _, t in sorted(rows)])):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, bytes(got[i].ids)) == (at, len(raw) // 4, zlib.crc32(raw), raw)
        at += len(raw) // 4
    assert files.count() > 4
    assert tokenfile.read_files(tokenfile.write_files(docs(spark, [(None, "a"), (1, "b"), (1, "b")]), BYTES)).count() == 3
    assert tokenfile.read_files(tokenfile.write_files(df.limit(0), BYTES)).count() == 0


def test_warc(spark):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/\r\nX: y", "<p>x</p>"), (7, None, None), (5, "u", ""), (9, "u", "é" * 100_000), (9, "u", "é" * 100_000), (None, "u", "<p>x</p>"), (None, "u", "solo")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    df = df.withColumn("tag", F.lit(2)).withColumn("salt", F.lit("x")).withColumn("key", F.lit(0))
    archives = warc.write_archives(df, archive_bytes=2000)
    heads = [raw.partition(b"\r\n\r\n")[0].decode().split("\r\n") for r in archives.collect() for raw in warc.open_archive(bytes(r.content))]
    own = [next(h for h in head if h.startswith("WARC-Record-ID")).split(": ")[1] for head in heads]
    named = [h.split(": ")[1] for head in heads for h in head if h.startswith("WARC-Refers-To:")]
    assert len(set(own)) == len(rows) and len(named) == 3 and set(named) <= set(own)
    got = warc.read_archives(archives, payloads=True).collect()
    assert len(got) == len(rows)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = Counter((i, len((h or "").encode()), digest(h)) for i, _, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    kinds = {(r.page_id, r.payload_digest): (r.record_type, r.refers_to) for r in got}
    assert kinds[3, digest("<p>x</p>")] == ("revisit", 1) and kinds[1, digest("<p>x</p>")] == ("response", None) and kinds[7, digest("")] == ("revisit", 5)
    assert kinds[None, digest("<p>x</p>")] == ("revisit", 1) and kinds[None, digest("solo")] == ("response", None)
    assert all(bytes(r.payload) == ("é" * 100_000).encode() for r in got if r.page_id == 9)
    few = {(r.page_id, r.record_type) for r in warc.read_archives(warc.write_archives(df, min_bytes=9)).collect()}
    assert (7, "response") in few and (3, "response") in few
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_validates():
    good = warc.record("response", 1, "u", b"abc", warc.sha1_base32(b"abc"), None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 4"), good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Type", b"WARC-Tipe"), b"HTTP" + good):
        with pytest.raises(ValueError):
            warc.parse(bad)
    words = warc.train_dictionary([good * 3 + bytes([i]) for i in range(200)])
    import struct

    import zstandard

    tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor()
    archive = struct.pack("<II", warc.DICTIONARY_MAGIC, len(words)) + words + tool.compress(good) + tool.compress(good * 1)
    assert list(warc.open_archive(archive)) == [good, good]
    with pytest.raises(ValueError):
        list(warc.open_archive(archive[:-3]))


def test_mix_is_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql("SELECT doc_id, source, n_copies, copy FROM (" + mixing.ORACLE.format(seed=17) + ")").fetchall()
    got = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), seed=17, details=True).select("doc_id", "source", "n_copies", "copy").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_mix_follows_targets(spark):
    df = docs(spark, [(i, "x" * 9, "a" if i % 10 else "b") for i in range(4000)]).withColumnRenamed("lang", "copy")
    got = Counter(r.source for r in mixing.mix(df, weights={"a": 1.0, "b": 1.0}).collect())
    assert abs(got["a"] - 2000) < 200 and abs(got["b"] - 2000) < 200
    assert Counter(r.source for r in mixing.mix(df, weights={"b": 1.0}).collect()).keys() == {"b"}


def test_poisson(spark):
    rate = 3.7
    got = Counter(r[0] for r in spark.range(20_000).select(mixing.copies(mixing.distribution(F.lit(rate)), F.lit(1), 1, F.col("id"))).collect())
    import math

    for k in range(9):
        assert abs(got[k] / 20_000 - math.exp(-rate) * rate**k / math.factorial(k)) < 0.012
    many = [r[0] for r in spark.range(2000).select(mixing.copies(mixing.distribution(F.lit(100.0) / 7), F.lit(7), 1, F.col("id"))).collect()]
    assert abs(np.mean(many) - 100) < 1.5 and abs(np.var(many) - 100) < 15


def test_mix_columns_are_kept(spark):
    names = ["doc_id", "text", "source", "__n", "__copy", "__place", "__source", "__rate", "__table", "__draws", "row", "id", "own", "place", "copy", "n_copies", "rate", "table", "at", "salt"]
    df = spark.createDataFrame([(i, "t" * (i % 7), f"s{i % 3}", *[f"{c}{i}" for c in names[3:]]) for i in range(60)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names[3:]))
    plain = sorted(r.doc_id for r in mixing.mix(df.select("doc_id", "text", "source")).collect())
    got = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in got) == plain and all(tuple(r)[3:] == tuple(f"{c}{r.doc_id}" for c in names[3:]) for r in got)
    told = mixing.mix(df, details=True)
    assert told.columns == [*names, "rate_", "n_copies_", "copy_", "place_"] and told.count() == len(plain)


def test_mix_of_many_sources(spark, monkeypatch):
    """Beyond the table that is broadcast, the same mixture comes by salted keys."""
    df = docs(spark, [(i, "x" * (i % 50), f"s{i % 40 if i % 3 else 0}" if i % 20 else None) for i in range(600)])
    rows = lambda: sorted(map(str, mixing.mix(df, details=True).select("doc_id", "source", "copy", "place").collect()))
    want = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert rows() == want


def test_mix_edges(spark):
    df = docs(spark, [(1, None, None), (1, None, None), (None, "", "a"), (2, "x" * 200_000, "a")]).withColumnRenamed("lang", "rate")
    got = mixing.mix(df)
    assert got.columns == df.columns
    copies = Counter((r.doc_id, r.source) for r in got.collect())
    assert copies[1, None] % 2 == 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_jaccard import brute
    from tests.llm.test_quality import PROSE
    from tidemark.llm import quality

    rng = random.Random(8)
    rows = []
    for i in range(30):
        words = [f"{rng.choice(['am', 'be', 'co', 'du'])}{rng.randrange(500)}" for _ in range(80)]
        rows.append((10 * i, " ".join(words) + ".", f"s{i % 3}"))
        rows.append((10 * i + 1, " ".join(words[:-1]) + " changed.", f"s{i % 3}"))
    rows[0] = (0, rows[0][1] + "\nRead more", "s0")  # a line that goes
    rows += [(1000, "too short.", "s0"), (1001, None, "s0"), (1002, "Home | About | Login\n" * 40, "s1"), (1003, PROSE, None)]
    df = docs(spark, rows).withColumnRenamed("lang", "kept")
    sf = write(spark, tmp_path, df)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "source_mix", "packing"]
    rows_ = [(i, quality.figures([t or ""], quality.LEAST_KEPT)[0], s) for i, t, s in rows]
    good = {i: (f[11], s) for i, f, s in rows_ if f[10]}
    kept = {i for i, (_, c) in brute([(i, t) for i, (t, _) in good.items()], 5, 80).items() if i == c}
    docs_, steps = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs_ = stage(spark, docs_, sf)
        assert docs_.columns == df.columns
        steps.append({r.doc_id for r in docs_.collect()})
    assert steps == [set(good), kept] and 1003 in kept and len(kept) == 31
    assert {r.doc_id: (r.text, r.n_chars) for r in docs_.collect()} == {i: (good[i][0], len(good[i][0])) for i in kept} and not any("Read more" in t for t, _ in good.values())
    copies = Counter(r.doc_id for r in mixing.mix(docs_, seed=17).collect())
    tokens_ = {i: len(raw) // 4 for i, raw in zip(kept, library(WORDS, [good[i][0] for i in kept]))}
    got = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == Counter({i: n * tokens_[i] for i, n in copies.items()})
