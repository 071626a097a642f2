"""Language model, URL filter and nearest neighbours."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import LOWER, WORD, docs
from tidemark.llm import ann, lm, queries, urlfilter


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def test_lm_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    own = {r.doc_id: tokens(r.text) for r in rows}
    trained = {i for i in own if zlib.crc32(str(i).encode()) % 7 != 2}
    word, pair = Counter(), Counter()
    for i in trained:
        word.update(own[i])
        pair.update(zip(["<"] + own[i], own[i]))
    n, v, base, score = sum(word.values()), len(word), 0.0, 0.0
    starts = len(trained)
    seen = lambda t: [np.array(x) for x in ([word[w] for w in t], [pair[p] for p in zip(["<"] + t, t)])]
    behind = lambda t: [np.full(len(t), n), np.array([starts] + [word[w] for w in t[:-1]])]
    cells = Counter(c for i in trained for c in lm.cells_of(seen(own[i]), behind(own[i]), lm.an_octave(2)).tolist())
    weights = lm.learn(np.array(list(cells)), np.array(list(cells.values())), v, 2)
    for i, t in own.items():
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(t), sum(word[w] > 0 for w in t), n, i not in trained)
        assert g.score == pytest.approx(float(np.log10(lm.chance_of(weights, seen(t), behind(t), v)).sum()), rel=1e-9)
        assert g.base_score == pytest.approx(sum(math.log10((word[w] + 1) / (n + 1 * (v + 1))) for w in t), rel=1e-12)
        if i not in trained:
            base, score = base + g.base_score, score + g.score
    assert score > base  # the model says more on held-out texts


    # behind any context the chances of all words and of one unseen word add up to one
    after = Counter()
    for i in trained:
        after.update((["<"] + own[i])[:-1])
    words = list(word)
    for u in [*list(after)[:20], None, "never seen"]:
        contexts = [np.full(v + 1, n), np.full(v + 1, starts if u == "<" else 0 if u is None else word[u])]
        counts = [np.array([word[w] for w in words] + [0]), np.array([pair[u, w] if u is not None else 0 for w in words] + [0])]
        assert lm.chance_of(weights, counts, contexts, v).sum() == pytest.approx(1.0)


def test_lm_weights_and_chance():
    wide = 2 + lm.an_octave(2) * lm.DEEPEST
    cells = np.array([(3 * wide + 40) * wide + 1, (3 * wide + 30) * wide + 0])
    weights = lm.learn(cells, np.array([90, 10]), 100, 2)
    assert weights.sum(axis=1) == pytest.approx(np.ones(len(weights))) and weights[3, 2] > 0.8 and (weights >= 0).all()


def test_lm_takes_counts_of_any_size():
    """Beyond 2 ** 39, and up to the largest count there is."""
    for big in (2**39, 2**40, 2**52, 2**62):
        counts, contexts = [np.array([big, 1]), np.array([big // 2, 1])], [np.array([2 * big - 1] * 2), np.array([big, big])]
        cells = lm.cells_of(counts, contexts, lm.an_octave(2))
        weights = lm.learn(cells, np.array([1, 1]), 10, 2)
        chance = lm.chance_of(weights, counts, contexts, 10)
        assert np.isfinite(chance).all() and (chance > 0).all() and (chance < 1).all()
    assert lm.cell(np.array([2.0**-60, 2.0**-61]), 4).tolist() == [241, 245]  # rare chances stay apart


def test_lm_of_order_three(spark):
    texts = ["a b c d", "a b c e", "x b c d", "a b c d e f"] * 8
    df = docs(spark, [*enumerate(texts)])
    two, three = ({r.doc_id: r for r in lm.score(df, order=k).collect()} for k in (2, 3))
    held = [i for i in range(len(texts)) if lm.held_out(i)]
    assert held and sum(three[i].score for i in held) > sum(two[i].score for i in held)
    own = [tokens(t) for t in texts]
    counts = [Counter(), Counter(), Counter()]
    for i, t in enumerate(own):
        if i not in held:
            for k in range(3):
                marks = ["<"] * k + t
                counts[k].update(tuple(marks[j : j + k + 1]) for j in range(len(t)))
    n, v, starts = sum(counts[0].values()), len(counts[0]), len(texts) - len(held)

    def told(t):
        got = [np.array([counts[k][tuple((["<"] * k + t)[j : j + k + 1])] for j in range(len(t))]) for k in range(3)]
        return got, [np.full(len(t), n), *[np.array([starts, *got[k][:-1]]) for k in range(2)]]

    cells = Counter(c for i, t in enumerate(own) if i not in held for c in lm.cells_of(*told(t), lm.an_octave(3)).tolist())
    weights = lm.learn(np.array(list(cells)), np.array(list(cells.values())), v, 3)
    for i, t in enumerate(own):
        assert three[i].score == pytest.approx(float(np.log10(lm.chance_of(weights, *told(t), v)).sum()), rel=1e-9)


def test_lm_is_a_distribution(spark):
    texts = ["a b a c", "b a", "c c a b", "a a a", "b c", "a b"]
    df = docs(spark, [*enumerate(texts), (50, "zz"), (51, "a")])
    got = {r.doc_id: r for r in lm.score(df).collect()}
    assert all(r.score < 0 for r in got.values()) and got[50].score < got[51].score


def test_lm_edges(spark):
    df = docs(spark, [(1, None), (1, None), (2, ""), (None, "a b"), (3, "A a"), (4, "w " * 300_000)]).withColumnRenamed("lang", "block").withColumnRenamed("source", "score")
    rows = lm.score(df).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter({(1, 1): 2, (2, 1): 1, (None, 3): 1, (3, 3): 1, (4, 300_001): 1})
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm.score(df.limit(0)).count() == 0
    assert [r.score for r in lm.score(docs(spark, [(i, None) for i in range(200) if lm.held_out(i)][:1])).collect()] == [0.0]


URLS = [
    ("http://A.Example.org/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://shop.com/fr/a", "shop.com", "/fr/a", "com/fr/", "allow"),
    ("https://shop.com/de/", "shop.com", "/de/", "com/de/", "block"),
    ("https://shop.com/defg", "shop.com", "/defg", None, None),
    ("https://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    ("x://h?q://org/", "h", "", None, None),
    ("http://org", "org", "", None, None),
    ("no address", "", "", None, None),
    (None, "", "", None, None),
    ("ÄÖ://ÄB.COM/é?", "Äb.com", "/é", None, None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u[0], 1) for i, u in enumerate(URLS)], "page_id long, url string, score int").withColumnRenamed("score", "label")
    rows = urlfilter.judge(df, queries.URL_RULES, urlfilter.fit(urlfilter.weak_labels(df, queries.URL_RULES))).orderBy("page_id").collect()
    for r, (_, host, path, rule, verdict) in zip(rows, URLS, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    none = urlfilter.fit(urlfilter.weak_labels(df.limit(0), queries.URL_RULES))
    assert urlfilter.judge(df.limit(0), queries.URL_RULES, none).count() == 0
    assert {r.verdict for r in urlfilter.judge(df.where("page_id > 4 and page_id < 6"), [], none).collect()} == {"allow"}


def murmur(data, seed=42):
    """The engine's hash of a string, by its definition."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: (x << r | x >> 32 - r) & mask
    words = [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data) - len(data) % 4, 4)]
    words += [(b - 256 if b > 127 else b) & mask for b in data[len(data) - len(data) % 4 :]]
    for k in words:
        h = (turn(h ^ turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    h ^= len(data)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * times & mask
    return h - (1 << 32) if h >> 31 else h


def features(host, path):
    text = f"^{host}{path}$"
    return {murmur(text[i : i + n].encode()) % urlfilter.BUCKETS for n in urlfilter.GRAMS for i in range(max(1, len(text) - n + 1))}


def test_url_model_against_brute_force(spark):
    """Hashing, fit and score by their definitions, rule verdicts before the model's."""
    rows = [(i, f"http://{'b\u00fccher' if i % 3 else 'spiel'}{i % 40}.{'com' if i % 2 else 'org'}/{'de' if i % 5 else 'fr'}/{i % 60}") for i in range(300)] + [(900, None), (901, "http://x.net/\u65e5\u672c"), (902, "http://x.net/" + "y" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labelled = urlfilter.weak_labels(df, queries.URL_RULES)
    model = urlfilter.fit(labelled)
    table = sorted({(r.host, r.path, float(r.label)) for r in labelled.collect()})
    own, y = [features(h, p) for h, p, _ in table], np.array([t for _, _, t in table])
    share = min(max(y.mean(), 0.5 / len(y)), 1 - 0.5 / len(y))
    bias, weights, width = math.log(share / (1 - share)), np.zeros(urlfilter.BUCKETS), np.mean([len(f) for f in own])
    for _ in range(urlfilter.STEPS):
        chance = 1 / (1 + np.exp(-np.array([bias + sum(weights[i] for i in f) for f in own])))
        up, down = np.zeros(urlfilter.BUCKETS), np.zeros(urlfilter.BUCKETS)
        for f, g, h in zip(own, y - chance, chance * (1 - chance)):
            up[list(f)] += g
            down[list(f)] += h
        there = np.isin(np.arange(urlfilter.BUCKETS), list(set().union(*own)))
        weights += np.where(there, (up - weights / width) / (down * math.sqrt(width) + 1.0), 0)
    assert model.bias == pytest.approx(bias) and model.weights == pytest.approx(weights.tolist(), abs=1e-9)
    for r in urlfilter.judge(df, queries.URL_RULES, model).collect():
        assert r.score == pytest.approx(bias + sum(weights[i] for i in features(r.host, r.path)), abs=1e-7)
        assert r.rule is not None or r.verdict == ("block" if r.score > 0 else "allow")


def test_url_sample_is_of_distinct_addresses(spark):
    rows = [("same.net", "/x", 1)] * 500 + [(f"h{i}.net", "/", i % 2) for i in range(60)] + [("both.net", "/", 0), ("both.net", "/", 1), ("none.net", "/", None)]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    every = urlfilter.distinct_sample(df, 4096).collect()
    assert len(every) == 62 and {r.label for r in every if r.host == "both.net"} == {0.5}
    few = urlfilter.distinct_sample(df, 10).collect()
    assert len({r.host for r in few}) == 10 and {r.host for r in few} <= {r.host for r in every}


def test_url_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "H", 5.0, "old")], "page_id long, url string, host string, score double, verdict string")
    got = urlfilter.judge(df, queries.URL_RULES, urlfilter.UrlModel(0.0, [0.0] * 8))
    assert got.columns == [*df.columns, "host_", "path", "rule", "score_", "verdict_"]
    assert tuple(got.first()) == (1, "http://a.org/", "H", 5.0, "old", "a.org", "/", "org/", 0.0, "allow")


def test_url_model_learns(spark):
    rows = [(f"http://{'casino' if i % 2 else 'library'}{i}.net/{'spin' if i % 2 else 'book'}/{i * 7}", i % 2) for i in range(400)]
    df = urlfilter.with_parts(spark.createDataFrame(rows, "url string, label int"))
    model = urlfilter.fit(df.where(F.pmod(F.hash("url"), F.lit(2)) == 0), max_labelled=150)
    held = df.where(F.pmod(F.hash("url"), F.lit(2)) == 1)
    right = held.where((urlfilter.margin(urlfilter.grams(F.col("host"), F.col("path")), model) > 0) == (F.col("label") == 1)).count()
    assert right / held.count() > 0.97


def cosine(x, q):
    return x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))


def test_nearest_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 6000)] + 0.7 * rng.normal(size=(6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    rows = ann.vectors(df, "vec_id", "embedding")
    index, books = ann.build(rows, 5, sample=2000)
    got = ann.search(index, books, rows.where("vec_id % 50 = 0"), 5).collect()
    hit = 0
    for q in range(0, 6000, 50):
        s = cosine(x.astype(float), x[q].astype(float))
        s[q] = -2
        best = set(np.lexsort((np.arange(6000), -s))[:5].tolist())
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in own)
        hit += len(best & {r.vec_id for r in own})
    assert hit / 600 >= 0.9


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (100, [0.0, 1.0]), *[(i, [1.0, 0.0]) for i in range(1, 40)], (41, None), (42, [0.0, 0.0]), (43, [1.0, None]), (44, [float("nan"), 1.0]), (45, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (150, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = ann.vectors(df, "vec_id", "embedding")
    index, books = ann.build(own, 5)
    got = [tuple(r) for r in ann.search(index, books, own.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got[:5]] == [(0, i + 1, i + 1) for i in range(5)]
    assert [g[:3] for g in got[5:7]] == [(50, 1, 100), (50, 2, 0)] and len(got) == 15
    assert ann.search(index, books, own.where("vec_id < 0"), 5).count() == 0
    none = ann.vectors(df.limit(0), "vec_id", "embedding")
    index, books = ann.build(none, 5)
    assert ann.search(index, books, none, 5).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8])
def test_nearest_of_few(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 6))
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, block string, query int")
    own = ann.vectors(df, "vec_id", "embedding")
    index, books = ann.build(own, 5)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(index, books, own, 5).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(n):
        s = cosine(x, x[q])
        want += [(q, r + 1, int(i)) for r, i in enumerate([i for i in np.lexsort((np.arange(n), -s)) if i != q][:5])]
    assert got == want


def test_nearest_of_large_and_small_components(spark):
    rows = [(0, [1e200, 2e200]), (1, [3e-200, 6.1e-200]), (2, [1e300, -1e300]), (3, [1.0, 0.5]), (3, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = ann.vectors(df, "vec_id", "embedding")
    index, books = ann.build(own, 5)
    got = [(r.query_id, r.vec_id, r.score) for r in ann.search(index, books, own.where("vec_id = 0"), 5).orderBy("rank").collect()]
    side = lambda a, b: (a[0] * b[0] + a[1] * b[1]) / math.hypot(*a) / math.hypot(*b)
    assert [g[1] for g in got] == [1, 3, 2]
    assert [g[2] for g in got] == pytest.approx([side((1, 2), (3, 6.1)), side((1, 2), (1, 0.5)), side((1, 2), (1, -1))])


def test_one_shortlist_over_all_blocks(spark, monkeypatch):
    """The exact share is the shortlist's, however many blocks there are, and chunks of queries change nothing."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    own = ann.vectors(df, "vec_id", "embedding")
    found = []
    for block, size in ((4096, 32 << 20), (100, 20_000)):
        monkeypatch.setattr(ann, "BLOCK", block)
        monkeypatch.setattr(ann, "CHUNK_BYTES", size)
        index, books = ann.build(own, 5, sample=1000)
        found.append(sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(index, books, own.where("vec_id % 50 = 0"), 5, shortlist=5).collect()))
    assert found[0] == found[1] and len(found[0]) == 300
    best = {(q, int(i)) for q in range(0, 3000, 50) for i in np.argsort(-np.where(np.arange(3000) == q, -2, cosine(x, x[q])))[:5]}
    assert len(best & {(q, i) for q, _, i in found[0]}) < 300  # a shortlist of five is not all


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(4)
    x = ann.unit(rng.normal(size=(800, 16)))
    books = ann.fit(x, m=4, words=32)
    error = lambda beam: float(((x - ann.decode(books, ann.encode(books, x, beam))) ** 2).sum())
    assert error(8) <= error(1)
