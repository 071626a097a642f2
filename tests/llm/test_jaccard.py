import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.common import LOWER, WORD, docs
from tidemark.llm import components, jaccard, sigtree


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k, percent):
    """doc_id -> (set size, smallest reachable id), by all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    least = defaultdict(lambda: float("inf"))
    for i in ids:
        least[find(i)] = min(least[find(i)], i)
    return {i: (len(sets[i]), least[find(i)]) for i in ids}


def near_copies(rng, n, words, edits):
    base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 70)])
def test_against_all_pairs(spark, k, percent):
    rng = random.Random(k)
    line = " ".join(f"common{i}" for i in range(25))
    texts = near_copies(rng, 60, 80, 7) + near_copies(rng, 40, 300, 30) + near_copies(rng, 40, 12, 2)
    texts += [line + " " + " ".join(f"own{i}x{j}" for j in range(rng.randrange(5, 90))) for i in range(80)]
    texts += ["a", "A", "a b", "", None, "a\x0bb", "é É", "é\u00a0É"]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs(spark, rows), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(jaccard, "HELD_ROWS", 5)
    monkeypatch.setattr(jaccard, "HOT_CLASSES", 10)
    monkeypatch.setattr(jaccard, "FREQUENT", 10)
    rng = random.Random(9)
    rows = list(enumerate(near_copies(rng, 60, 60, 6)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs(spark, rows), 3, 90).collect()}
    assert got == brute(rows, 3, 90)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = docs(spark, [(5, text), (3, text), (3, text), (None, text), (9, "other words entirely here now"), (10, None), (11, " ".join(f"v{i}" for i in range(200_000)))]).withColumnRenamed("lang", "node").withColumnRenamed("source", "component")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()), key=str)
    assert got == sorted([(5, 36, 3), (3, 36, 3), (3, 36, 3), (None, 36, None), (9, 1, 9), (10, 0, 10), (11, 199_996, 11)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [3, 9, 10, 11]
    assert jaccard.classes(df.limit(0)).count() == 0 and jaccard.keep_one(df.limit(0)).count() == 0


def test_one_row_of_a_class_stays(spark):
    """Ids that repeat with other texts, copies under one id and copies without an id are told apart by row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = docs(spark, [(1, a), (2, a), (2, b), (7, c), (7, c), (None, c), (None, "only here stands this text"), (None, None)])
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (7, c), (None, "only here stands this text"), (None, None)], key=str)


@pytest.mark.parametrize("percent", [20, 35])
def test_low_thresholds_compare_far_size_classes(spark, percent):
    words = [f"w{i}" for i in range(64)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate([10, 45, 3, 20, 64, 9])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs(spark, rows), 1, percent).collect()}
    assert got == brute(rows, 1, percent)
    with pytest.raises(ValueError):
        jaccard.classes(docs(spark, rows), 1, 0)


def test_candidates_at_any_threshold():
    tokens = np.random.default_rng(6).integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.sort(tokens[:n]) for n in (10, 45, 100, 399, 2)]
    sizes, maps = np.array([len(s) for s in sets]), [sigtree.bitmap(s, sigtree.size_class(len(s))) for s in sets]
    for percent in (1, 5, 20, 24, 49, 50, 90):
        want = {(i, j) for i in range(5) for j in range(5) if i < j and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])}
        for sides in (None, np.array([0, 1, 0, 1, 1])):
            found = {(min(a, b), max(a, b)) for x, y in sigtree.candidates(np.arange(5), sizes, maps, sides, percent) for a, b in zip(x.tolist(), y.tolist())}
            assert {p for p in want if sides is None or sides[p[0]] != sides[p[1]]} <= found


@pytest.mark.parametrize("block, few, words", [(4096, 8, 1 << 22), (7, 1, 1 << 22), (4096, 8, 0)])
def test_every_link_is_counted(spark, monkeypatch, block, few, words):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "TASK_WORDS", words)
    rng = random.Random(4)
    texts = near_copies(rng, 70, 60, 6) + near_copies(rng, 30, 200, 25) + ["a b c"] * 4 + ["", None]
    rows = list(enumerate(texts)) + [(None, "a b c"), (2, texts[3])]
    sets = [shingles(t, 3) for _, t in rows]
    want = sorted(((i, None if i is None else sum(j is not None and bool(x) and 100 * len(x & y) >= 90 * len(x | y) for (j, _), y in zip(rows, sets)) - bool(x)) for (i, _), x in zip(rows, sets)), key=str)
    got = jaccard.classes(docs(spark, rows), 3, 90, links=True).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == want
    unique = {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 2)}
    # the other row of id 2 names the class of 3
    assert unique == {i: 2 if c == 3 else c for i, (_, c) in brute(list(enumerate(texts)), 3, 90).items() if i != 2}
    assert sum(n or 0 for _, n in want) > 2 * len(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + (i * 7919) % 700, 1000 + ((i + 1) * 7919) % 700) for i in range(650)] + [(100, i) for i in range(101, 180)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    odd = spark.createDataFrame([(1, 1), (2, None), (None, None)], "a long, b long")
    assert components.components(odd, "a", "b").count() == 0


def test_trees_prune_nothing_that_fits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets = []
    for _ in range(150):
        keep = rng.random(400) < rng.choice([0.3, 0.6, 0.95, 1.0])
        sets.append(np.unique(np.concatenate((base[keep], rng.integers(0, 2**63, rng.integers(1, 30), dtype=np.uint64)))))
    sizes = np.array([len(s) for s in sets])
    maps = [sigtree.bitmap(s, sigtree.size_class(len(s))) for s in sets]
    real = {(i, j) for i in range(150) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    found = {(max(a, b), min(a, b)) for x, y in sigtree.candidates(np.arange(150), sizes, maps, None, 80) for a, b in zip(x.tolist(), y.tolist())}
    assert real and real <= found and len(found) < 150 * 149 / 4
    sides = np.arange(150) % 2
    found = {(max(a, b), min(a, b)) for x, y in sigtree.candidates(np.arange(150), sizes, maps, sides, 80) for a, b in zip(x.tolist(), y.tolist())}
    assert {p for p in real if p[0] % 2 != p[1] % 2} <= found
    i, j = sigtree.small_pairs(np.arange(150) // 15, sizes, maps, 80)
    assert {p for p in real if p[0] // 15 == p[1] // 15} <= {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist())}
