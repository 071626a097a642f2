from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.common import WORD, docs
from tidemark.llm import quality

PROSE = "The river ran along the old wall until it met the mill. " * 2 + "Nobody had used the mill for years, yet its wheel turned whenever rain came down from the hills above the town. " + "Children said that someone lived there. Their parents laughed at that, and looked away, because they had seen the light too on winter evenings."


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(rows, keep=["doc_id"]).collect()}
    for r in rows.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute(r.text)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)


@settings(max_examples=60)
@given(st.lists(st.text(alphabet="ab \n\t\u00a0é\x1c", max_size=30), max_size=6))
def test_figures_of_any_texts(texts):
    assert [f[:5] for f in quality.figures(texts, 0.5)] == [brute(t) for t in texts]


@pytest.mark.parametrize(
    "line, rule",
    [
        ("It was late, and nobody came.", None),
        ("“It was late,” she said (twice).", None),
        ("Home | About | Contact | Login", "navigation"),
        ("Read more", "navigation"),
        ("Copyright 2020 Someone.", "boilerplate"),
        ("This site uses cookies.", "boilerplate"),
        ("BUY NOW AND SAVE.", "boilerplate"),
        ("a list without an end", "punctuation"),
        ("what!! a!! day!! it!! was.", "punctuation"),
        ("One two three four five six. Seven eight nine ten eleven twelve thirteen fourteen fifteen and", None),
    ],
)
def test_lines(line, rule):
    assert quality.judge_line(line, len(line.split()), False) == rule


@pytest.mark.parametrize("line, rule", [("Lire la suite", "navigation"), ("Mapa del sitio", "navigation"), ("Alle Rechte vorbehalten.", "boilerplate"), ("Términos del servicio.", "boilerplate"), ("Se rminos y vuelve.", None)])
def test_lines_of_other_languages(line, rule):
    assert quality.judge_line(line, len(line.split()), False) == rule
    assert (quality.clean(line)[1] == 0) == (rule is not None)  # the look at the whole text hides no phrase


@settings(max_examples=200)
@given(st.sampled_from([*quality.phrases(quality.MENU_PHRASES), *quality.phrases(quality.NOTICE_PHRASES)]), st.sampled_from([str, str.upper, str.title, lambda x: x.replace("i", "\u0130").replace("s", "\u017f")]))
def test_fragments_hide_no_phrase(phrase, case):
    import re

    plain = re.sub(r"\(\?:(.*?)\|.*?\)", r"\1", re.sub(r"\[(.).*?\]", r"\1", phrase)).replace(".", "-")
    line = case(plain)
    assert quality.clean(line)[3] == {r: int(r == quality.judge_line(line, len(line.split()), False)) for r in quality.RULES}


def test_cleaned_texts_and_clashing_names(spark):
    df = docs(spark, [(1, PROSE + "\nRead more"), (2, "short."), (None, PROSE)]).withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    good = quality.keep_good(df, cleaned=True, length="n_chars")
    assert good.columns == df.columns and sorted((r.doc_id or 0, r.text, r.n_chars, r.n_words) for r in good.collect()) == [(0, PROSE, len(PROSE), "s"), (1, PROSE, len(PROSE), "s")]
    told = quality.judge(df, keep=["doc_id", "kept", "n_words", "n_chars"])
    assert told.columns[:5] == ["doc_id", "kept", "n_words", "n_chars", "n_words_"] and told.columns[-1] == "kept_"
    assert {(r.doc_id, r.n_words, r.kept_) for r in told.collect()} == {(1, "s", True), (2, "s", False), (None, "s", True)}


def test_edges(spark):
    menu = "\n".join(["Home | News | Sport | Login"] * 30)
    df = docs(spark, [(1, None), (2, ""), (3, PROSE), (3, PROSE), (4, PROSE + "\n" + menu), (5, PROSE + "\nAll rights reserved."), (None, PROSE), (6, (PROSE + "\n") * 400), (7, " ".join(f"w{i}" for i in range(300_000)) + ".")])
    df = df.withColumnRenamed("lang", "kept")
    rows = quality.judge(df, keep=["doc_id"], with_text=True).collect()
    kept = Counter((r.doc_id, r.kept) for r in rows)
    assert kept == Counter({(1, False): 1, (2, False): 1, (3, True): 2, (4, False): 1, (5, True): 1, (None, True): 1, (6, False): 1, (7, True): 1})
    assert next(r for r in rows if r.doc_id == 5).clean_text == PROSE
    good = quality.keep_good(df)
    assert good.columns == df.columns and good.count() == 5
    assert quality.judge(df.limit(0), keep=["doc_id"]).count() == 0 and quality.keep_good(df.limit(0)).count() == 0
