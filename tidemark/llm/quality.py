"""Quality rules, line first: each line is judged by itself, failing lines go, and a document that loses too much
text goes with them.

Rules for a line that has a word:

* punctuation - it must end with closing punctuation (quotes and brackets may follow) or be prose that is cut short
  (a sentence ends within), and no more than a tenth of its words may carry a run of two or more marks such as ``!!`` or ``***``;
* navigation - separators between its words (``|``, bullets, arrows), or a short line that holds a menu phrase;
* boilerplate - phrases of notices, scripts and banners, a line in capitals, or a line seen before in the document.

Phrases are English, German, French and Spanish; the other rules know no language.

Defined results: a null text has no words and fails; an empty table gives an empty table; every row is judged on
its own, so repeated ids and rows are judged again; texts are read whole, whatever their length; a column of the
input whose name a figure has keeps its name and values, and the figure gets an underscore behind its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import fresh, quoted
from tidemark.llm.words import ngram_hashes, scramble, slices, word_hashes
from tidemark.llm.workers import sliced, tidy

#: A document goes when its kept lines hold less than this share of its words.
LEAST_KEPT = 0.5
SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Prose that is cut short: so many words, and a sentence that ends within.
CUT_WORDS = 15
SENTENCE = re.compile(r"""[^\W_][.!?。！？]["'”’»)]?[ \t]""")
CLOSED = re.compile(r"""[.!?:;…。！？؟।।፧‽][\s"'”’»›)\]}」』】]*\Z""")
MARKS = re.compile(r"[!?*#$%&|<>=~^_+@\\/]{2,}")
SEPARATOR = re.compile(r"(?:^|\s)[|»›•·→>◦▪](?:\s|$)|\s[|»›•·→>◦▪]\s")
#: Phrases begin and end with ASCII letters: word boundaries there mean the same to every engine.
MENU_PHRASES = """
home, login, log in, sign in, sign up, register, menu, sitemap, site map, next page, previous page, read more, click here, back to top, skip to content,
contact us, about us, subscribe, share this, follow us,
startseite, anmelden, registrieren, weiterlesen, mehr erfahren, hier klicken, nach oben, zum inhalt springen, folgen sie uns,
accueil, se connecter, plan du site, lire la suite, cliquez ici, haut de page, contactez.nous, suivez.nous, aller au contenu,
inicio, iniciar sesi[oó]n, reg[ií]strate, men[uú] principal, mapa del sitio, leer m[aá]s, volver arriba, suscr[ií]bete, s[ií]guenos
"""
NOTICE_PHRASES = """
all rights reserved, terms of (?:use|service), privacy policy, cookie policy, uses cookies, accept cookies, javascript, enable scripts, lorem ipsum,
copyright, licen[cs]ed under, is licen[cs]ed, released under the,
alle rechte vorbehalten, nutzungsbedingungen, datenschutzerkl[aä]rung, verwendet cookies, cookies akzeptieren,
tous droits r[eé]serv[eé]s, conditions d.utilisation, politique de cookies, utilise des cookies, accepter les cookies, mentions l[eé]gales,
todos los derechos reservados, pol[ií]tica de privacidad, t[eé]rminos (?:de uso|del servicio), utiliza cookies, aceptar cookies, aviso legal
"""


def phrases(text: str) -> list[str]:
    return re.split(r",\s+", text.strip())


def fragments(text: str) -> list[str]:
    """The longest plain run of each phrase: a text without any of them holds no phrase."""
    return [max(re.split(r"\(\?:.*?\)|\[.*?\]|\.", p), key=len) for p in phrases(text)]


MENU = re.compile(rf"\b(?:{'|'.join(phrases(MENU_PHRASES))})\b", re.I)
NOTICE = re.compile(rf"\b(?:{'|'.join(phrases(NOTICE_PHRASES))})\b|©|\{{[^}}]*;[^}}]*\}}", re.I)
MENU_PARTS, NOTICE_PARTS = fragments(MENU_PHRASES), [*fragments(NOTICE_PHRASES), "©", "{"]
MENU_WORDS, NOTICE_WORDS = 12, 40
RULES = ("punctuation", "navigation", "boilerplate")


def judge_line(line: str, n_words: int, seen: bool, menus: bool = True, notices: bool = True) -> str | None:
    """The rule that the line breaks, or None; ``menus`` and ``notices`` are false where its text is known to hold no
    such phrase."""
    if seen:
        return "boilerplate"
    if len(SEPARATOR.findall(line)) >= 2 or menus and n_words <= MENU_WORDS and MENU.search(line) and not CLOSED.search(line):
        return "navigation"
    if notices and n_words <= NOTICE_WORDS and NOTICE.search(line):
        return "boilerplate"
    if 10 * len(MARKS.findall(line)) > n_words or not CLOSED.search(line) and not (n_words >= CUT_WORDS and SENTENCE.search(line)):
        return "punctuation"
    if n_words >= 3 and line.isupper():
        return "boilerplate"
    return None


def clean(text: str) -> tuple[str, int, int, dict[str, int], int]:
    """(kept text, words kept, duplicate lines, lines broken by rule, words in all lines)."""
    seen: set[str] = set()
    out, kept, total, repeats, broken = [], 0, 0, 0, dict.fromkeys(RULES, 0)
    low = text.lower().replace("i\u0307", "i").replace("\u017f", "s")  # as patterns that ignore case see it
    menus, notices = any(x in low for x in MENU_PARTS), any(x in low for x in NOTICE_PARTS)
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            out.append(line)
            continue
        total += n
        again = line in seen
        repeats += again
        seen.add(line)
        rule = judge_line(line, n, again, menus, notices)
        if rule:
            broken[rule] += 1
        else:
            out.append(line)
            kept += n
    return "\n".join(out), kept, repeats, broken, total


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in 3-word windows that occur twice or more in their text) of each text."""
    counts, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for first, end, data, offsets in slices(texts):
        words, at = word_hashes(data, offsets, lower=False)
        counts[first:end] = np.diff(at)
        if len(words) < 3:
            continue
        text_of = np.repeat(np.arange(end - first, dtype=np.uint64), np.diff(at))
        same = text_of[2:] == text_of[:-2]
        keys = scramble(ngram_hashes(words, 3) + text_of[:-2] * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(keys[same])
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        covered = np.zeros(len(words), dtype=np.int64)
        if len(twice):
            place = np.searchsorted(twice, keys)
            hit = np.flatnonzero((twice[np.minimum(place, len(twice) - 1)] == keys) & same)
            for j in range(3):
                covered[hit + j] = 1
        total = np.concatenate(([0], np.cumsum(covered)))
        repeats[first:end] = total[at[1:]] - total[at[:-1]]
    return counts, repeats


def figures(texts: list[str], least_kept: float) -> list[tuple]:
    """The fields of each text, in the order of ``FIELDS``, then the cleaned text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words, repeats = repeated_words(raw)
    rows = []
    for t, b, n, r in zip(texts, raw, words.tolist(), repeats.tolist(), strict=True):
        chars = len(t) - sum(t.count(c) for c in SPACE)
        symbols = len(b) - len(b.translate(None, SYMBOLS))
        cleaned, kept, dup, broken, _ = clean(t)
        failed = n < 50 or 100 * r > 50 * n
        rows.append((n, chars, symbols, dup, r, kept, *(broken[x] for x in RULES), failed, not failed and kept >= least_kept * n, cleaned))
    return rows


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_kept_words long, n_punctuation long, n_navigation long, n_boilerplate long, base_failed boolean, kept boolean"


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, with_text: bool = False, least_kept: float = LEAST_KEPT) -> DataFrame:
    """Columns ``keep`` of ``df`` with the figures of each text, the verdict ``kept`` and, if asked, ``clean_text``."""
    keep = keep or []
    source = df.select(*[F.col(quoted(c)) for c in keep], F.coalesce(F.col(quoted(text)), F.lit("")))
    told = [x.split() for x in FIELDS.split(", ")] + [["clean_text", "string"]] * with_text
    names = fresh(keep, *[n for n, _ in told])
    schema = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + [f"{n} {kind}" for n, (_, kind) in zip(names, told, strict=True)])
    kinds = [pa.int64()] * 9 + [pa.bool_()] * 2 + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keep)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            columns = [list(c) for c in zip(*figures(texts, least_kept), strict=True)] or [[] for _ in kinds]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(told)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + arrays, names=[*keep, *names])

    return source.mapInArrow(tidy(run), schema)


def keep_good(df: DataFrame, text: str = "text", least_kept: float = LEAST_KEPT, cleaned: bool = False, length: str | None = None) -> DataFrame:
    """The rows of ``df`` whose text is kept: one pass, whatever the columns are named.  With ``cleaned`` the lines
    that failed leave the text, and the column ``length``, if named, gets the number of its characters."""
    place, size = df.columns.index(text), df.columns.index(length) if length else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, place):
            rows = figures([t or "" for t in batch.column(place).cast(pa.string()).to_pylist()], least_kept)
            if cleaned:
                columns = batch.columns
                columns[place] = pa.array([r[11] for r in rows], pa.string()).cast(columns[place].type)
                if size is not None:
                    columns[size] = pa.array([len(r[11]) for r in rows], pa.int64()).cast(columns[size].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch.filter(pa.array([r[10] for r in rows], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
