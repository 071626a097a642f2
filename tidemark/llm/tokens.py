"""Whole texts to token ids with the ``tokenizers`` library, word by word through a bounded cache.

Both vocabularies split a text before merging, and no piece of that split reaches over a space that stands between
two solid characters.  So a text is cut at such spaces, each cut is encoded by the library's own normaliser, splitter
and model once, and its ids are kept as little-endian 32-bit words.  Texts with other spacing go to the library
whole.  A full cache takes no more words: its bound costs time, never results.

All this holds for two splits of texts, which are told by the vocabulary file's own description.  With any other one
every text goes to the library whole.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys

from tidemark.llm import workers

#: Cuts that a process remembers, about 130 bytes each.
CACHE_WORDS = 400_000
#: How the two known kinds of files describe their normaliser and split (fixed values): the byte-level split with a
#: space before its word, and lower-cased letters, single digits and runs of marks.
SPACED = [None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}]
LOWERED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
]
#: Letters, then ASCII marks but for the apostrophe, which may begin a piece of its own: both vocabularies split these
#: into the letters and the run of marks.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Byte-level vocabularies write a byte that prints as itself, and the n-th of the others as chr(256 + n).
PRINTING = {*range(33, 127), *range(161, 173), *range(174, 256)}
SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in PRINTING)}

_encoders: dict[tuple[str, int], Encoder] = {}


class Odd(Exception):
    """A cut that may not be encoded by itself."""


class Marks(dict):
    """The ids of a run of closing marks."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, run: str) -> bytes:
        ids = self.encode(run)
        if len(self) < 10_000:
            self[run] = ids
        return ids


class Cuts(dict):
    """The ids of cuts that stand behind ``lead``."""

    def __init__(self, tool: Encoder, lead: str, heads: Cuts | None = None):
        self.most, self.tool, self.encode, self.lead, self.strict = tool.most, tool, tool.one, lead, tool.spaced
        self.shown = chr(SHOWN[32]) if lead else ""
        self.heads = self if heads is None else heads
        self.marks = Marks(tool.one)
        self.line_end = tool.one("\n") if self.strict else b""

    def __missing__(self, cut: str) -> bytes:
        if cut.isascii() and cut.isalpha():
            ids = self.letters(cut)
        elif not cut or self.strict and (cut[0].isspace() or cut[-1].isspace()):
            if self.strict:
                raise Odd
            ids = b""
        elif self.strict and "\n" in cut:  # a lone line end between solid characters stands by itself
            head, *rest = cut.split("\n")
            return self[head] + b"".join(self.line_end + self.heads[x] for x in rest)
        elif (plain := PLAIN.fullmatch(cut)) and plain[2]:
            ids = self[plain[1]] + self.marks[plain[2]]
        else:
            ids = self.encode(self.lead + cut)
        if len(self) < self.most:
            self[cut] = ids
        return ids

    def letters(self, word: str) -> bytes:
        """A word of ASCII letters is one piece of either vocabulary's split."""
        tool = self.tool
        return little([t.id for t in tool.merge(self.shown + word if tool.spaced else word.lower())])


def little(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit words."""
    out = array.array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """``spaced``: a space belongs to the word behind it; otherwise white space only separates words.  ``known``: the
    file is of one of the two kinds whose texts may be cut."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = True  # their strings in a text are ordinary text
        self.normalise = self.tool.normalizer.normalize_str if self.tool.normalizer else str
        self.split, self.merge = self.tool.pre_tokenizer.pre_tokenize_str, self.tool.model.tokenize
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        kind, model = [told.get("normalizer"), told.get("pre_tokenizer")], told.get("model", {})
        self.known = kind in (SPACED, LOWERED) and model.get("type") == "BPE" and not model.get("dropout") and not model.get("unk_token")
        self.spaced, self.most = kind == SPACED, most
        if not self.known:
            return
        self.first = Cuts(self, "")
        self.later = Cuts(self, " " if self.spaced else "", self.first)

    def one(self, cut: str) -> bytes:
        if LETTERS.fullmatch(cut):
            pieces = [(cut if self.spaced else cut.lower()).encode().decode("latin-1").translate(SHOWN)]
        else:
            pieces = [piece for piece, _ in self.split(self.normalise(cut))]
        return little([t.id for piece in pieces for t in self.merge(piece)])

    def whole(self, text: str) -> bytes:
        return little(self.tool.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian 32-bit words; a null text is empty."""
        if not text:
            return b""
        if not self.known:
            return self.whole(text)
        if not self.spaced:
            return b"".join(map(self.later.__getitem__, text.replace("\n", " ").split(" ")))
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.later.__getitem__, rest))
        except Odd:
            return self.whole(text)


def encoder(path: str, most: int = CACHE_WORDS) -> Encoder:
    """This process's encoder for a vocabulary file; it remembers ``most`` cuts."""
    workers.cache("tokens", _encoders.clear)
    if (path, most) not in _encoders:
        _encoders.clear()
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]
