"""Splitting texts into pre-tokens with array operations.

The two public split patterns (``public_tokenizers.PATTERN`` and the one of
``word_bpe_49k.json``) cut a text where the class of the code points changes
(letter, number, white space, other), apart from contractions and the space
before a word.  So the cuts are found for many texts at once from an array of
classes; the tests hold them against the regular expressions.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from .common import worker_cache

SPACE, LETTER, NUMBER, OTHER, BORDER = range(5)
# fixed values: Unicode White_Space
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table() -> np.ndarray:
    """Class of every code point, built once in each Python worker."""
    cache = worker_cache()
    if "class_table" not in cache:
        import regex
        table = np.full(0x110000, OTHER, np.uint8)
        points = np.r_[0:0xD800, 0xE000:0x110000]
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start():m.end()]] = kind
        table[WHITE_SPACE] = SPACE
        cache["class_table"] = table
    return cache["class_table"]


class Joined:
    """Texts joined into one string, with code points, classes and class runs."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts) + "\n"
        self.points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        self.classes = class_table()[self.points]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.borders = np.cumsum(lengths + 1) - 1
        self.classes[self.borders] = BORDER
        cuts = np.flatnonzero(self.classes[1:] != self.classes[:-1]) + 1
        self.run = np.r_[0, cuts]
        self.run_end = np.r_[cuts, len(self.classes)]
        self.kind = self.classes[self.run]
        self.next_kind = np.r_[self.kind[1:], BORDER]
        self.start = np.zeros(len(self.classes), bool)
        self.start[self.run] = True

    def contractions(self) -> None:
        """Move the cut after 's 't 'm 'd 're 've 'll at an apostrophe that starts a piece."""
        at = np.flatnonzero((self.kind == OTHER) & (self.run_end - self.run == 1) & (self.next_kind == LETTER)
                            & (self.points[self.run] == ord("'")) & self.start[self.run])
        if not len(at):
            return
        begin, end = self.run_end[at], self.run_end[at + 1]
        one = self.points[begin]
        two = self.points[begin + 1]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        hit = size > 0
        self.start[begin[hit]] = False
        after = begin[hit] + size[hit]
        self.start[after[after < end[hit]]] = True

    def pieces(self, dropped: list[int]) -> tuple[list[str], np.ndarray]:
        """The pieces and how many of them each text has."""
        begin = np.flatnonzero(self.start)
        end = np.r_[begin[1:], len(self.classes)]
        keep = ~np.isin(self.classes[begin], dropped)
        begin, end = begin[keep], end[keep]
        upto = np.searchsorted(begin, self.borders)
        text = self.text
        return [text[a:b] for a, b in zip(begin.tolist(), end.tolist())], np.diff(np.r_[0, upto])


def split_spaced(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Pieces of ``public_tokenizers.PATTERN`` in every text, and their number
    per text.  A single space belongs to the word after it; of a longer white
    space before a word, the last code point is a piece of its own unless it is
    such a space."""
    if not texts:
        return [], np.zeros(0, np.int64)
    j = Joined(texts)
    before = (j.kind == SPACE) & (j.next_kind != BORDER)
    last = j.run_end[before] - 1
    j.start[last] = True
    j.start[last[j.points[last] == 32] + 1] = False
    j.contractions()
    return j.pieces([BORDER])


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Pieces of the pattern of ``word_bpe_49k.json``: contractions, letters,
    single numbers, others; white space is dropped."""
    if not texts:
        return [], np.zeros(0, np.int64)
    j = Joined(texts)
    j.start[j.classes == NUMBER] = True
    j.contractions()
    return j.pieces([BORDER, SPACE])
