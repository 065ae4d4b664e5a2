"""Whole texts to ids with the tokenizers library, each distinct pre-token once.

The library takes most of its time on words that it has seen before in other
texts.  A byte-level vocabulary maps every pre-token separately, so each Python
worker keeps the ids of the pre-tokens it has met (up to ``most`` of them, then
it starts anew) and asks the library for new ones in batches.
"""

from __future__ import annotations

import os

import numpy as np

from .common import slices, worker_cache
from .pretokens import split_spaced


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for, and
    lists those that are new."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[first[i]:first[i] + sizes[i]]``."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]


def byte_spelling() -> dict[int, int]:
    """Code point under which a byte-level vocabulary spells each byte: its own
    where that is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


class WordTokens:
    """Encoder of one worker for a byte-level tokenizers file."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.spelling = byte_spelling()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.words, self.size = Numbered(), 0
        self.flat, self.first, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self) -> None:
        """Ids of the words that were numbered since the last call."""
        new, self.words.new = self.words.new, []
        spell, tokenize = self.spelling, self.tokenizer.model.tokenize
        encoded = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(spell))] for w in new]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(sizes.sum()))
        self.first = np.r_[self.first, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, flat]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as ``encode(text, add_special_tokens=False)`` gives them."""
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
        chosen = [texts[i] for i in plain]
        for a, b in slices(chosen, 1_000_000):
            if len(self.words) > self.most:
                self.clear()
            words, counts = split_spaced(chosen[a:b])
            numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            if self.words.new:
                self.learn()
            sizes = self.sizes[numbers]
            ids = gather(self.flat, self.first[numbers], sizes)
            ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
            for i, first, end in zip(plain[a:b], np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                out[i] = ids[first:end]
        return out


def word_tokens(path: str) -> WordTokens:
    """The encoder of this Python worker for ``path``."""
    cache = worker_cache()
    if ("word_tokens", path) not in cache:
        cache["word_tokens", path] = WordTokens(path)
    return cache["word_tokens", path]
