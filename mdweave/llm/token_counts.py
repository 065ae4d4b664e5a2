"""Token counts without identifiers, by heap-and-linked-list pair merging.

For each distinct word, its symbols form a linked list and its adjacent pairs a
heap by merge rank; the lowest pair is popped and merged until none is left.
The count is the number of symbols at first minus the merges.  Texts are split
with array operations and a text's count is the sum over its words; each Python
worker keeps the counts of the words it has met.

Defined results: null text counts as empty (0 bytes, 0 tokens); null ids, repeated
rows and other columns are passed over or kept as they come; an empty table gives
no row.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, slices, texts_of, worker_cache
from .pretokens import split_words
from .wordtokens import byte_spelling


def merged_count(symbols: list[str], ranks: dict) -> int:
    """Number of symbols that are left when all merges have been done."""
    n = len(symbols)
    if n < 2:
        return n
    after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j < 0 or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, None
        left -= 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return left


class WordCounts(dict):
    """Tokens of each word; a word is counted when it is first asked for."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = model["model"]["merges"]
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in merges)
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.end, self.spelling, self.most = model["model"]["end_of_word_suffix"] or "", byte_spelling(), most
        self.special = re.compile("|".join(re.escape(t["content"]) for t in model["added_tokens"]) or r"(?!)")

    def __missing__(self, word: str) -> int:
        symbols = list(word.encode().decode("latin-1").translate(self.spelling))
        symbols[-1] += self.end
        n = self[word] = merged_count(symbols, self.ranks)
        return n

    def segments(self, text: str) -> list[str]:
        """The normalised parts of a text between special strings."""
        parts = self.special.split(text)
        return [unicodedata.normalize("NFC", p).replace("Σ", "σ").lower() for p in parts]

    def of(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text; a special string in a text is one token."""
        out = np.zeros(len(texts), np.int64)
        for a, b in slices(texts, 1_000_000):
            if len(self) > self.most:
                self.clear()
            parts = [self.segments(t) for t in texts[a:b]]
            words, counts = split_words([s for p in parts for s in p])
            sums = np.r_[0, np.cumsum(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))]
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = sums[np.r_[0, np.cumsum(counts)][np.cumsum(sizes)]]
            out[a:b] = np.diff(np.r_[0, ends]) + sizes - 1
        return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text."""

    def run(batches):
        cache = worker_cache()
        if ("word_counts", vocabulary) not in cache:
            cache["word_counts", vocabulary] = WordCounts(vocabulary)
        counts = cache["word_counts", vocabulary]
        for batch in parts_of(batches):
            n = counts.of(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n),
                                              pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
