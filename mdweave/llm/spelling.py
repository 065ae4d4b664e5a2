"""Spelling variants: words that differ by one letter, grouped under the frequent ones.

Words are counted exactly.  A word's neighbours are found by generating its edits: each deletion, and each
replacement by a letter that comes later in the alphabet (so that every pair comes up once).  An edit is a 64-bit
polynomial hash, which follows from the word's in a few array operations, and is looked up in blocked Bloom filters of the vocabulary,
one for each length (of a large length several, by hash), which are broadcast: at most ``most_bytes`` at a time, more take more rounds.
Only the edits that a filter holds are shuffled, as pairs of hashes; the join with the vocabulary drops the filters'
false ones, and the two words' edit distance, taken natively, those of equal hashes.

Defined results: null text has no words, a null id counts as an empty string in the checksum, repeated rows
count as often as they come; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, parts_of, rounds_of, stage, worker_cache

#: In Latin-1: letters stay, A-Z becomes a-z, everything else is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
LETTERS = np.array([c for c in range(256) if FOLD[c] == c != 32], np.uint8)
BASE = 0x9E3779B97F4A7C15
BITS_PER_WORD, BITS_SET = 32, 6
MOST_WORDS = 400_000  # distinct words that a task keeps at once
MOST_EDITS = 1 << 20  # edits in one array


def runs_of(text: str, size: int = 1 << 20):
    """Lists of the runs of letters of a text, in Latin-1 with A-Z folded, about ``size`` code points at a time."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and ("A" <= text[end] <= "Z" or "a" <= text[end] <= "z" or "\xc0" <= text[end] <= "\xff"):
            end += 1
        yield text[at:end].encode("latin-1", "replace").translate(FOLD).split()
        at = end


def spelled(doc_id: bytes, run: bytes, one_in: int) -> bytes:
    """The run, without one of its letters where the checksum of the id and the run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc_id + b":"))
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int, one_in: int) -> DataFrame:
    """``word, n`` of all words."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            words, n = [w.decode("latin-1") for w in counts], list(counts.values())
            counts.clear()
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k:k + 20_000], pa.string()), pa.array(n[k:k + 20_000], pa.int64())],
                                                 ["word", "n"])

        for batch in parts_of(batches, 256):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own, doc_id = Counter(), doc_id.encode()
                for runs in runs_of(text):
                    own.update(r for r in runs if len(r) >= least_length)
                for r, n in own.items():
                    word = spelled(doc_id, r, one_in)
                    if len(word) >= least_length:
                        counts[word] += n
            if len(counts) > MOST_WORDS:
                yield from flush()
        yield from flush()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, BASE, np.uint64)])


def finished(sums: np.ndarray, length: int) -> np.ndarray:
    """Keys from the sums of the letters by their powers."""
    x = sums + np.uint64(length * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def keys_of(words: list[bytes]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for length, at in by_length(words).items():
        table, p = table_of([words[k] for k in at], length), powers(length)
        sums = np.zeros(len(at), np.uint64)
        for k in range(0, length, 4096):
            sums += (table[:, k:k + 4096] * p[None, k:k + 4096][:, :table[:, k:k + 4096].shape[1]]).sum(axis=1, dtype=np.uint64)
        out[at] = finished(sums, length)
    return out


def by_length(words: list[bytes]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for k, w in enumerate(words):
        out[len(w)].append(k)
    return out


def table_of(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(parts)


def first_bit(keys: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (keys & np.uint64(63))


def mask_of(keys: np.ndarray) -> np.ndarray:
    """The bits of a key in its block of 64."""
    out, x = first_bit(keys), keys * np.uint64(0xC4CEB9FE1A85EC53)
    for k in range(1, BITS_SET):
        out |= np.uint64(1) << ((x >> np.uint64(64 - 6 * k)) & np.uint64(63))
    return out


def vocabulary(words: DataFrame) -> DataFrame:
    """``words`` with ``length`` and ``key`` (the hash of the word)."""

    def run(batches):
        for batch in parts_of(batches, 20_000):
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(map(len, words), pa.int32()),
                                              pa.array(keys_of(words).view(np.int64))], ["word", "n", "length", "key"])

    return words.mapInArrow(run, "word string, n long, length int, key long")


def filters(vocabulary: DataFrame, shard_words: int) -> DataFrame:
    """``length, part, parts, blocks, image``: the blocked Bloom filters; a task holds one at a time."""
    sizes = stage(vocabulary.groupBy("length").agg(F.count("*").alias("size"))
                  .withColumn("parts", F.ceil(F.col("size") / shard_words).cast("int"))
                  .withColumn("blocks", (F.ceil(F.col("size") / F.col("parts")) * BITS_PER_WORD / 64 + 1).cast("int")))
    rows = join_groups(vocabulary.select("length", "key"), sizes, "length", "size").select(
        "length", F.expr("int(pmod(shiftrightunsigned(key, 8) & 16777215, parts))").alias("part"), "parts", "blocks", "key")

    def run(batches):
        own, bits = None, None

        def done():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in own), pa.array([bits.tobytes()], pa.binary())],
                                              ["length", "part", "parts", "blocks", "image"])

        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            heads = np.stack([batch.column(c).to_numpy() for c in ("length", "part", "parts", "blocks")], axis=1)
            cuts = np.r_[0, np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                head = heads[a].tolist()
                if head != own:
                    if own:
                        yield done()
                    own, bits = head, np.zeros(head[3], np.uint64)
                np.bitwise_or.at(bits, block_of(keys[a:b], head[3]).astype(np.int64), mask_of(keys[a:b]))
        if own:
            yield done()

    dealt = rows.repartition("length", "part").sortWithinPartitions("length", "part")
    return stage(dealt.mapInArrow(run, "length int, part int, parts int, blocks int, image binary"))


class Filters:
    """The filters of a round, by length."""

    def __init__(self, rows):
        self.of = {}
        for length in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == length]
            parts, blocks = own[0][2], own[0][3]
            at = np.full(parts, -1, np.int64)
            for k, (_, part, _, _, _) in enumerate(own):
                at[part] = k * blocks
            self.of[length] = (parts, blocks, at, np.frombuffer(b"".join(r[4] for r in own), np.uint64))

    def holds(self, keys: np.ndarray, length: int) -> np.ndarray:
        """Indices of the keys that the filter of a length may hold."""
        parts, blocks, first, bits = self.of[length]
        block = block_of(keys, blocks).astype(np.int64)
        open_ = None
        if parts > 1 or first[0] < 0:
            shard = first[part_of(keys, parts).astype(np.int64)]
            open_ = np.flatnonzero(shard >= 0)
            keys, block = keys[open_], block[open_] + shard[open_]
        some = np.flatnonzero(bits[block] & first_bit(keys))
        mask = mask_of(keys[some])
        some = some[bits[block[some]] & mask == mask]
        return some if open_ is None else open_[some]


def deletions(table: np.ndarray, p: np.ndarray, filters: Filters, keys: np.ndarray):
    """(keys, keys of their deletions) that a filter may hold."""
    n, length = table.shape
    if length - 1 not in filters.of:
        return
    whole = table.astype(np.uint64)
    # letters before a place by their powers, and those behind it by the powers one lower
    before = np.cumsum(whole * p[:length], axis=1, dtype=np.uint64) - whole * p[:length]
    lower = whole[:, 1:] * p[:length - 1]
    behind = lower.sum(axis=1, dtype=np.uint64)[:, None] - np.concatenate(
        [np.zeros((n, 1), np.uint64), np.cumsum(lower, axis=1, dtype=np.uint64)], axis=1)
    differs = np.ones(table.shape, bool)  # of equal letters side by side, the last one goes
    differs[:, :-1] = table[:, 1:] != table[:, :-1]
    row, _ = np.nonzero(differs)
    edits = finished((before + behind)[differs], length - 1)
    at = filters.holds(edits, length - 1)
    yield keys[row[at]], edits[at]


def replacements(table: np.ndarray, p: np.ndarray, filters: Filters, keys: np.ndarray):
    """(keys, keys of their replacements by later letters) that a filter may hold."""
    n, length = table.shape
    if length not in filters.of:
        return
    whole = table.astype(np.uint64)
    sums = (whole * p[:length]).sum(axis=1, dtype=np.uint64)
    step = max(1, MOST_EDITS // (n * len(LETTERS)))
    for k in range(0, length, step):
        own = table[:, k:k + step]
        later = LETTERS[None, None, :] > own[:, :, None]
        change = (LETTERS.astype(np.uint64)[None, None, :] - whole[:, k:k + step, None]) * p[None, k:k + own.shape[1], None]
        edits = finished((sums[:, None, None] + change)[later], length)
        at = filters.holds(edits, length)
        if len(at):
            per_row = np.cumsum(later.sum(axis=(1, 2)))
            yield keys[np.searchsorted(per_row, at, "right")], edits[at]


def positives(vocabulary: DataFrame, shards: DataFrame, rounds: int) -> DataFrame:
    """``a, b``: keys of words and of their edits that the filters hold."""
    spark = vocabulary.sparkSession
    out = spark.createDataFrame([], "a long, b long")

    def run_with(broadcast):
        def run(batches):
            cache = worker_cache()
            if cache.get("spelling", (None,))[0] != broadcast.value[0]:
                cache["spelling"] = (broadcast.value[0], Filters(broadcast.value[1]))
            filters = cache["spelling"][1]
            for batch in parts_of(batches, 10_000):
                words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
                every = batch.column("key").to_numpy().view(np.uint64)
                for length, at in by_length(words).items():
                    p, step = powers(length), max(1, MOST_EDITS // (length * len(LETTERS)))
                    for k in range(0, len(at), step):
                        table, keys = table_of([words[x] for x in at[k:k + step]], length), every[at[k:k + step]]
                        for find in (deletions, replacements):
                            for a, b in find(table, p, filters, keys):
                                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        return run

    for k in range(rounds):
        images = shards.where(F.col("round") == k).select("length", "part", "parts", "blocks", "image").collect()  # at most most_bytes
        if images:
            broadcast = spark.sparkContext.broadcast((uuid.uuid4().hex, [(*r[:4], bytes(r.image)) for r in images]))
            lengths = shards.where(F.col("round") == k).select("length")
            lengths = lengths.union(lengths.selectExpr("length + 1")).distinct()
            words = vocabulary.join(lengths, "length", "left_semi").select("word", "key")
            out = out.unionByName(stage(words.mapInArrow(run_with(broadcast), "a long, b long")))
            broadcast.unpersist()
    return out


def links(vocabulary: DataFrame, found: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: the pairs of near words, both ways."""
    first, second = (vocabulary.select(F.col("key").alias(k), F.struct("word", "n").alias(f"{k}_word")) for k in "ab")
    # equal hashes of different words would bring a pair up twice
    pairs = found.repartition("b").dropDuplicates(["b", "a"]).join(second, "b").join(first, "a")
    pairs = stage(pairs.where(F.levenshtein("a_word.word", "b_word.word", 1) == 1).select("a_word", "b_word"))
    columns = "{0}.word as word", "{0}.n as n", "{1}.word as near", "{1}.n as near_n"
    return pairs.selectExpr(*(c.format("a_word", "b_word") for c in columns)).unionByName(
        pairs.selectExpr(*(c.format("b_word", "a_word") for c in columns)))


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``word, root``: where the forms lead; each round doubles the steps, and a form is ``times`` as frequent as its word."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        step = stage(now.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not end in {rounds} rounds")


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, one_in: int = 31,
             shard_words: int = 1 << 18, most_bytes: int = 1 << 25) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word: its most frequent near word (of equal ones the first) where that is ``times``
    as frequent, and where such forms lead in the end."""
    counts = word_counts(docs, least_length, one_in).where(F.col("n") >= least_count)
    known = stage(vocabulary(counts))
    shards, rounds = rounds_of(filters(known, shard_words), ["length", "part"], "image", most_bytes)
    near = links(known, positives(known, shards, rounds))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = stage(best.select("word", "n_near", *(F.when(-F.col("best.less") >= times * F.col("n"), c).alias(a) for c, a in (
        (F.col("best.near"), "form"), (-F.col("best.less"), "form_n")))))
    root = roots(best.where("form is not null"))
    return (known.select("word", "n").join(best, "word", "left").join(root, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
