"""Source divergence audit: how far the sources of a language differ, by a recount through minimal perfect hashes.

The first pass counts exactly in how many documents of its language a term stands; terms of at least
``least_documents`` are kept.  They are dealt into shards of about ``shard_terms``, and one task builds the
minimal perfect hash of a shard, with the terms by slot (``PerfectHash``).  The second pass reads the documents again,
with the shards broadcast: a term's slot counts only if the key stored there is the term, and goes up in the dense
slots of its group ``(lang, source)``.  A broadcast holds shards of at most ``most_bytes``; more shards take more rounds.

The counts of a group are summed shard by shard, ``fan`` tasks at a time.  Sources are compared in tiles
of about ``tile`` of a language over one shard, so that a task holds two tiles of one shard; the sums of the shards are
added up.  Divisions are exact in 64 bits (``probabilities``) while a language has under 9 * 10**15 terms.

Defined results: null text, lang and source are empty strings; every row is a document, repeated ids and rows too; a
group without terms counts zero everywhere; a language without kept terms gives pairs of value 0 and no term; a
language with one source has no pairs; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, parts_of, rounds_of, stage, worker_cache

#: Bytes that are no part of a term become spaces, A-Z becomes a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE_STEPS, SCALE_STEP = 3, 1000  # the contract's 10**9, in three steps of a long division
MOST_TERMS = 400_000  # distinct terms that a task of the first pass keeps at once
MOST_SLOTS = 1 << 23  # counters that a task of the second pass keeps at once


def terms_of(data: bytes, size: int = 1 << 21):
    """Lists of the terms of a text in UTF-8, about ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and FOLD[data[end]] != 32:  # a term stays whole
            end += 1
        yield data[at:end].translate(FOLD).split()
        at = end


def rows_of(docs: DataFrame) -> DataFrame:
    empty = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*empty, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def frequencies(rows: DataFrame) -> DataFrame:
    """``lang, term, n``: documents of the language with the term."""

    def run(batches):
        kept: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, found in kept.items():
                terms, counts = list(found), list(found.values())
                for k in range(0, len(terms), 20_000):
                    part = [t.decode() for t in terms[k:k + 20_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.string()),
                                                      pa.array(counts[k:k + 20_000], pa.int64())], ["lang", "term", "n"])
            kept.clear()

        for batch in parts_of(batches, 256):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                kept[lang].update(set().union(*terms_of(text)))
            if sum(map(len, kept.values())) > MOST_TERMS:
                yield from flush()
        yield from flush()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    x = hashes ^ np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hash_of(term: bytes) -> int:
    """As Spark's ``xxhash64`` of the string, unsigned."""
    return xxhash.xxh64_intdigest(term, 42)


class PerfectHash:
    """Minimal perfect hash of distinct terms, with the terms by slot.

    Each level has twice as many bits as terms are left; a term that is alone on its bit has its
    slot there (the number of set bits before it), the others go to the next level.  Terms whose 64-bit hashes
    are equal never part and have the last slots, found by name."""

    LEVELS = 64

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, int]], keys: list[bytes], rest: int):
        self.levels, self.keys = levels, keys
        self.rest = {t: len(keys) - rest + k for k, t in enumerate(keys[len(keys) - rest:])}

    @classmethod
    def build(cls, terms: list[bytes]) -> PerfectHash:
        hashes = np.fromiter(map(hash_of, terms), np.uint64, len(terms))
        left, levels, order, base = np.arange(len(terms)), [], [], 0
        while len(left) and len(levels) < cls.LEVELS:
            size = 2 * len(left) + 1
            at = (mixed(hashes[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(np.r_[alone, np.zeros(-size % 64, bool)], bitorder="little").view("<u8")
            ranks = base + np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
            levels.append((bits, ranks, size))
            placed = alone[at]
            order.append(left[placed][np.argsort(at[placed])])
            base += int(placed.sum())
            left = left[~placed]
        order = np.concatenate([*order, left]).astype(int).tolist() if terms else []
        return cls(levels, [terms[k] for k in order], len(left))

    def slots(self, terms: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Slot of each term, -1 for a term that isn't one of the keys."""
        found, open_ = np.full(len(terms), -1, np.int64), np.arange(len(terms))
        for level, (bits, ranks, size) in enumerate(self.levels):
            at = (mixed(hashes[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[hit]] = ranks[at[hit] >> 6] + before[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        # the stored key decides
        keys, rest = self.keys, self.rest
        return np.fromiter((s if s >= 0 and keys[s] == t else rest.get(t, -1) for s, t in zip(found.tolist(), terms)),
                           np.int64, len(terms))

    def image(self) -> bytes:
        out = [struct.pack("<QQ", len(self.levels), len(self.rest))]
        for bits, ranks, size in self.levels:
            out += [struct.pack("<Q", size), bits.tobytes(), ranks.tobytes()]
        return b"".join([*out, b"\n".join(self.keys)])  # no term has a line feed

    @classmethod
    def load(cls, image: bytes) -> PerfectHash:
        n, rest = struct.unpack_from("<QQ", image)
        at, levels = 16, []
        for _ in range(n):
            size, = struct.unpack_from("<Q", image, at)
            words = -(-size // 64)
            bits, ranks = np.frombuffer(image, "<u8", words, at + 8), np.frombuffer(image, "<i8", words, at + 8 + 8 * words)
            levels.append((bits, ranks, size))
            at += 8 + 16 * words
        return cls(levels, image[at:].split(b"\n") if at < len(image) else [], rest)


def perfect_hashes(kept: DataFrame, shard_terms: int) -> DataFrame:
    """``lang, part, parts, v, n, image`` of the shards of the kept terms; a task holds one shard at a time."""
    sizes = stage(kept.groupBy("lang").agg(F.count("*").alias("v"))
                  .withColumn("parts", F.ceil(F.col("v") / shard_terms).cast("int")))
    rows = join_groups(kept.select("lang", "term"), sizes, "lang", "v").withColumn("part", F.expr("int(pmod(xxhash64(term), parts))"))

    def run(batches):
        key, terms = None, []

        def built():
            p = PerfectHash.build(terms)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, len(terms), p.image()), (
                pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["lang", "part", "parts", "v", "n", "image"])

        for batch in parts_of(batches, 10_000):
            for *k, term in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "parts", "v", "term"))):
                if k != key:
                    if key:
                        yield built()
                    key, terms = k, []
                terms.append(term.encode())
        if key:
            yield built()

    dealt = rows.select("lang", "part", "parts", "v", "term").repartition("lang", "part").sortWithinPartitions("lang", "part", "term")
    return stage(dealt.mapInArrow(run, "lang string, part int, parts int, v long, n long, image binary"))


class Shards:
    """The broadcast shards: places of terms in the slots of their language."""

    def __init__(self, rows):
        self.parts, self.of = {}, defaultdict(dict)
        for lang, part, parts, n, image in rows:
            self.parts[lang] = parts
            self.of[lang][part] = (n, PerfectHash.load(image))
        self.first, self.width = {}, {}
        for lang, shards in self.of.items():
            at = 0
            for part in sorted(shards):
                self.first[lang, part] = at
                at += shards[part][0]
            self.width[lang] = at

    def places(self, lang: str, terms: list[bytes]) -> np.ndarray:
        hashes = np.fromiter(map(hash_of, terms), np.uint64, len(terms))
        part = np.mod(hashes.view(np.int64), self.parts[lang])
        out = np.full(len(terms), -1, np.int64)
        for p, (_, table) in self.of[lang].items():
            at = np.flatnonzero(part == p)
            if len(at):
                slots = table.slots([terms[k] for k in at.tolist()], hashes[at])
                out[at] = np.where(slots >= 0, slots + self.first[lang, p], -1)
        return out


def smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def recounts(rows: DataFrame, shards: DataFrame, rounds: int) -> list[DataFrame]:
    """Second pass: ``lang, source (null: the whole language), part, task, n, gaps, counts`` of the slots that a task counted."""
    spark, out = rows.sparkSession, []

    def run_with(broadcast):
        def run(batches):
            cache = worker_cache()
            if cache.get("divergence", (None,))[0] != broadcast.value[0]:
                cache["divergence"] = (broadcast.value[0], Shards(broadcast.value[1]))
            index, task = cache["divergence"][1], TaskContext.get().partitionId()
            slots: dict[tuple[str, str], np.ndarray] = {}

            def flush():
                whole: dict[str, np.ndarray] = {}
                for (lang, _), counts in slots.items():
                    whole[lang] = whole[lang] + counts if lang in whole else counts
                for (lang, source), counts in [*slots.items(), *(((lang, None), c) for lang, c in whole.items())]:
                    for part, (n, _) in index.of[lang].items():
                        own = counts[index.first[lang, part]:][:n]
                        at = np.flatnonzero(own)
                        if len(at):
                            gaps, many = smallest(np.diff(at, prepend=0)), smallest(own[at])
                            row = (lang, source, part, task, n, f"{gaps.dtype.str} {many.dtype.str}", gaps.tobytes(), many.tobytes())
                            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, PARTIAL.types)], PARTIAL.names)
                slots.clear()

            def count(bags):
                for lang, by_source in bags.items():
                    every = list(set().union(*by_source.values()))
                    place = dict(zip(every, index.places(lang, every).tolist()))
                    for source, bag in by_source.items():
                        at = np.fromiter(map(place.__getitem__, bag), np.int64, len(bag))
                        many = np.fromiter(bag.values(), np.int64, len(bag))
                        if (lang, source) not in slots:
                            if sum(map(len, slots.values())) + index.width[lang] > MOST_SLOTS:
                                yield from flush()
                            slots[lang, source] = np.zeros(index.width[lang], np.int64)
                        slots[lang, source][at[at >= 0]] += many[at >= 0]

            bags, held = defaultdict(lambda: defaultdict(Counter)), 0
            for batch in parts_of(batches):
                for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    if lang in index.of:
                        for terms in terms_of(text):
                            bags[lang][source].update(terms)
                            held += len(terms)
                            if held > 500_000:
                                yield from count(bags)
                                bags.clear()
                                held = 0
            yield from count(bags)
            yield from flush()
        return run

    for k in range(rounds):
        images = shards.where(F.col("round") == k).select("lang", "part", "parts", "n", "image").collect()  # at most most_bytes
        if images:
            broadcast = spark.sparkContext.broadcast((uuid.uuid4().hex, [(*r[:4], bytes(r.image)) for r in images]))
            out.append(stage(rows.mapInArrow(run_with(broadcast), PARTIAL_SQL)))
            broadcast.unpersist()
    return out


PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.int32()), ("task", pa.int32()), ("n", pa.int64()),
                     ("kind", pa.string()), ("gaps", pa.binary()), ("counts", pa.binary())])
PARTIAL_SQL = "lang string, source string, part int, task int, n long, kind string, gaps binary, counts binary"


def added_up(partial: DataFrame, fan: int) -> DataFrame:
    """Sums of the rows of each group, shard and ``task``, with ``task`` divided by ``fan``; a task holds one row's slots."""

    def run(batches):
        key, counts = None, None

        def done():
            at = np.flatnonzero(counts)
            gaps, many = smallest(np.diff(at, prepend=0)), smallest(counts[at])
            row = (*key[:4], len(counts), f"{gaps.dtype.str} {many.dtype.str}", gaps.tobytes(), many.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, PARTIAL.types)], PARTIAL.names)

        for batch in parts_of(batches, 64):
            for *k, n, kind, gaps, many in zip(*(batch.column(c).to_pylist() for c in PARTIAL.names)):
                if k != key:
                    if key:
                        yield done()
                    key, counts = k, np.zeros(n, np.int64)
                add(counts, kind, gaps, many)
        if key:
            yield done()

    dealt = partial.withColumn("task", F.expr(f"task div {fan}").cast("int")).repartition("lang", "part", "source", "task")
    return dealt.sortWithinPartitions("lang", "part", "source", "task").mapInArrow(run, PARTIAL_SQL)


def add(counts: np.ndarray, kind: str | None, gaps: bytes, many: bytes) -> None:
    if kind:
        a, b = kind.split()
        counts[np.cumsum(np.frombuffer(gaps, a), dtype=np.int64)] += np.frombuffer(many, b).astype(np.int64)


def probabilities(counts: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(10**9 * (count + 1) / total)``, exactly: a long division in steps of 1,000."""
    left, out = counts + 1, np.zeros(len(counts), np.int64)
    whole, left = np.divmod(left, total)
    for _ in range(SCALE_STEPS):
        digit, left = np.divmod(left * SCALE_STEP, total)
        whole, out = whole * SCALE_STEP, out * SCALE_STEP + digit
    return 1 + whole + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def compared(vectors: DataFrame, top: int) -> DataFrame:
    """``lang, source, item, part, slot, value`` from the vectors of a shard and two tiles, streamed in their order: the summed
    value of each pair over the shard (slot null), and the slots of each source that can be in its ``top`` (item null)."""
    names = ["lang", "part", "i", "j", "source", "tile", "total", "v", "n", "kind", "gaps", "counts"]
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())

    def run(batches):
        def rows(key, whole, tiles):
            lang, part, i, j = key
            out = []
            left, right = tiles[i], tiles[j] if i != j else []
            for a, p, _ in left:
                for b, q, _ in left if i == j else right:
                    if a != b:
                        out.append((lang, a, b, part, None, int(divergence(p, q).sum())))
                        if i != j:
                            out.append((lang, b, a, part, None, int(divergence(q, p).sum())))
            if i == j and whole is not None:
                for a, p, counts in left:
                    at = np.flatnonzero((counts > 0) & (p > whole))
                    value = divergence(p[at], whole[at])
                    if len(at) > top:  # with all that tie with the last
                        most = value >= np.partition(value, -top)[-top]
                        at, value = at[most], value[most]
                    out += [(lang, a, None, part, s, x) for s, x in zip(at.tolist(), value.tolist())]
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k:k + 10_000]), types)],
                                                 ["lang", "source", "item", "part", "slot", "value"])

        key, whole, tiles = None, None, defaultdict(list)
        for batch in parts_of(batches, 64):
            for *k, source, tile, total, v, n, kind, gaps, many in zip(*(batch.column(c).to_pylist() for c in names)):
                if k != key:
                    if key:
                        yield from rows(key, whole, tiles)
                    key, whole, tiles = k, None, defaultdict(list)
                counts = np.zeros(n, np.int64)
                add(counts, kind, gaps, many)
                p = probabilities(counts, total + v) if n else counts
                if source is None:
                    whole = p
                else:
                    tiles[tile].append((source, p, counts))
        if key:
            yield from rows(key, whole, tiles)

    dealt = vectors.select(*names).repartition("lang", "part", "i", "j").sortWithinPartitions("lang", "part", "i", "j", "source")
    return dealt.mapInArrow(run, "lang string, source string, item string, part int, slot long, value long")


def terms_by_slot(shards: DataFrame) -> DataFrame:
    """``lang, part, slot, item`` of the kept terms."""

    def run(batches):
        for batch in parts_of(batches, 1):
            lang, part, image = (batch.column(c)[0].as_py() for c in ("lang", "part", "image"))
            keys = PerfectHash.load(image).keys
            for k in range(0, len(keys), 10_000):
                terms = [t.decode() for t in keys[k:k + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([part] * len(terms), pa.int32()),
                                                  pa.array(range(k, k + len(terms)), pa.int64()), pa.array(terms, pa.string())],
                                                 ["lang", "part", "slot", "item"])

    return shards.select("lang", "part", "image").mapInArrow(run, "lang string, part int, slot long, item string")


def audit(docs: DataFrame, least_documents: int = 3, top: int = 200, shard_terms: int = 1 << 15, most_bytes: int = 1 << 25,
          tile: int = 32, fan: int = 256) -> DataFrame:
    """``lang, source, part, item, value, rank``: the divergence of each source from the others of its language (part
    ``pair``), and of its terms from the whole language (part ``term``, ranks to ``top``)."""
    rows = rows_of(docs)
    groups = stage(rows.groupBy("lang", "source").agg(F.count("*").alias("documents")))
    kept = stage(frequencies(rows).where(F.col("n") >= least_documents))
    shards, rounds = rounds_of(perfect_hashes(kept, shard_terms), ["lang", "part"], "image", most_bytes)
    spark = docs.sparkSession
    partial = spark.createDataFrame([], PARTIAL_SQL)
    for counted in recounts(rows, shards, rounds):
        partial = partial.unionByName(counted)

    # every group has a row of each shard of its language; a language without terms has one shard of no slots
    langs = stage(groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("documents").alias("group_size")))
    parts = (langs.join(shards.select("lang", "part", "v", "n"), "lang", "left")
             .select("lang", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("v", F.lit(0)).alias("v"),
                     F.coalesce("n", F.lit(0)).alias("n"), F.greatest(F.ceil(F.col("sources") / tile), F.lit(1)).cast("int").alias("tiles")))
    parts = stage(parts)
    zeros = (groups.select("lang", "source").unionByName(langs.select("lang", F.lit(None).cast("string").alias("source")))
             .join(parts, "lang").select("lang", "source", "part", F.lit(0).alias("task"), "n", F.lit(None).cast("string").alias("kind"),
                                         F.lit(None).cast("binary").alias("gaps"), F.lit(None).cast("binary").alias("counts")))
    tasks = (partial.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > fan:
        partial, tasks = stage(added_up(partial, fan)), -(-tasks // fan)
    summed = stage(added_up(partial.unionByName(zeros), max(tasks, 1)))

    return ranked(summed, parts, shards, top)


def totals(summed: DataFrame) -> DataFrame:
    """``lang, source, total``: counted terms of each group and (source null) language."""

    def run(batches):
        for batch in parts_of(batches, 64):
            sums = [int(np.frombuffer(c, k.split()[1]).sum(dtype=np.int64)) for k, c in
                    zip(batch.column("kind").to_pylist(), batch.column("counts").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), pa.array(sums, pa.int64())],
                                             ["lang", "source", "total"])

    each = summed.select("lang", "source", "kind", "counts").mapInArrow(run, "lang string, source string, total long")
    return stage(each.groupBy("lang", "source").agg(F.sum("total").alias("total")))


def ranked(summed: DataFrame, parts: DataFrame, shards: DataFrame, top: int) -> DataFrame:
    total = totals(summed).withColumnsRenamed({"lang": "l", "source": "s"})
    rows = (summed.join(total, (F.col("lang") == F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
            .join(parts.select("lang", "part", "v", "tiles"), ["lang", "part"])
            .withColumn("tile", F.expr("if(source is null, -1, int(pmod(xxhash64(source), tiles)))")))
    # a source meets every tile, the whole language is needed once in each
    pairs = rows.withColumn("ij", F.explode(F.expr(
        "transform(sequence(0, tiles - 1), b -> if(source is null, struct(b as i, b as j), "
        "struct(least(tile, b) as i, greatest(tile, b) as j)))"))).select("*", "ij.i", "ij.j")
    found = stage(compared(pairs, top))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = (found.where("slot is null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
            .withColumn("rank", F.row_number().over(order)))
    term = (found.where("slot is not null").drop("item").join(terms_by_slot(shards), ["lang", "part", "slot"])
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    columns = ["lang", "source", "item", "value", "rank"]
    out = pair.select(F.lit("pair").alias("part"), *columns).unionByName(term.select(F.lit("term").alias("part"), *columns))
    return out.select("lang", "source", "part", "item", "value", "rank")
