"""SimHash near-dedup by tiled exact comparison.

The distinct fingerprints are sorted by the bit counts of their four 16-bit parts,
cut into blocks, and the blocks into tiles.  Two fingerprints within a radius differ
by no more than it in the sum of the differences of these counts, so blocks
and tiles whose counts lie further apart are skipped; the rest are compared as a
whole with exclusive-or and bit counts.  A pair of blocks gives a spanning forest of
its links, never all pairs of a group.

Defined results: null and empty texts have fingerprint zero and are linked like others;
a null ``doc_id`` takes part, and its component has the smallest id that is not null
(null if there is none); repeated rows are equal fingerprints; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_groups, parts_of, shuffle_partitions, stage

BLOCK = 1 << 15
TILE = 512
PARTS = 4  # 16 bits each
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, as an unsigned number."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:len(words) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    counts = np.zeros(2048, np.int64)
    for i in range(0, len(starts), SHINGLES_AT_ONCE):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[i:i + SHINGLES_AT_ONCE], ends[i:i + SHINGLES_AT_ONCE])]
        eight = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((eight + np.arange(8) * 256).ravel(), minlength=2048)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    ones = (counts.reshape(8, 256) @ bits).ravel()
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row_key`` (a hash of the text that tells rows of one id apart), ``fp``
    (the fingerprint as a signed long)."""

    def run(batches):
        for batch in parts_of(batches):
            fp = [fingerprint(t, words_per_shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"),
                                              pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "row_key", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("row_key"))
    return rows.mapInArrow(run, "doc_id long, row_key long, fp long")


def part_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit parts of every fingerprint."""
    return np.bitwise_count(fps.view("<u2").reshape(-1, PARTS)).astype(np.int16)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or within one) as index
    pairs; indexes of ``b`` follow those of ``a``."""
    parent = list(range(len(a) + (0 if same else len(b))))
    out: list[tuple[int, int]] = []
    shift = 0 if same else len(a)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def bounds(fps):
        counts, at = part_counts(fps), np.arange(0, len(fps), TILE)
        return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)

    low_a, high_a = bounds(a)
    low_b, high_b = bounds(b)
    apart = np.maximum(np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]), 0).sum(axis=2)
    for i, j in np.argwhere(apart <= radius):
        if same and j < i:
            continue
        x, y = a[i * TILE:(i + 1) * TILE], b[j * TILE:(j + 1) * TILE]
        near = np.bitwise_count(x[:, None] ^ y[None]) <= radius
        if same and i == j:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        rows, columns = np.nonzero(near)
        first = near.argmax(axis=1)
        # a row links to its first column, and its other columns link to that one too
        links = [(int(r) + i * TILE, int(first[r]) + j * TILE + shift) for r in np.unique(rows)]
        code = np.unique(columns.astype(np.int64) * TILE + first[rows])
        links += [(int(c) // TILE + j * TILE + shift, int(c) % TILE + j * TILE + shift) for c in code]
        for p, q in links:
            u, v = find(p), find(q)
            if u != v:
                parent[u] = v
                out.append((int(p), int(q)))
    return out


def linked_fingerprints(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints (column ``fp``) within ``radius`` bits."""
    spark = distinct.sparkSession
    part = [F.bit_count(F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(PARTS)]
    keys = [F.bit_count("fp").alias("ones")] + [p.alias(f"p{k}") for k, p in enumerate(part)]
    order = ["ones", *(f"p{k}" for k in range(PARTS)), "fp"]

    def cut(batches):
        """Blocks of one partition, with the least and the greatest bit count."""
        waiting, number = np.empty(0, np.int64), TaskContext.get().partitionId() << 32
        last = False
        batches = iter(batches)
        while not last:
            batch = next(batches, None)
            last = batch is None
            if not last:
                waiting = np.r_[waiting, batch.column("fp").to_numpy()]
            while len(waiting) >= BLOCK or last and len(waiting):
                block, waiting = waiting[:BLOCK], waiting[BLOCK:]
                ones = np.bitwise_count(block.view(np.uint64))
                yield pa.RecordBatch.from_pydict({"block": [number], "low": pa.array([int(ones.min())], pa.int32()),
                                                  "high": pa.array([int(ones.max())], pa.int32()),
                                                  "fps": pa.array([block.tobytes()], pa.binary())})
                number += 1

    partitions = max(1, math.ceil(distinct.count() / BLOCK))
    blocks = stage(distinct.select("fp", *keys).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
                   .select("fp").mapInArrow(cut, "block long, low int, high int, fps binary"))
    # pairs of blocks (not of rows) whose bit counts come within the radius
    left = blocks.select(F.col("block").alias("a"),
                         F.explode(F.sequence(F.col("low") - radius, F.col("high") + radius)).alias("ones"))
    right = blocks.select(F.col("block").alias("b"), F.explode(F.sequence("low", "high")).alias("ones"))
    pairs = stage(left.join(right, "ones").where("a <= b").select("a", "b").distinct())

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c], np.uint64) for c in ("x", "y"))
                same = row["a"] == row["b"]
                links = forest(a, b, radius, same)
                if links:
                    every = (a if same else np.r_[a, b]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(every[[p for p, _ in links]]),
                                                      pa.array(every[[q for _, q in links]])], ["a", "b"])

    tasks = max(shuffle_partitions(spark), math.ceil(pairs.count() / 8))
    both = (pairs.join(blocks.select(F.col("block").alias("a"), F.col("fps").alias("x")), "a")
            .join(blocks.select(F.col("block").alias("b"), F.col("fps").alias("y")), "b"))
    return both.repartition(tasks, "a", "b").mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, words_per_shingle: int = 3, radius: int = 3,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (hex), ``component_id`` (smallest id that links reach),
    ``row_key``, ``kept`` (the row, or one of equal rows, that stands for its component)."""
    rows = stage(fingerprints(docs, words_per_shingle, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    distinct = stage(rows.groupBy("fp").agg(first, F.count("*").alias("n_rows")))
    nodes = connected_components(linked_fingerprints(distinct, radius))
    classes = stage(distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "first", "n_rows", F.coalesce("component", "fp").alias("component")))
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    classes = stage(classes.join(least, "component").select("fp", "n_rows", F.col("least.doc_id").alias("component_id"),
                                                      F.col("least.row_key").alias("least_key")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("least_key"))
    return join_groups(rows, classes, "fp", "n_rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key", kept.alias("kept"))
