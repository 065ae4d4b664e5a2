"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least ``c`` are at most ``sqrt(2 - 2c)`` apart, and so
are their projections to the leading principal dimensions.  The vectors of a label are
sorted by the cells of a grid of that size over these dimensions and cut into
sequences.  Two sequences are joined only if their leading cells touch and their
bounding boxes are near enough; the join halves both intervals again and again,
leaves out pairs of intervals that are provably too far apart, and compares the rest
by matrix products in double precision.  Sequences travel in blocks of ``BLOCK``, so that one of them goes once to
each block that it meets.  Every vector is scaled by a power of two first, which is exact and keeps its cosines, so
that no square or product overflows or vanishes.

Equal vectors are one class with a weight, and a pair of sequences gives link counts
and a spanning forest, so a large group of copies is never written as pairs.

Defined results: a vector that is null, zero or has null or non-finite components, or a
null label, links with nothing (0 links, its own component); vectors of different lengths
don't link; a null ``vec_id`` takes part but names no component unless it is alone; repeated rows
are vectors of their own; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_groups, parts_of, shuffle_partitions, stage

SEQUENCE = 2048
BLOCK = 4
LEAF = 256
SAMPLE = 4096  # vectors that the principal dimensions are fitted on


def keyed(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, key, data``: the vector as bytes and a key of equal ones, null if it can't link."""

    def run(batches):
        for batch in batches:
            keys, data = [], []
            for v, k in zip(batch.column("embedding"), batch.column("label").to_pylist()):
                x = None
                if k is not None and v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
                    if not (len(x) and np.isfinite(x).all() and x.any()):
                        x = None
                data.append(scaled(x).tobytes() if x is not None else None)
                keys.append(hashlib.sha256(b"%d:" % k + x.tobytes()).digest() if x is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"),
                                              pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                                             ["vec_id", "label", "key", "data"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"),
                          F.col(label).cast("long").alias("label"))
    return rows.mapInArrow(run, "vec_id long, label long, key binary, data binary")


def scaled(x: np.ndarray) -> np.ndarray:
    """By a power of two, so that the largest component is from 0.5 to 1."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def unit(data) -> np.ndarray:
    x = np.frombuffer(data, "<f8")
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def principal_dimensions(classes: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """Leading principal dimensions by vector length, from a bounded sample."""
    sample = classes.select("data").orderBy("class").limit(SAMPLE).collect()
    by_size: dict = {}
    for row in sample:
        by_size.setdefault(len(row.data), []).append(unit(row.data))
    return {size: np.linalg.eigh(np.cov(np.array(rows).T) if len(rows) > 1 else np.eye(size // 8))[1][:, ::-1][:, :leading].T
            if size > 8 else np.ones((1, 1)) for size, rows in by_size.items()}


def cells_of(x: np.ndarray, axes: dict, eps: float, leading: int) -> tuple[np.ndarray, list[int]]:
    """Projection and grid cells of a unit vector; lengths outside the sample use their first dimensions."""
    y = axes[8 * len(x)] @ x if 8 * len(x) in axes else x[:leading]
    y = np.r_[y, np.zeros(leading - len(y))]
    return y, np.floor(y / eps).astype(int).tolist()


class SequenceJoin:
    """Links between two sequences of vectors (or within one)."""

    def __init__(self, x, y, wx, wy, bx, by, eps: float, least: float, same: bool):
        self.x, self.y, self.bx, self.by = x, y, bx, by
        self.wx, self.wy, self.eps2, self.least, self.same = wx, wy, eps * eps, least, same
        self.nx, self.ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        self.links_x, self.links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.shift = 0 if same else len(x)
        self.parent = list(range(len(x) + (0 if same else len(y))))
        self.forest: list[tuple[int, int]] = []

    def find(self, p: int) -> int:
        while self.parent[p] != p:
            self.parent[p] = p = self.parent[self.parent[p]]
        return p

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Compare rows a..b of x with rows c..d of y."""
        if self.same and c < a:
            return
        p, q = self.bx[a:b], self.by[c:d]
        gap = np.maximum(np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)), 0)
        if gap @ gap > self.eps2:
            return  # provably too far apart
        if b - a <= LEAF and d - c <= LEAF:
            self.compare(a, b, c, d)
            return
        # both intervals are halved alike, so that a <= c holds for all parts of one sequence
        first = [(a, (a + b + 1) // 2), ((a + b + 1) // 2, b)] if b - a > LEAF else [(a, b)]
        second = [(c, (c + d + 1) // 2), ((c + d + 1) // 2, d)] if d - c > LEAF else [(c, d)]
        for i, j in first:
            for k, m in second:
                self.join(i, j, k, m)

    def compare(self, a: int, b: int, c: int, d: int) -> None:
        near = self.x[a:b] @ self.y[c:d].T / (self.nx[a:b, None] * self.ny[None, c:d]) >= self.least
        if self.same and a == c:
            near &= near.T
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links_x[a:b] += near @ self.wy[c:d]
        if not (self.same and a == c):
            (self.links_x if self.same else self.links_y)[c:d] += near.T @ self.wx[a:b]
        rows, columns = np.nonzero(near)
        first = near.argmax(axis=1)
        links = [(int(r) + a, int(first[r]) + c + self.shift) for r in np.unique(rows)]
        code = np.unique(columns.astype(np.int64) * LEAF + first[rows])
        links += [(int(k) // LEAF + c + self.shift, int(k) % LEAF + c + self.shift) for k in code]
        for p, q in links:
            u, v = self.find(p), self.find(q)
            if u != v:
                self.parent[u] = v
                self.forest.append((p, q))


def linked_classes(classes: DataFrame, least: float, leading: int) -> DataFrame:
    """``a, b, links``: links that connect the classes (``b``), or partial counts of links of ``a`` (null ``b``)."""
    spark = classes.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-7  # a little more for rounding
    axes = principal_dimensions(classes, leading)

    def project(batches):
        for batch in batches:
            found = [cells_of(unit(d), axes, eps, leading) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([y.tobytes() for y, _ in found], pa.binary()),
                 pa.array([c for _, c in found], pa.list_(pa.int32()))], [*batch.schema.names, "leading", "cells"])

    def cut(batches):
        """Sequences of vectors of one label and length, in grid order."""
        number, waiting, group = TaskContext.get().partitionId() << 32, [], None

        def sequence():
            cells = [r["cells"][0] for r in waiting]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in (
                    (number, pa.int64()), (group[0], pa.int64()), (group[1], pa.int32()), (min(cells), pa.int32()),
                    (max(cells), pa.int32()), (np.array([r["class"] for r in waiting], "<i8").tobytes(), pa.binary()),
                    (np.array([r["weight"] for r in waiting], "<i8").tobytes(), pa.binary()),
                    (b"".join(r["data"] for r in waiting), pa.binary()),
                    (b"".join(r["leading"] for r in waiting), pa.binary()))],
                ["number", "label", "size", "low", "high", "classes", "weights", "data", "boxes"])

        for batch in batches:
            for row in batch.to_pylist():
                if waiting and (group != (row["label"], row["size"]) or len(waiting) == SEQUENCE):
                    yield sequence()
                    number, waiting = number + 1, []
                group = (row["label"], row["size"])
                waiting.append(row)
        if waiting:
            yield sequence()

    order = ["label", "size", *(F.col("cells")[k] for k in range(leading)), "class"]
    ordered = stage(classes.select("class", "label", "weight", "data", F.octet_length("data").alias("size")).mapInArrow(
        project, "class long, label long, weight long, data binary, size int, leading binary, cells array<int>"))
    partitions = max(1, math.ceil(ordered.count() / SEQUENCE))
    sequences = stage(ordered.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(
        cut, "number long, label long, size int, low int, high int, classes binary, weights binary, data binary, boxes binary"))
    # pairs of sequences (not of rows) whose leading cells touch
    left = sequences.select(F.col("number").alias("a"), "label", "size",
                            F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)).alias("cell"))
    right = sequences.select(F.col("number").alias("b"), "label", "size", F.explode(F.sequence("low", "high")).alias("cell"))
    block = lambda c: F.expr(f"shiftright({c}, 32) div {BLOCK}")
    pairs = stage(left.join(right, ["label", "size", "cell"]).where("a <= b").select("a", "b").distinct()
                  .withColumn("i", block("a")).withColumn("j", block("b")))
    parts = ["classes", "weights", "data", "boxes"]
    kind = {"classes": "<i8", "weights": "<i8", "data": "<f8", "boxes": "<f8"}

    def compare(batches):
        blocks, held = None, {}
        for batch in parts_of(batches, 4):
            for row in batch.to_pylist():
                if blocks != (row["i"], row["j"]):
                    blocks, held = (row["i"], row["j"]), {}
                if row["a"] is None:
                    c, *others = (np.frombuffer(row[p], kind[p]) for p in parts)
                    held[row["number"]] = (c, others[0], *(x.reshape(len(c), -1) for x in others[1:]))
                    continue
                same = row["a"] == row["number"]
                (ci, wi, xi, bi), (cj, wj, xj, bj) = held[row["a"]], held[row["number"]]
                joined = SequenceJoin(xi, xj, wi, wj, bi, bj, eps, least, same)
                joined.join(0, len(ci), 0, len(cj))
                every = ci if same else np.r_[ci, cj]
                counts = joined.links_x if same else np.r_[joined.links_x, joined.links_y]
                at = np.flatnonzero(counts)
                a = np.r_[every[at], every[[p for p, _ in joined.forest]]]
                b = [None] * len(at) + every[[q for _, q in joined.forest]].tolist()
                n = counts[at].tolist() + [None] * len(joined.forest)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())],
                                                 ["a", "b", "links"])

    # what meets: the sequences of two blocks, then the pairs of them
    meetings = stage(pairs.select("i", "j").distinct())
    needed = meetings.select("i", "j", F.col("i").alias("block")).unionByName(meetings.where("i <> j").select("i", "j", F.col("j").alias("block")))
    placed = sequences.withColumn("block", block("number")).join(needed, "block").select(
        "i", "j", F.lit(None).cast("long").alias("a"), "number", *parts)
    rows = placed.unionByName(pairs.select("i", "j", "a", F.col("b").alias("number"), *(F.lit(None).cast("binary").alias(p) for p in parts)))
    tasks = max(shuffle_partitions(spark), meetings.count())
    return (rows.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", F.col("a").asc_nulls_first())
            .mapInArrow(compare, "a long, b long, links long"))


def embedding_components(vectors: DataFrame, least_cosine: float = 0.98, leading: int = 6, vec_id: str = "vec_id",
                         embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows = stage(keyed(vectors, vec_id, embedding, label))
    classes = stage(rows.where("key is not null").groupBy("key", "label")
                    .agg(F.any_value("data").alias("data"), F.count("*").alias("weight"), F.min("vec_id").alias("least_id"))
                    .withColumn("class", F.monotonically_increasing_id()))
    found = stage(linked_classes(classes, least_cosine, leading))
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    nodes = connected_components(found.where("b is not null").select("a", "b"))
    merged = stage(classes.select("class", "key", "weight", "least_id").join(counts, "class", "left")
                   .join(nodes.withColumnRenamed("node", "class"), "class", "left")
                   .withColumn("component", F.coalesce("component", "class")))
    least = merged.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = stage(merged.join(least, "component").select(
        "key", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    linked = join_groups(rows.where("key is not null").select("vec_id", "key"), known, "key", "weight")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.select("vec_id", "n_links", "component_id").unionByName(alone)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
