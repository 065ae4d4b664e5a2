"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a parquet table under the shared ``spark.checkpoint.dir``
    and read it back: computed once, lineage cut, safe against lost executors."""
    return materialize(df, "table")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under ``spark.checkpoint.dir`` (not created), removed with the stage tables."""
    return scratch_folder(spark, what)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process, so that tasks of
    one worker share loaded vocabularies.  (Functions of this package are
    shipped by value, their module globals are new in every task.)"""
    name = "_mdweave_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].values = {}
    return sys.modules[name].values


def texts_of(batch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def parts_of(batches, rows: int = 512):
    """Arrow batches in smaller ones, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def slices(texts: list[str], chars: int):
    """(first, last) index pairs of consecutive texts of about ``chars`` code
    points; a longer text is a slice of its own."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def open_filesystem(uri: str):
    """(pyarrow file system, path) of a folder in the shared store."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, parts) -> int:
    """Write byte strings to ``uri`` through a temporary name, so that a task
    killed halfway leaves no broken file and a repeated task replaces it."""
    filesystem, path = open_filesystem(uri)
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    temporary, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with filesystem.open_output_stream(temporary, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    filesystem.move(temporary, path)
    return size


HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str = "group_size") -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``, with the number
    of its ``rows`` in ``size``), without a task that holds a hot group.

    A group with more than 1/1000 of all rows is hot.  There are at most 1,000 such groups,
    which bounds the broadcast that joins their rows where they are; the other
    rows shuffle, in groups that are small.  Both inputs are read more than
    once and should be written tables."""
    least = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n // HOT_SHARE
    hot = groups.where(F.col(size) > least)
    few = groups.where(F.col(size) <= least)
    spread = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(few, key)
    return spread.unionByName(others)


def rounds_of(shards: DataFrame, keys: list[str], image: str, most_bytes: int) -> tuple[DataFrame, int]:
    """``shards`` with the number of the round that broadcasts each, and how many rounds there
    are; the images of a round have at most ``most_bytes`` in all, or it holds one shard."""
    size = F.length(image) + 100
    n = max(1, math.ceil((shards.agg(F.sum(size)).first()[0] or 0) / most_bytes))
    while True:
        dealt = shards.withColumn("round", F.pmod(F.xxhash64(*keys, F.lit("round")), F.lit(n)).cast("int"))
        worst = dealt.groupBy("round").agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).where("n > 1").agg(F.max("bytes")).first()[0]
        if (worst or 0) <= most_bytes:
            return dealt, n
        n *= 2


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``edges(a long, b long)``.

    Alternating large-star / small-star rounds: each links the neighbours of a
    node to the smallest one, so the depth halves and the number of rows never
    grows beyond the edges.  Each round is written to the shared folder.  A node
    of very high degree is handled by a partially aggregated minimum and a join
    that AQE may split; no neighbour list is collected.
    Returns ``node, component`` (smallest node) for every node with an edge to
    another node.
    """
    edges = stage(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                  .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        # large star: every larger neighbour v of u goes to min(N(u), u)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = stage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
