"""A table kept as a log (S6, U3): runs write what they change, readers take the newest row of each key.

A run appends one segment: changed and added rows, and for a removed key a row with ``deleted``; each with
the run's sequence number.  So a run that changes a hundredth of the rows writes about a hundredth.  A segment's
rows count unless a newer segment has their key, so only keys are compared, and the contents of the large old
segments stay where they are.  ``compact`` joins neighbouring segments of one size class into one, which changes nothing
that a reader sees; deletion marks go once the oldest segment is among them.  A pointer lists the live segments (``sources.pointers``).
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import pointers


def segments(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """Number of the newest pointer, and the live segments from old to new: first, last, rows, folder."""
    number, lines = pointers.newest(spark, root)
    return number, [json.loads(x) for x in lines]


def _rows(spark: SparkSession, root: str, segment: dict) -> DataFrame:
    return spark.read.parquet(f"{root}/{segment['folder']}")


def _newest(spark: SparkSession, root: str, live: list[dict], key: list[str]) -> DataFrame | None:
    """The newest row of each key in neighbouring segments, deletion marks included."""
    parts, newer = [], None
    for segment in reversed(live):
        rows = _rows(spark, root, segment)
        # a null in a key is a value like any other
        same = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__{k}") for k in key] + [F.col(k).isNull().alias(f"__no_{k}") for k in key]
        names = [f"__{k}" for k in key] + [f"__no_{k}" for k in key]
        rows = rows.select("*", *same)
        parts.append(rows if newer is None else rows.join(newer, names, "left_anti"))
        newer = rows.select(*names) if newer is None else newer.unionByName(rows.select(*names))
        parts[-1] = parts[-1].drop(*names)
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def read(spark: SparkSession, root: str, key: list[str]) -> DataFrame | None:
    """The table: its columns and ``seq``, the run that wrote each row; None before the first run."""
    rows = _newest(spark, root, segments(spark, root)[1], key)
    return None if rows is None else rows.filter("NOT deleted").drop("deleted")


def since(spark: SparkSession, root: str, seq: int, key: list[str]) -> DataFrame | None:
    """The keys that runs after ``seq`` changed or removed; only segments with such runs are read."""
    newer = [s for s in segments(spark, root)[1] if s["last"] > seq]
    parts = [_rows(spark, root, s).filter(F.col("seq") > seq).select(*key) for s in newer]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct() if parts else None


def append(changes: DataFrame, root: str, key: list[str], after: int | None = None) -> int:
    """Write the changes of a run (one row per ``key``, with ``deleted``) as its segment and publish it; its sequence
    number.  ``after`` is the pointer that the changes were made against: ``pointers.Conflict`` if another run came first."""
    spark = changes.sparkSession
    number, live = segments(spark, root)
    if after is not None and after != number:
        raise pointers.Conflict(f"{root}: made against {after}, now at {number}")
    seq = max([0, *(s["last"] for s in live)]) + 1
    folder = f"segments/{seq:012d}-{uuid.uuid4().hex}"
    changes.withColumn("seq", F.lit(seq).cast("long")).write.mode("errorifexists").parquet(f"{root}/{folder}")
    rows = spark.read.parquet(f"{root}/{folder}").count()
    segment = {"first": seq, "last": seq, "rows": rows, "folder": folder}
    pointers.publish(spark, root, [json.dumps(s) for s in [*live, segment]], number)
    return seq


def size_class(rows: int, fan: int) -> int:
    return int(math.log(rows + 1, fan))


def to_compact(live: list[dict], fan: int) -> tuple[int, int] | None:
    """(first, end) of the newest ``fan`` or more neighbours of one size class; a smaller one between them goes along."""
    end = len(live)
    while end:
        first, top = end - 1, size_class(live[end - 1]["rows"], fan)
        members = 1
        while first and size_class(live[first - 1]["rows"], fan) <= top:
            first -= 1
            members += size_class(live[first]["rows"], fan) == top
        if members >= fan or end - first > fan:
            return first, end
        end = first
    return None


def compact(spark: SparkSession, root: str, key: list[str], fan: int = 4) -> int:
    """Join segments until no size class (a factor ``fan`` of rows) has ``fan`` neighbours; how many joins that took."""
    done = 0
    while True:
        number, live = segments(spark, root)
        found = to_compact(live, fan)
        if not found:
            return done
        first, end = found
        rows = _newest(spark, root, live[first:end], key)
        if not first:  # nothing older that a mark could hide
            rows = rows.filter("NOT deleted")
        folder = f"segments/{live[first]['first']:012d}-{live[end - 1]['last']:012d}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{root}/{folder}")
        joined = {"first": live[first]["first"], "last": live[end - 1]["last"], "rows": spark.read.parquet(f"{root}/{folder}").count(), "folder": folder}
        pointers.publish(spark, root, [json.dumps(s) for s in [*live[:first], joined, *live[end:]]], number)
        done += 1


def expire(spark: SparkSession, root: str, keep: int = 0) -> int:
    """Remove the folders of segments that are not live (but for the ``keep`` newest of them); how many. Not while
    another run reads or writes: a run's segment is live only once it is published."""
    live = {s["folder"].split("/")[1] for s in segments(spark, root)[1]}
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{root}/segments")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    dead = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in live)
    dead = dead[:len(dead) - keep]
    for name in dead:
        fs.delete(path(folder, name), True)
    return len(dead)


def changes(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """What makes ``new`` out of ``old`` (read as ``read`` gives it): rows that are new or differ, and ``deleted`` rows
    (other columns null).  The other columns are compared by a hash; a row of ``new`` is not joined with its contents."""
    others = [c for c in new.columns if c not in key]
    digest = F.sha2(F.to_json(F.struct(*others), {"ignoreNullFields": "false"}), 256) if others else F.lit("")
    if old is None:
        return new.withColumn("deleted", F.lit(False))
    side = lambda df, a: df.select(*[F.col(k).alias(f"{a}_{k}") for k in key], digest.alias(f"{a}_digest"))
    same = reduce(lambda a, b: a & b, [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key])
    both = side(old, "o").join(side(new, "n"), same, "full")
    # read twice below: else each use compares all rows again, and takes digests twice to push its filters down
    touched = materialize(both.filter("o_digest IS NULL OR n_digest IS NULL OR o_digest <> n_digest"))
    gone = touched.filter("n_digest IS NULL").select(*[F.col(f"o_{k}").alias(k) for k in key]).withColumn("deleted", F.lit(True))
    there = touched.filter("n_digest IS NOT NULL").select(*[F.col(f"n_{k}").alias(f"n_{k}") for k in key])
    at = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in key])
    return new.join(there, at, "left_semi").withColumn("deleted", F.lit(False)).unionByName(gone, allowMissingColumns=True)
