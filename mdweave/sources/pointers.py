"""Numbered pointer files: what a versioned table consists of, number by number.

A pointer is created exclusively, so of two writers with one number one fails, and counts
only once its last line is there, so one that broke off is never followed.  No pointer is ever changed.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

END = "end"
STALE_SECONDS = 600  # after that, a pointer without its last line is that of a writer that broke off


class Conflict(Exception):
    """Another writer was first; read again and repeat."""


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, list[str]]]:
    """(number, lines) of the complete pointers, the newest two only."""
    try:
        files = spark.read.text(f"{root}/pointers", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    number = F.regexp_extract(F.input_file_name(), r"([0-9]+)$", 1).cast("long")
    complete = files.select(number.alias("n"), F.split("value", "\n").alias("lines")).filter(
        (F.element_at("lines", -1) == "") & (F.get("lines", F.size("lines") - 2) == END))
    return [(r.n, r.lines[:-2]) for r in complete.orderBy(F.desc("n")).limit(2).collect()]


def newest(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """Number and lines of the newest pointer; 0 and no lines only if there is none."""
    found = _pointers(spark, root)
    return found[0] if found else (0, [])


def publish(spark: SparkSession, root: str, lines: list[str], after: int | None = None) -> int:
    """Add the next pointer (``after`` the one that the caller has read); ``Conflict`` if another writer has added or is adding one."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{root}/pointers")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    if after is None:
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        after = max((int(n) for n in names if n.isdigit()), default=0)
    elif newest(spark, root)[0] > after:
        raise Conflict(f"{root}: {after} is no longer the newest")
    target = path(folder, f"{after + 1:012d}")
    while fs.exists(target):
        if time.time() - fs.getFileStatus(target).getModificationTime() / 1000 < STALE_SECONDS:
            raise Conflict(str(target))
        after += 1
        target = path(folder, f"{after + 1:012d}")
    try:
        out = fs.create(target, False)
    except Exception as e:  # the store says so in a class of its own
        if fs.exists(target):
            raise Conflict(str(target)) from e
        raise
    out.write(bytearray("".join(f"{x}\n" for x in [*lines, END]).encode()))
    out.close()
    return after + 1
