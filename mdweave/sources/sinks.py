"""Sinks: corpus snapshot (S6), manifest (S7) and review reports.

Snapshots are never overwritten in place: each run writes a new version
directory, then adds a small pointer file (``sources.pointers``).  Readers take the newest
pointer first, so a failed or running write is never observed, and the
previous version stays readable while the next one is written.  ``sources.log`` writes changes only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import pointers


def current_version(spark: SparkSession, root: str) -> str | None:
    """The newest version of ``root``; None only if it has none yet."""
    _, lines = pointers.newest(spark, root)
    return lines[0] if lines else None


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Add a pointer to ``version``; of two runs that end at once, each gets a number of its own."""
    while True:
        try:
            pointers.publish(spark, root, [f"v={version}"])
            return
        except pointers.Conflict:
            continue


def write_snapshot(df: DataFrame, root: str, version: str, partition_by=("collection",)) -> str:
    """Write ``df`` to ``root/v=<version>``, then point at it."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    _point(df.sparkSession, root, version)
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    v = current_version(spark, root)
    return spark.read.parquet(f"{root}/{v}") if v else None


MANIFEST_TABLES = ("installs", "managed_files", "selected_urls")


def write_manifest(tables: dict, root: str, version: str) -> None:
    """The three long-form manifest tables as parquet (not byte-compatible
    with the reference's JSON; the content is the same), under one pointer, so that
    a reader never sees tables of two runs."""
    for name in MANIFEST_TABLES:
        tables[name].write.mode("errorifexists").parquet(f"{root}/v={version}/{name}")
    _point(tables["installs"].sparkSession, root, version)


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest tables of the newest complete run, or None before the first."""
    v = current_version(spark, root)
    return {name: spark.read.parquet(f"{root}/{v}/{name}") for name in MANIFEST_TABLES} if v else None


def write_review(reviewed: DataFrame, report: DataFrame, json_path: str, markdown_path: str) -> None:
    """Results as JSON lines; the report lines globally ordered
    (range-partitioned sort) and written as text part files whose
    concatenation in file-name order is the Markdown report -- no single task
    holds the whole report."""
    reviewed.write.mode("overwrite").json(json_path)
    (report.orderBy("section", "ord", "sub").select("line")
     .write.mode("overwrite").text(markdown_path))
