"""S3: link-index scans.

A link index is one whole text per source, keyed by its ``file:`` URL.  ``read_index_lines`` reads files in byte
ranges that end with lines, many tasks to a file, and numbers the lines as one reader would;
``read_index_files`` gives small files as a table ``(source_url, body)``, which can also be used directly.  A source whose
index cannot be read becomes a row of ``source_failures`` instead of aborting
the whole batch (the reference aborts its single source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.links import split_index_lines
from ..session import materialize

INDEX_LOAD_FAILURE = "Failed to load llms.txt: "


def read_index_files(spark: SparkSession, paths) -> DataFrame:
    """(source_url, body) for each readable index file (``file:`` URLs)."""
    df = spark.read.text(paths, wholetext=True)
    return df.select(_file_url(F.input_file_name()).alias("source_url"), F.col("value").alias("body"))


def _file_url(name) -> F.Column:
    return F.concat(F.lit("file://"), F.regexp_replace(name, "^file:(//)?", ""))


def read_index_lines(spark: SparkSession, paths) -> DataFrame:
    """(source_url, line_pos, line) of index files of any size.

    Spark cuts a file into byte ranges and gives a line to the range that it starts in.  Lines are counted
    within a range, and the counts of the ranges before it (one row per range) are added.  A line ends
    with ``\\n``, before which one ``\\r`` goes; that may lie on the other side of a border."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__begin"),
        F.monotonically_increasing_id().alias("__n"), F.regexp_replace("value", "\r\\z", "").alias("line"))
    # written, so that lines and counts come from one reading
    lines = materialize(lines, "table")
    ranges = lines.groupBy("__file", "__begin").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__count"))
    before = Window.partitionBy("__file").orderBy("__begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0))).drop("__count")
    return lines.join(ranges, ["__file", "__begin"]).select(
        _file_url("__file").alias("source_url"), (F.col("__n") - F.col("__first") + F.col("__before")).cast("long").alias("line_pos"), "line")


def index_lines(link_index: DataFrame) -> DataFrame:
    """(source_url, line_pos, line) -- the per-line form every operator uses."""
    return split_index_lines(link_index)


def source_failures(requested: DataFrame, link_index: DataFrame, reason: str = "not found") -> DataFrame:
    """Requested sources without a readable index: (source_url, reason)."""
    return (requested.select("source_url").distinct()
            .join(link_index.select("source_url"), "source_url", "left_anti")
            .withColumn("reason", F.lit(INDEX_LOAD_FAILURE + reason)))
