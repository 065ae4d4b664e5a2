"""Crawl-snapshot scans.

``resources`` rows: url, ok, http_status, status_text, content_type,
content_length, final_url, error, body -- unique by ``url``.  The reason of a
failed fetch is ``error`` or ``HTTP {status} {status_text}``; a URL missing
from the snapshot fails with ``not in snapshot`` (operators.fetch).
Local files are read with the ``binaryFile`` source and typed by extension
(E10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import PATH_ENCODE, guess_local_content_type, percent_encode

RESOURCE_COLUMNS = ("url", "ok", "http_status", "status_text", "content_type", "content_length",
                    "final_url", "error", "body")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A stored crawl snapshot (parquet); only the needed columns are read."""
    return spark.read.parquet(path).select(*RESOURCE_COLUMNS)


def read_local_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` as an ok resource at its ``file:`` URL."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select(F.regexp_replace("path", "^file:(//)?", "").alias("__p"), "content", "length"))
    url = F.concat(F.lit("file://"), percent_encode("`__p`", PATH_ENCODE))
    return df.select(
        url.alias("url"), F.lit(True).alias("ok"), F.lit(None).cast("int").alias("http_status"),
        F.lit(None).cast("string").alias("status_text"),
        guess_local_content_type(F.col("__p")).alias("content_type"),
        F.col("length").cast("long").alias("content_length"), url.alias("final_url"),
        F.lit(None).cast("string").alias("error"), F.decode("content", "UTF-8").alias("body"))


def write_bucketed_snapshot(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Store a crawl snapshot bucketed and sorted by ``url``.

    Joins on ``url`` with a side hash-partitioned into the same number of
    buckets then read the snapshot without shuffling its bodies (the probe and
    the winner-body joins of ``operators.fetch``)."""
    w = df.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
