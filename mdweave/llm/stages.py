"""Stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)``.

All but the last return rows of ``docs`` with its columns, whatever else they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table
from . import exact_dedup as exact
from . import packing as packer
from . import quality as classifier
from . import secret_crf, simhash
from .common import stage


def keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decisions(doc_id, row_key, kept)`` keeps.

    The decisions are narrow; the rows of ``docs`` are looked up by id and a hash of the
    text.  Only rows that repeat with both are reduced to one."""
    decisions = stage(decisions.select("doc_id", "row_key", "kept"))
    rows = docs.withColumn("__row", F.xxhash64("text"))
    found = (decisions.groupBy("doc_id", "row_key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
             .where("kept").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "n"))
    same = rows["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
    once = rows.join(found.where("n = 1"), same, "left_semi")
    repeated = rows.join(found.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "__row"])
    return once.unionByName(repeated).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects (a score under 0.7)."""
    model = classifier.fit(docs, load_table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model, threshold=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return keep(docs, exact.exact_duplicates(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays."""
    return keep(docs, simhash.simhash_components(docs, words_per_shingle=3, radius=3))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text."""
    return secret_crf.masked(docs, secret_crf.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2,048 tokens, with their ids."""
    parts = packer.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), length=2048)
    return packer.pack(parts, length=2048)
