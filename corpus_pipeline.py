"""Corpus pipeline: documents that the quality classifier keeps, without exact and
near copies, with secrets masked, packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mdweave.llm import stages
from mdweave.llm.common import stage as written
from mdweave.sources.tables import load_table

STAGES = [
    ("quality", stages.quality),
    ("exact_dedup", stages.exact_dedup),
    ("simhash_dedup", stages.simhash_dedup),
    ("secrets", stages.secrets),
    ("packing", stages.packing),
]

#: The classifier, the tagger and the tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each reads the written rows of the one before."""
    docs = load_table(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = written(function(spark, docs, sf_dir))
    return docs
