"""Every query of the subpackage and the pipeline run on the smallest tables."""

import pytest

import __spark_entry__ as E
import corpus_pipeline

SF = "/root/testdata/sf0.001"
TABLES = {3: "embeddings", 10: "pages"}


def test_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


@pytest.mark.parametrize("number", [n for n in range(1, 14) if n not in (4, 11, 13)])
def test_one_row_per_row(spark, number):
    name = next(n for n in E.queries() if n.startswith(f"op{number}_"))
    rows = spark.read.parquet(f"{SF}/{TABLES.get(number, 'documents')}.parquet").count()
    assert E.queries()[name](spark, SF).count() == rows


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns)
    kept = out.select("doc_id").distinct().count()
    assert 0 < kept <= spark.read.parquet(f"{SF}/documents.parquet").count()
    packed = E.queries()["op4_best_fit_packing"](spark, SF)
    assert packed.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
