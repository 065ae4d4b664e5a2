"""Spark queries against their DuckDB oracle SQL on the smallest driver data
(the driver runs the full set at sf0.01; tools/oracle_check.py does locally)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from mdweave.plans import queries as Q
from mdweave.sources.tables import TABLES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
NAMES = ["extract_links", "resolve_links", "link_rejects", "dedupe_links", "link_stats", "blocked_hosts", "first_success", "classify_content",
         "nested_paths", "flat_paths", "unique_paths", "install_plan", "registry_review", "source_resolution",
         "unique_paths_greedy", "path_prefixes", "html_text", "corpus_snapshot", "ingest_summary", "source_failures",
         "manifest_selection", "manifest_scan", "manifest_lists", "registry_order", "private_hosts", "local_content_types",
         "prefixed_paths"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows) == digest(rel.columns, drows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "run_status" in df.columns


def test_every_query_has_sql_or_is_documented():
    rows_only = {"html_to_markdown"}
    own = set(Q.QUERIES)
    assert own - set(E.oracle_sql()) == rows_only
