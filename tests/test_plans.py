"""Plan checks: native queries stay in the JVM, bodies stay out of the probe
join, aggregations are partial, materialisation uses the checkpoint dir."""

import re

import pytest

from mdweave.operators import fetch as FE
from mdweave.plans import queries as Q
from mdweave.plans import views as V

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def lazy(spark):
    spark.conf.set("mdweave.materialize", "none")
    yield spark
    spark.conf.set("mdweave.materialize", "table")


@pytest.mark.parametrize("name", ["resolve_links", "dedupe_links", "candidate_urls",
                                  "install_plan", "registry_review", "markdown_docs", "nested_paths", "flat_paths",
                                  "local_paths", "parsed_hosts"])
def test_no_python_in_native_queries(lazy, name):
    p = plan_of(Q.QUERIES[name](lazy, SF))
    assert "Python" not in p and "ArrowEval" not in p, name


def test_bodies_not_in_probe(lazy):
    df = FE.first_success(Q._site_selected(lazy, SF), V.crawl_resources(lazy, SF))
    # no column named ``body`` (the resolver's own ``__x_body`` stages aside)
    assert re.search(r"(?<![_A-Za-z])body#", plan_of(df)) is None


def test_dedupe_is_partial_aggregation(lazy):
    p = plan_of(Q.QUERIES["dedupe_links"](lazy, SF))
    assert "Exchange hashpartitioning(source_url" in p
    assert p.count("Aggregate") >= 2


def test_materialize_uses_checkpoint_dir(spark):
    from mdweave.session import ensure_checkpoint_dir, materialize
    d = ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
    df = materialize(spark.range(10))
    assert df.count() == 10
    assert d.rstrip("/") in " ".join(df.inputFiles())


def test_stages_of_the_import(spark, monkeypatch):
    """How many tables an import writes, and that contents go through one join."""
    from mdweave import session
    from mdweave.operators import convert, fetch, links, paths, sync
    from mdweave.plans import ingest
    written, write = [], session.materialize
    for module in (session, ingest, convert, fetch, links, paths, sync):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", lambda *a, **k: written.append(1) or write(*a, **k))
    lines, resources = V.host_index_lines(spark, SF), V.crawl_resources(spark, SF)
    out = ingest.ingest(lines, Q._site_sources(lines), resources)
    assert len(written) <= 9  # links, entries, documents, names (three), results, plan, summary
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_of(out["snapshot"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [part.split("\n")[1] for part in p.split("Exchange hashpartitioning")[1:]]
    assert 1 <= sum("content#" in m for m in moved) <= 2  # the documents, and the previous corpus


def test_bucketed_snapshot_is_not_shuffled(spark, tmp_path):
    from mdweave import session
    from mdweave.sources import resources
    name = session.scratch_table(spark)
    snapshot = spark.createDataFrame([(f"u{k}", True, "text/plain", "b") for k in range(50)], "url string, ok boolean, content_type string, body string")
    resources.write_bucketed_snapshot(snapshot, name, 4, str(tmp_path / "snapshot"))
    fetched = spark.createDataFrame([("s", "h", True, "u7")], "source_url string, href string, ok boolean, fetched_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = FE.fetch_bodies(fetched, spark.table(name))
        assert plan_of(df).count("Exchange") == 1 and df.first().body == "b"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_bodies_shuffle_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fetched = spark.createDataFrame([("s", "h", True, "u")], "source_url string, href string, ok boolean, fetched_url string")
        bodies = spark.createDataFrame([("u", True, "text/plain", "b")], "url string, ok boolean, content_type string, body string")
        p = plan_of(FE.fetch_bodies(fetched, bodies))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange") == 2 and p.count("Exchange hashpartitioning(fetched_url") == 2
