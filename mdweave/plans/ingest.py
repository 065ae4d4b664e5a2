"""The whole import dataflow for many sources in one job.

    index lines -> extract -> resolve -> dedupe -> host policy -> previous
    selection -> candidates + first success (snapshot) -> bodies of winners ->
    classify / convert -> output paths -> collision numbering -> prefix ->
    install plan vs previous snapshot -> per-source summary

Every step is a DataFrame transformation from ``operators``; stage outputs
read by several later steps are materialised (``session.materialize``).  What a caller
doesn't ask for is not built (``Tables``).  ``plans.incremental`` runs the same steps for what has changed.
Shuffles: dedupe (source, href), candidate probe (url), winner bodies (url),
collision numbering (source, root), plan (collection, source, path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import convert as CV
from ..operators import fetch as FE
from ..operators import links as L
from ..operators import paths as PA
from ..operators import sync as SY
from ..session import materialize

SRC = ["collection", "source_url"]
ENTRY = ["collection", "source_url", "href", "url", "line_pos", "match_pos", "title", "scheme", "host", "path", "query",
         "layout", "path_prefix", "local_root_dir"]
STATE = {  # the previous manifest and corpus, before the first run
    "installs": {"collection": "string", "pos": "int", "source_url": "string", "source_label": "string",
                 "layout": "string", "path_prefix": "string", "source": "string"},
    "managed_files": {"collection": "string", "pos": "int", "source_url": "string", "path": "string"},
    "selected_urls": {"collection": "string", "pos": "int", "source_url": "string", "url": "string", "ord": SY.ORD},
    "corpus": {"collection": "string", "path": "string", "content_sha": "string", "content": "string"}}


class Tables(dict):
    """Named DataFrames; those in ``later`` are built when they are first asked for."""

    def __init__(self, now: dict, later: dict):
        super().__init__(now)
        self.later = later

    def __missing__(self, name: str):
        self.update(self.later[name]())
        return self[name]


def state_of(spark, **given) -> dict:
    """The tables of ``STATE``, empty where none is given."""
    def empty(columns):
        return spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in columns.items()))
    return {k: given[k] if given.get(k) is not None else empty(c) for k, c in STATE.items()}


def _with_root(sources: DataFrame) -> DataFrame:
    return sources if "local_root_dir" in sources.columns else sources.withColumn("local_root_dir", F.lit(None).cast("string"))


def entries_of(index_lines: DataFrame, sources: DataFrame, state: dict, chosen: DataFrame | None = None):
    """The unique links of each source with ``allowed``, and those of them to fetch (both written)."""
    unique = L.dedupe_links(L.valid_links(L.resolve_links(L.extract_links(index_lines))))
    opts = sources.select("source_url", "collection", "layout", "path_prefix", "allow_external", "local_root_dir")
    policy = materialize(L.apply_host_policy(unique.join(opts, "source_url", "inner"), "allow_external"))
    entries = policy.filter("allowed").withColumn("url", F.col("href"))
    selected = (SY.select_explicit(entries, chosen) if chosen is not None
                else SY.select_previous(entries, state["installs"], state["selected_urls"]))
    return policy, materialize(selected.select(*ENTRY))


def documents_of(entries: DataFrame, resources: DataFrame) -> DataFrame:
    """Each entry with what became of it: ok, reason, fetched_url, content, content_sha (written).
    The bodies of the winners are joined once; entries without one take part with a key of their own."""
    fetched = FE.first_success(entries, resources).withColumnsRenamed({"url": "entry_url", "ok": "fetched_ok", "reason": "fetch_reason"})
    bodies = FE.fetch_bodies(fetched, resources, entries_without=True).withColumnRenamed("fetched_url", "url")
    out = CV.to_markdown(bodies, url="url").withColumnsRenamed({"url": "fetched_url", "entry_url": "url"})
    return materialize(out.withColumn("reason", F.when(F.col("fetched_ok"), F.col("reason")).otherwise(F.col("fetch_reason")))
                       .withColumn("ok", F.col("ok") & F.col("fetched_ok")).drop("fetched_ok", "fetch_reason"))


def results_of(documents: DataFrame, sources: DataFrame, state: dict) -> DataFrame:
    """One row per entry with its place (written): W1 within the source, W2 prefixes, P10."""
    narrow = documents.filter("ok").drop("content")  # names need no contents
    tree = narrow.filter(F.col("layout") != "flat")
    nested = (PA.add_remote_paths(tree.filter(F.col("local_root_dir").isNull()))
              .unionByName(PA.add_local_paths(tree.filter(F.col("local_root_dir").isNotNull()))))
    flat = PA.add_flat_paths(narrow.filter(F.col("layout") == "flat"))
    named = nested.unionByName(flat).select(*SRC, "url", "line_pos", "match_pos", "path_prefix", "content_sha", "rel_path")
    # W1 is independent of the prefix: number first, then assign prefixes
    numbered = PA.unique_paths(materialize(named), SRC, path="rel_path", out="doc_path")
    # (a one-row probe of the small sources table decides whether W2 runs)
    if not sources.filter(F.col("path_prefix").isNull()).isEmpty():
        numbered = materialize(numbered)
        prefixes = _prefixes(sources, state["installs"], state["corpus"], numbered)
        numbered = numbered.drop("path_prefix").join(prefixes, SRC, "left")
    docs = numbered.withColumn("path", PA.with_prefix("doc_path", "path_prefix"))
    failed = documents.filter(~F.col("ok")).select(*SRC, "url", "line_pos", "match_pos", "reason")
    return materialize(
        docs.select(*SRC, "url", "line_pos", "match_pos", F.lit(True).alias("ok"), "path", "content_sha",
                    F.lit(None).cast("string").alias("reason"), "path_prefix")
        .unionByName(failed.withColumn("ok", F.lit(False)), allowMissingColumns=True))


def finish(results: DataFrame, sources: DataFrame, selected: DataFrame, state: dict) -> Tables:
    """Plan and summary (written) against the previous state; the manifest tables follow when asked for."""
    narrow = results.drop("path_prefix")
    plan = materialize(SY.install_plan(narrow, state["installs"], state["managed_files"], state["corpus"]))
    summary = materialize(SY.plan_summary(plan, narrow, state["installs"]))

    def manifest():
        seq = (F.col("seq") if "seq" in sources.columns else F.xxhash64("source_url")).cast("long")
        label = (F.col("source_label") if "source_label" in sources.columns else F.col("source_url"))
        given = results.filter("ok").groupBy(*SRC).agg(F.first("path_prefix", ignorenulls=True).alias("__prefix"))
        runs = (sources.join(given, SRC, "left")
                .select(*SRC, label.alias("source_label"), "layout",
                        F.coalesce("path_prefix", "__prefix", F.lit("")).alias("path_prefix"), seq.alias("seq")))
        tables = SY.upsert_manifest(state["installs"], state["managed_files"], state["selected_urls"], narrow, selected, summary, runs)
        return dict(zip(("installs", "managed_files", "selected_urls"), tables))

    return Tables({"plan": plan, "summary": summary}, dict.fromkeys(("installs", "managed_files", "selected_urls"), manifest))


def ingest(index_lines: DataFrame, sources: DataFrame, resources: DataFrame,
           installs: DataFrame | None = None, managed_files: DataFrame | None = None,
           selected_urls: DataFrame | None = None, corpus: DataFrame | None = None,
           chosen: DataFrame | None = None) -> Tables:
    """Run the import for every source of ``sources``.

    index_lines (source_url, line_pos, line)
    sources     (collection, source_url, layout, path_prefix, allow_external[, slug, seq]);
                a NULL path_prefix is assigned by W2 (see ``_prefixes``); with a
                ``local_root_dir``, documents get their path below it (P8)
    resources   crawl snapshot (see operators.fetch)
    installs / managed_files / selected_urls / corpus: previous snapshot
    (see operators.sync); omitted = first install.
    chosen      explicit selection (collection, source_url, url), instead of the previous one
    Returns the named intermediate and final DataFrames.
    """
    state = state_of(index_lines.sparkSession, installs=installs, managed_files=managed_files, selected_urls=selected_urls, corpus=corpus)
    sources = _with_root(sources)
    policy, selected = entries_of(index_lines, sources, state, chosen)
    documents = documents_of(selected, resources)
    results = results_of(documents, sources, state)
    out = finish(results, sources, selected, state)
    narrow = results.drop("path_prefix")

    def snapshot():
        # the snapshot holds the documents; their contents join the rows chosen by hash
        contents = documents.filter("ok").select(*SRC, "url", "content") if "content" in state["corpus"].columns else None
        return {"snapshot": SY.apply_plan(state["corpus"], narrow, out["plan"], out["summary"], contents)}

    out.later |= {
        "snapshot": snapshot,
        "stats": lambda: {"stats": L.link_stats(None, policy, selected, SRC)},
        "resolved": lambda: {"resolved": L.resolve_links(L.extract_links(index_lines))},
        "source_failures": lambda: {"source_failures": source_failures(sources, index_lines, None, policy)},
        "path_clashes": lambda: {"path_clashes": SY.path_clashes(narrow)}}
    out.update(sources=sources.select(*SRC), policy=policy, selected=selected, outcomes=documents, results=narrow,
               docs=results.filter("ok").drop("ok", "reason"), failures=narrow.filter(~F.col("ok")).select(*SRC, "url", "line_pos", "match_pos", "reason"))
    return out


def _prefixes(sources: DataFrame, installs: DataFrame, corpus: DataFrame, numbered: DataFrame) -> DataFrame:
    """Path prefix per source (W2): a prefix given in ``sources`` is used as is;
    sources without one get the stored prefix, '' as the first install of an
    empty collection, or their default prefix numbered past every stored
    prefix and every existing top-level entry (file or directory) -- the corpus
    inventory plus the first path segments that unprefixed sources write in
    this run."""
    from ..functions.urls import parse_urls

    given = sources.filter(F.col("path_prefix").isNotNull()).select(*SRC, "path_prefix")
    todo = sources.filter(F.col("path_prefix").isNull())
    # batch order of new sources: the caller's ``seq`` (e.g. registry order), else a stable hash
    seq = F.col("seq").cast("long") if "seq" in sources.columns else F.xxhash64("source_url")
    parsed = parse_urls(todo.withColumn("__seq", seq), "source_url", "__p")
    cand = parsed.select(*SRC, F.col("__seq").alias("seq"),
                         (F.col("slug") if "slug" in sources.columns else F.lit(None).cast("string")).alias("slug"),
                         F.col("__p.scheme").alias("scheme"), F.col("__p.host").alias("host"),
                         F.col("__p.path").alias("path"))
    top = corpus.select("collection", F.regexp_extract("path", r"^([^/]+)", 1).alias("name"))
    # first the prefixes that need no look at names; the sources that get '' write top-level entries too
    early = PA.early_prefixes(cand, installs).select(*SRC, "path_prefix")
    unprefixed = (numbered.join(given.unionByName(early).filter(F.col("path_prefix") == ""), SRC, "left_semi")
                  .select("collection", F.regexp_extract("doc_path", r"^([^/]+)", 1).alias("name")))
    top_level = top.unionByName(unprefixed).filter(F.col("name") != "").distinct()
    assigned = PA.assign_prefixes(cand, installs.select("collection", "pos", "source_url", "path_prefix"),
                                  top_level).select(*SRC, "path_prefix")
    return given.unionByName(assigned)


def source_failures(sources: DataFrame, index_lines: DataFrame, resolved: DataFrame | None, policy: DataFrame) -> DataFrame:
    """Sources that give no document to fetch: (collection, source_url, reason).  Links are those of
    ``resolved``, or without it those of ``policy``, which has each of a source's links once."""
    has_lines = index_lines.select("source_url").distinct().withColumn("__lines", F.lit(True))
    links = policy if resolved is None else resolved.filter(F.col("status") == "ok")
    has_links = links.select("source_url").distinct().withColumn("__links", F.lit(True))
    has_docs = policy.filter("allowed").select(*SRC).distinct().withColumn("__docs", F.lit(True))
    reason = (F.when(F.col("__lines").isNull(), F.lit("no index"))
              .when(F.col("__links").isNull(), F.lit("no links in the index"))
              .when(F.col("__docs").isNull(), F.lit("no link is allowed")))
    return (sources.select(*SRC).join(has_lines, "source_url", "left").join(has_links, "source_url", "left")
            .join(has_docs, SRC, "left").select(*SRC, reason.alias("reason")).filter("reason IS NOT NULL"))


def ingest_summary(out: dict) -> DataFrame:
    """One row per source, those that failed as a whole included: link
    statistics, fetch results and change counts."""
    counts = ["successes", "failures", "added", "changed", "removed", "unchanged", "total_changes"]
    links = ["links_found", "unique_urls", "selected_docs", "blocked_docs", "blocked_hosts"]
    s = out["summary"].select(*SRC, *counts, "same_source", "up_to_date", "run_status")
    st = out["stats"].select(*SRC, *links)
    f = out["source_failures"].select(*SRC, F.col("reason").alias("source_failure"))
    return (out["sources"].join(s, SRC, "left").join(st, SRC, "left").join(f, SRC, "left").fillna(0, counts + links)
            .fillna(False, ["same_source", "up_to_date"])
            .withColumn("run_status", F.coalesce("run_status", F.lit("failed"))))
