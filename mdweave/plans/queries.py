"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Column names and types match the oracle SQL in ``plans/oracle.py``.  No array,
timestamp-now or float columns appear in outputs (arrays are joined).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import guess_local_content_type, is_private_hostname, parse_urls
from ..operators import convert as CV
from ..operators import fetch as FE
from ..operators import paths as PA
from ..operators import review as RV
from ..operators import sync as SY
from ..operators import links as L
from ..session import materialize, scratch_folder
from ..sources import link_index as LI
from ..sources import log as LG
from ..sources import manifest as MF
from ..sources import manifest_file as MW
from ..sources import sinks as SK
from ..sources import tree as TR
from . import incremental as IC
from . import ingest as IN
from . import views as V


# --- link pipeline ------------------------------------------------------------

def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    v1 = L.split_index_lines(V.anchor_index(spark, sf_dir))
    v2 = V.host_index_lines(spark, sf_dir)
    return v1.unionByName(v2)


def _resolved(spark, sf_dir) -> DataFrame:
    return L.resolve_links(L.extract_links(_all_lines(spark, sf_dir)))


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract_links(_all_lines(spark, sf_dir)).select(
        "source_url", "line_pos", "match_pos", "title", "raw_href", "href_in")


def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.valid_links(_resolved(spark, sf_dir)).select(
        "source_url", "line_pos", "match_pos", "title", "href", "scheme", "host", "path", "query")


def link_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_rejects(_resolved(spark, sf_dir)).select(
        "source_url", "line_pos", "match_pos", "status", "href")


def _unique(spark, sf_dir) -> DataFrame:
    return L.dedupe_links(L.valid_links(_resolved(spark, sf_dir)))


def dedupe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select("source_url", "href", "line_pos", "match_pos", "title", "occurrences")


def host_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.apply_host_policy(_unique(spark, sf_dir)).select(
        "source_url", "href", "line_pos", "match_pos", "host", "allowed")


def link_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = materialize(_resolved(spark, sf_dir))  # read twice below
    policy = L.apply_host_policy(L.dedupe_links(L.valid_links(resolved)))
    return L.link_stats(resolved, policy).select(
        "source_url", "links_found", "unique_urls", "selected_docs", "blocked_docs", "blocked_hosts")


def blocked_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blocked_hosts(L.apply_host_policy(_unique(spark, sf_dir))).select("source_url", "host", "blocked_links")


# --- candidates and first success ------------------------------------------------

def _site_selected(spark, sf_dir) -> DataFrame:
    """Allowed unique links of the site indexes (V2): the entries to fetch."""
    lines = V.host_index_lines(spark, sf_dir)
    uniq = L.dedupe_links(L.valid_links(L.resolve_links(L.extract_links(lines))))
    return (L.apply_host_policy(uniq).filter("allowed")
            .select("source_url", "href", "line_pos", "match_pos", "title", "path", "query"))


def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.expand_candidates(_site_selected(spark, sf_dir)).select(
        "source_url", "href", "rank", "candidate_url")


def _fetched(spark, sf_dir) -> DataFrame:
    return FE.first_success(_site_selected(spark, sf_dir), V.crawl_resources(spark, sf_dir))


def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fetched(spark, sf_dir).select(
        "source_url", "href", "line_pos", "match_pos", "ok", "fetched_url", "via", "rank")


def fetch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = materialize(_fetched(spark, sf_dir).filter(~F.col("ok")))  # read twice by the preview
    return FE.failure_preview(failed).select(
        "source_url", "href", "line_pos", "match_pos", "reason", "failure_rank", "failed_total", "more")


# --- content -----------------------------------------------------------------------

def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CV.classify(V.fetched_resources(spark, sf_dir)).select("url", "kind")


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 native branch: every non-html row (markdown, empty, unsupported)."""
    c = CV.classify(V.fetched_resources(spark, sf_dir)).filter(F.col("kind") != "html")
    out = CV.convert_markdown_rows(c)
    ok = F.col("content").isNotNull()
    return out.select("url", "kind", ok.alias("ok"),
                      F.sha2("content", 256).alias("content_sha"),
                      F.when(~ok, F.concat(F.lit("unsupported content received from "), F.col("url"))).alias("reason"))


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 html branch (rows-only oracle; golden unit tests pin the dialect)."""
    c = CV.classify(V.fetched_resources(spark, sf_dir)).filter(F.col("kind") == "html")
    out = CV.convert_html_rows(c)
    return out.select("url", F.col("content").isNotNull().alias("ok"),
                      F.sha2("content", 256).alias("content_sha"),
                      F.length("content").cast("long").alias("content_chars"))


def _shown(content: str) -> F.Column:
    """Letters and digits of Markdown, without link targets, list numbers and fence languages."""
    text = F.coalesce(F.col(content), F.lit(""))
    for mark in (r"\]\([^)]*\)", r"(?m)^ *[0-9]+\. ", r"(?m)^ *```.*$", r"[^\p{L}\p{N}]"):
        text = F.regexp_replace(text, mark, "")
    return text


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the conversion keeps of the text of every html row."""
    c = CV.classify(V.fetched_resources(spark, sf_dir)).filter(F.col("kind") == "html")
    out = CV.convert_html_rows(c).select("url", _shown("content").alias("t"))
    return out.select("url", F.sha2("t", 256).alias("text_sha"), F.length("t").cast("long").alias("text_chars"))


# --- paths ---------------------------------------------------------------------------

def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PA.add_remote_paths(V.crawl_entries(spark, sf_dir)).select("source_url", "href", "rel_path")


def flat_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PA.add_flat_paths(V.crawl_entries(spark, sf_dir)).select("source_url", "href", "rel_path")


def local_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PA.add_local_paths(V.local_mirror_entries(spark, sf_dir)).select(
        "file_url", "title", "local_root_dir", "rel_path")


def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the numbering reads its input twice (group statistics, rows)
    nested = materialize(PA.add_remote_paths(V.crawl_entries(spark, sf_dir)).drop("path"))
    return PA.unique_paths(nested, ["source_url"]).select(
        "source_url", "href", "line_pos", "match_pos", "rel_path", "path")


def unique_paths_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on names that collide with naturally numbered ones: every crawl entry
    is named ``<lang>.md`` or ``<lang>-<n>.md`` (n from its page number), so
    groups mix duplicates with numbered names and take the greedy branch."""
    e = V.crawl_entries(spark, sf_dir)
    lang = F.regexp_extract("path", r"^/([^/]+)/", 1)
    num = F.regexp_extract("path", r"([0-9]+)", 1).cast("long")
    name = F.when(num % 3 == 0, F.concat(lang, F.lit(".md"))) \
        .otherwise(F.concat(lang, F.lit("-"), (num % 4).cast("string"), F.lit(".md")))
    named = materialize(e.withColumn("rel_path", name).drop("path"))
    return PA.unique_paths(named, ["source_url"]).select(
        "source_url", "href", "line_pos", "match_pos", "rel_path", "path")


def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.site_sources(spark, sf_dir)
    return PA.assign_prefixes(d["sources"], d["installs"], d["top_level"]).select(
        "collection", "source_url", "seq", "path_prefix")


def prefixed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: the path of every crawled page below the prefix of its host."""
    d = V.site_sources(spark, sf_dir)
    prefixes = PA.assign_prefixes(d["sources"], d["installs"], d["top_level"]).select("source_url", "path_prefix")
    docs = PA.add_remote_paths(V.crawl_entries(spark, sf_dir)).select(
        F.concat(F.lit("https://"), F.regexp_replace("host", ":[0-9]+$", ""), F.lit("/llms.txt")).alias("source_url"),
        "href", "rel_path")
    return docs.join(prefixes, "source_url", "left").select(
        "source_url", "href", PA.with_prefix("rel_path", "path_prefix").alias("path"))


# --- sync --------------------------------------------------------------------------

def _sync(spark, sf_dir):
    d = V.sync_inputs(spark, sf_dir)
    d["selected"] = SY.select_previous(d["entries"], d["installs"], d["selected_urls"])
    d["fetched"] = materialize(V.fetch_selected(d["selected"]))
    d["plan"] = materialize(SY.install_plan(d["fetched"], d["installs"], d["managed_files"], d["corpus"]))
    return d


def previous_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.sync_inputs(spark, sf_dir)
    return SY.select_previous(d["entries"], d["installs"], d["selected_urls"]).select(
        "collection", "source_url", "url", "line_pos", "selection")


def explicit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interactive choice as a URL table: the English documents."""
    d = V.sync_inputs(spark, sf_dir)
    chosen = d["entries"].filter(F.col("url").contains(".example.org/en/")).select("collection", "source_url", "url")
    return SY.select_explicit(d["entries"], chosen).select("collection", "source_url", "url", "line_pos")


def install_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sync(spark, sf_dir)["plan"].select("collection", "source_url", "path", "change")


def _summary(d):
    return SY.plan_summary(d["plan"], d["fetched"], d["installs"])


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_sync(spark, sf_dir)).select(
        "collection", "source_url", "successes", "failures", "same_source", "added", "changed", "removed",
        "unchanged", "total_changes", "up_to_date", "removals_paused", "run_status")


def plan_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SY.plan_preview(_sync(spark, sf_dir)["plan"]).select(
        "collection", "source_url", "change", "path", "rank", "total", "more")


def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _sync(spark, sf_dir)
    return SY.apply_plan(d["corpus"], d["fetched"], d["plan"], _summary(d)).select(
        "collection", "path", "content_sha")


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installs after the upsert, repeated and nameless ones too, with their managed-file and
    selected-URL lists summarised (count, first and last path; count of URLs)."""
    d = _sync(spark, sf_dir)
    inst, managed, sel = SY.upsert_manifest(d["installs"], d["managed_files"], d["selected_urls"],
                                            d["fetched"], d["selected"], _summary(d), d["run_sources"])
    m = managed.groupBy("collection", "pos").agg(
        F.count(F.lit(1)).alias("n_managed"), F.min("path").alias("first_managed"),
        F.max("path").alias("last_managed"))
    u = sel.groupBy("collection", "pos").agg(F.count(F.lit(1)).alias("n_selected"))
    return (inst.join(m, ["collection", "pos"], "left").join(u, ["collection", "pos"], "left")
            .fillna(0, ["n_managed", "n_selected"])
            .select("collection", "pos", "source_url", "source_label", "layout", "path_prefix", "source",
                    "n_managed", "first_managed", "last_managed", "n_selected"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest after the upsert as JSON files, read back: installs by their place in the file, with the
    numbers of entries in their lists."""
    d = _sync(spark, sf_dir)
    tables = SY.upsert_manifest(d["installs"], d["managed_files"], d["selected_urls"], d["fetched"], d["selected"], _summary(d), d["run_sources"])
    tables = {k: materialize(t) for k, t in zip(SK.MANIFEST_TABLES, tables)}
    root = scratch_folder(spark, "manifests")
    MW.write_manifest_files(tables, tables["installs"].select("collection"), root, "manifest.json", "2030-01-01T00:00:00.000Z")
    texts = spark.read.text(f"{root}/*/manifest.json", wholetext=True).select(
        F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("collection"), F.col("value").alias("text"))
    back = MF.manifest_tables(texts)
    counts = [back[t].groupBy("collection", "pos").agg(F.count(F.lit(1)).alias(n)) for t, n in (("managed_files", "n_managed"), ("selected_urls", "n_selected"))]
    out = back["installs"].join(counts[0], ["collection", "pos"], "left").join(counts[1], ["collection", "pos"], "left")
    return out.fillna(0, ["n_managed", "n_selected"]).select("collection", "pos", "source_url", "source_label", "path_prefix", "source", "n_managed", "n_selected")


def manifest_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the selected URLs after the upsert, each with its place in the list."""
    d = _sync(spark, sf_dir)
    selected = SY.upsert_manifest(d["installs"], d["managed_files"], d["selected_urls"],
                                  d["fetched"], d["selected"], _summary(d), d["run_sources"])[2]
    return selected.select("collection", "pos", "source_url", "url", "ord.line_pos", "ord.match_pos")


def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The installs of manifest files of both versions, normalised."""
    return SY.normalised(MF.manifest_tables(V.manifest_texts(spark, sf_dir))["installs"])


def manifest_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct managed files and selected URLs of manifest files."""
    t = MF.manifest_tables(V.manifest_texts(spark, sf_dir))
    managed = t["managed_files"].select("collection", "pos", "source_url", F.lit("managed").alias("list"),
                                        F.col("path").alias("value"), F.lit(0).cast("long").alias("ord"))
    chosen = t["selected_urls"].select("collection", "pos", "source_url", F.lit("selected").alias("list"),
                                       F.col("url").alias("value"), F.col("ord.line_pos").alias("ord"))
    return managed.unionByName(chosen).groupBy("collection", "pos", "source_url", "list", "value").agg(F.min("ord").alias("ord"))


# --- registry ----------------------------------------------------------------------

def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 rows with the S2 validity flag (strict rows = valid, rejects = not)."""
    return RV.scan_registry(V.registry_lines(spark, sf_dir)).select("line_no", "slug", "label", "url", "valid")


def registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every strict registry row in label order (no task holds all rows)."""
    reg = RV.strict_registry(V.registry_lines(spark, sf_dir)).select("line_no", "label")
    return PA.positions(reg, RV.label_order()).select("line_no", "label", "position")


def parsed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a URL makes of its host; null where that makes the URL invalid."""
    urls = V.host_forms(spark, sf_dir).withColumn("url", F.concat(F.lit("https://"), "host", F.lit("/")))
    return parse_urls(urls, "url", "u").select("page_id", "form", "host", F.when(F.col("u.status") == "ok", F.col("u.host")).alias("parsed"))


def private_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.private_host_names(spark, sf_dir).select("page_id", "form", "host", is_private_hostname("host").alias("private"))


def local_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.local_files(spark, sf_dir).select("page_id", "path", guess_local_content_type("path").alias("content_type"))


def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = RV.strict_registry(V.registry_lines(spark, sf_dir))
    return RV.resolve_sources(V.source_inputs(spark, sf_dir), reg, "/work/project").select(
        "input_id", "input", "kind", "slug", "label", "url", "local_root_dir")


def registry_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = RV.scan_registry(V.registry_lines(spark, sf_dir))
    return RV.duplicate_flags(reg).select("line_no", "slug", "url", "duplicate_slug", "duplicate_url")


def registry_static_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = RV.scan_registry(V.registry_lines(spark, sf_dir))
    return RV.static_review(reg).select(
        "line_no", "slug", F.array_join("issues", " ").alias("issues"),
        F.array_join("warnings", " ").alias("warnings"))


def _reviewed(spark, sf_dir):
    reg = RV.scan_registry(V.registry_lines(spark, sf_dir))
    return RV.review(reg, V.crawl_resources(spark, sf_dir))


def registry_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select(
        "line_no", "slug", "url", "final_url", "status_code", "content_type", "content_length",
        F.array_join("issues", " ").alias("issues"), F.array_join("warnings", " ").alias("warnings"),
        F.array_join("notes", " ").alias("notes"), "verdict")


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RV.verdict_counts(_reviewed(spark, sf_dir))


def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the report reads the reviewed rows three times (counts, rows, URLs)
    return RV.report_lines(materialize(_reviewed(spark, sf_dir))).select("section", "ord", "sub", "line")


# --- flagship ------------------------------------------------------------------------

def _site_sources(lines: DataFrame) -> DataFrame:
    return (lines.select("source_url").distinct()
            .select(F.concat(F.lit("site:"), F.regexp_extract("source_url", r"://([^/]+)/", 1)).alias("collection"),
                    "source_url", F.lit("nested").alias("layout"), F.lit("").alias("path_prefix"),
                    F.lit(False).alias("allow_external")))


def _ingest(spark, sf_dir) -> dict:
    """Whole DAG over the site indexes (V2) and the crawl snapshot (V3)."""
    lines = V.host_index_lines(spark, sf_dir)
    return IN.ingest(lines, _site_sources(lines), V.crawl_resources(spark, sf_dir))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source of the whole import."""
    return IN.ingest_summary(_ingest(spark, sf_dir))


def corpus_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the import stores: path, and a hash of the text in the stored content."""
    out = _ingest(spark, sf_dir)["snapshot"].select("collection", "path", _shown("content").alias("t"))
    return out.select("collection", "path", F.sha2("t", 256).alias("text_sha"))


def source_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that give nothing to fetch, among the sites and the document sources (which have no index)."""
    lines = V.host_index_lines(spark, sf_dir)
    listed = V.doc_resources(spark, sf_dir).select(F.concat(F.regexp_extract("url", "^https://[^/]+", 0), F.lit("/llms.txt")).alias("source_url"))
    sources = _site_sources(lines.select("source_url").unionByName(listed))
    resolved = materialize(L.resolve_links(L.extract_links(lines)))
    policy = L.apply_host_policy(L.dedupe_links(L.valid_links(resolved)).join(sources, "source_url"), "allow_external")
    return IN.source_failures(sources, lines, resolved, policy)


def corpus_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus that several runs leave in a log, each of which writes its changes only, with a
    compaction after each: path, hash of the content, and the run that wrote it."""
    root, key = scratch_folder(spark, "log"), ["collection", "path"]
    for run in range(1, V.LOG_RUNS + 1):
        before = LG.read(spark, root, key)
        LG.append(LG.changes(None if before is None else before.drop("seq"), V.corpus_at(spark, sf_dir, run), key), root, key)
        LG.compact(spark, root, key, fan=3)
    return LG.read(spark, root, key).select("collection", "path", "content_sha", "seq")


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that two runs leave, the second of which writes its changes only: path, hash of the file."""
    root, key = scratch_folder(spark, "tree"), ["collection", "path"]
    first, second = V.corpus_at(spark, sf_dir, 1), V.corpus_at(spark, sf_dir, 2)
    TR.write_tree(LG.changes(None, first, key), root)
    TR.write_tree(LG.changes(first, second, key), root)
    return TR.read_tree(spark, root).select("collection", "path", F.sha2("content", 256).alias("content_sha"))


def index_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the site indexes, written as a file each and read in byte ranges."""
    folder = scratch_folder(spark, "indexes")
    site = F.regexp_extract("source_url", "//([^/]+)/", 1)
    (V.host_index_lines(spark, sf_dir).withColumn("site", site).repartition("site").sortWithinPartitions("site", "line_pos")
     .select("site", "line").write.partitionBy("site").text(folder))
    lines = LI.read_index_lines(spark, folder)
    return lines.select(F.regexp_extract("source_url", "site=([^/]+)/", 1).alias("site"), "line_pos", "line")


def changed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after a second crawl, from the first import and what has changed since: path, and a hash of the text."""
    lines, resources = V.host_index_lines(spark, sf_dir), V.crawl_resources(spark, sf_dir)
    later = V.later_pages(spark, sf_dir)
    new_lines, new_resources = V.host_index_lines(spark, sf_dir, later), V.crawl_resources(spark, sf_dir, later)
    sources = _site_sources(lines)
    first = IN.ingest(lines, sources, resources)
    corpus = materialize(first["snapshot"])
    second = IC.ingest_changes({**first, "sources": sources}, new_lines, sources, new_resources, IC.changed_sources(lines, new_lines),
                               IC.changed_urls(resources, new_resources), *(materialize(first[k]) for k in SK.MANIFEST_TABLES), corpus)
    delta = materialize(second["delta"])
    out = (corpus.join(delta.select("collection", "path"), ["collection", "path"], "left_anti")
           .unionByName(delta.filter("NOT deleted").drop("deleted")))
    return out.select("collection", "path", F.sha2(_shown("content"), 256).alias("text_sha"))


QUERIES = {
    "document_tree": document_tree,
    "index_file_lines": index_file_lines,
    "corpus_log": corpus_log,
    "changed_import": changed_import,
    "extract_links": extract_links,
    "resolve_links": resolve_links,
    "link_rejects": link_rejects,
    "dedupe_links": dedupe_links,
    "host_policy": host_policy,
    "link_stats": link_stats,
    "blocked_hosts": blocked_hosts,
    "candidate_urls": candidate_urls,
    "first_success": first_success,
    "fetch_failures": fetch_failures,
    "classify_content": classify_content,
    "markdown_docs": markdown_docs,
    "html_to_markdown": html_to_markdown,
    "html_text": html_text,
    "nested_paths": nested_paths,
    "local_paths": local_paths,
    "flat_paths": flat_paths,
    "unique_paths": unique_paths,
    "unique_paths_greedy": unique_paths_greedy,
    "path_prefixes": path_prefixes,
    "prefixed_paths": prefixed_paths,
    "previous_selection": previous_selection,
    "explicit_selection": explicit_selection,
    "install_plan": install_plan,
    "plan_summary": plan_summary,
    "plan_preview": plan_preview,
    "apply_plan": apply_plan,
    "manifest_upsert": manifest_upsert,
    "manifest_files": manifest_files,
    "manifest_selection": manifest_selection,
    "manifest_scan": manifest_scan,
    "manifest_lists": manifest_lists,
    "registry_scan": registry_scan,
    "registry_order": registry_order,
    "parsed_hosts": parsed_hosts,
    "private_hosts": private_hosts,
    "local_content_types": local_content_types,
    "source_resolution": source_resolution,
    "registry_duplicates": registry_duplicates,
    "registry_static_review": registry_static_review,
    "registry_review": registry_review,
    "verdict_counts": verdict_counts,
    "review_report": review_report,
    "ingest_summary": ingest_summary,
    "corpus_snapshot": corpus_snapshot,
    "source_failures": source_failures,
}
FLAGSHIP = ingest_summary
