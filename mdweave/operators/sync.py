"""Snapshot sync: selection (J3, J4), install plan (J5, J6), summaries (A4, A5,
A11), previews (T2-T4), apply (S6) and manifest upsert (U1-U4, A9, A10).

Manifest data model (long form, so that no install's file list is ever one
array row or one task):

installs       (collection, pos, source_url, source_label, layout, path_prefix, source)
managed_files  (collection, pos, source_url, path)
selected_urls  (collection, pos, source_url, url, ord STRUCT<line_pos, match_pos>)

An install is ``(collection, pos)``, its place in the manifest, also in its lists: a source may have
several installs, and an install needs no source URL.  ``source`` is its source record as JSON text, with
fields that nothing here reads.

A run of many sources is described by

entries  (collection, source_url, url, line_pos, match_pos, ...)   before selection
fetched  (collection, source_url, url, line_pos, match_pos, ok, path, content_sha, reason)
corpus   (collection, path, content_sha)                           previous snapshot

Documents are compared by ``content_sha``; contents enter one join, with the rows that are written.
Everything is keyed by ``(collection, source_url[, path])``; per-source facts
(same source, failure count) are small aggregates joined back on the source key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SRC = ["collection", "source_url"]
INSTALL = ["collection", "pos"]
ORD = "struct<line_pos:bigint,match_pos:int>"


def same_source(installs: DataFrame) -> DataFrame:
    """J3 (a W3 first-wins pick): the first install per (collection, source_url)
    in manifest order."""
    rest = [c for c in installs.columns if c not in SRC]
    # an install without a source URL is never the install of a source
    return (installs.filter(F.col("source_url").isNotNull()).groupBy(*SRC)
            .agg(F.min_by(F.struct(*rest), "pos").alias("__i")).select(*SRC, "__i.*").select(*installs.columns))


def first_documents(fetched: DataFrame) -> DataFrame:
    """The document that is written at each (collection, path): the first by source
    and link order.  The others are the rows of ``path_clashes``."""
    order = F.struct("source_url", "line_pos", "match_pos", "url", "content_sha")
    return (fetched.filter("ok").groupBy("collection", "path").agg(F.min(order).alias("__d"))
            .select("collection", "path", "__d.source_url", "__d.url", "__d.content_sha"))


def path_clashes(fetched: DataFrame) -> DataFrame:
    """Documents that are not written because another one has their path:
    (collection, path, source_url, url, content_sha, written_source_url, written_url)."""
    docs = fetched.filter("ok").select("collection", "path", "source_url", "url", "content_sha")
    often = docs.groupBy("collection", "path").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    first = (first_documents(fetched).join(often, ["collection", "path"], "left_semi")
             .select("collection", "path", F.col("source_url").alias("written_source_url"), F.col("url").alias("written_url")))
    return (docs.join(first, ["collection", "path"])
            .filter((F.col("source_url") != F.col("written_source_url")) | (F.col("url") != F.col("written_url"))))


def select_previous(entries: DataFrame, installs: DataFrame, selected_urls: DataFrame) -> DataFrame:
    """J4 (non-interactive update): for a source installed before with a
    non-empty previous selection keep only the selected URLs; if that keeps
    nothing, keep all.  Adds ``selection`` = previous | all.

    Left join with the (small per source) selection, a per-source flag computed
    by aggregation, no window over a whole source.
    """
    prev = (selected_urls.join(same_source(installs).select(*INSTALL), INSTALL, "left_semi")
            .select(*SRC, "url").distinct().withColumn("__hit", F.lit(True)))
    marked = entries.join(prev, SRC + ["url"], "left")
    per_src = (marked.groupBy(*SRC)
               .agg(F.max(F.coalesce("__hit", F.lit(False))).alias("__any_hit")))
    has_prev = prev.select(*SRC).distinct().withColumn("__has_prev", F.lit(True))
    out = (marked.join(per_src, SRC, "left").join(has_prev, SRC, "left")
           .withColumn("__use_prev", F.coalesce("__has_prev", F.lit(False)) & F.col("__any_hit")))
    return (out.filter(~F.col("__use_prev") | F.coalesce("__hit", F.lit(False)))
            .withColumn("selection", F.when(F.col("__use_prev"), F.lit("previous")).otherwise(F.lit("all")))
            .drop("__hit", "__any_hit", "__has_prev", "__use_prev"))


def select_explicit(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """J4 explicit URL list (the interactive choice): plain semi-join, no fallback."""
    return entries.join(chosen.select(*SRC, "url").distinct(), SRC + ["url"], "left_semi")


def managed_paths(installs: DataFrame, managed_files: DataFrame) -> DataFrame:
    """(collection, source_url, path) of the files of each source's (first) install."""
    first = same_source(installs).select(*INSTALL)
    return managed_files.join(first, INSTALL, "left_semi").select(*SRC, "path").distinct()


def readable_managed(installs: DataFrame, managed_files: DataFrame, corpus: DataFrame) -> DataFrame:
    """Managed paths of the current install of each source that exist in the
    corpus: (collection, source_url, path, old_sha)."""
    return managed_paths(installs, managed_files).join(corpus.select("collection", "path", F.col("content_sha").alias("old_sha")),
                        ["collection", "path"], "inner")


def run_facts(fetched: DataFrame, installs: DataFrame) -> DataFrame:
    """A5 per source: successes, failures, same_source (installed before)."""
    counts = (fetched.groupBy(*SRC)
              .agg(F.count_if(F.col("ok")).alias("successes"), F.count_if(~F.col("ok")).alias("failures")))
    known = same_source(installs).select(*SRC).withColumn("same_source", F.lit(True))
    return (counts.join(known, SRC, "left")
            .withColumn("same_source", F.coalesce("same_source", F.lit(False))))


def install_plan(fetched: DataFrame, installs: DataFrame, managed_files: DataFrame,
                 corpus: DataFrame) -> DataFrame:
    """J5 + J6: (collection, source_url, path, change).

    added / changed / unchanged: next docs left-joined with the readable
    managed contents (hash compare).  removed (U2): managed paths of the same source
    absent from the next docs, only when the source had no failure (the gate is
    per source, never global) -- also when the file is already gone.
    """
    docs = (fetched.filter("ok").groupBy(*SRC, "path")
            .agg(F.min_by("content_sha", F.struct("line_pos", "match_pos", "url")).alias("content_sha")))
    readable = readable_managed(installs, managed_files, corpus)
    nxt = (docs.join(readable, SRC + ["path"], "left")
           .withColumn("change", F.when(F.col("old_sha").isNull(), F.lit("added"))
                       .when(F.col("old_sha") == F.col("content_sha"), F.lit("unchanged"))
                       .otherwise(F.lit("changed")))
           .select(*SRC, "path", "change"))
    facts = run_facts(fetched, installs)
    gate = facts.filter(F.col("same_source") & (F.col("failures") == 0)).select(*SRC)
    removed = (managed_paths(installs, managed_files).join(gate, SRC, "left_semi")
               .join(docs.select(*SRC, "path"), SRC + ["path"], "left_anti")
               .withColumn("change", F.lit("removed")))
    return nxt.unionByName(removed)


def plan_summary(plan: DataFrame, fetched: DataFrame, installs: DataFrame) -> DataFrame:
    """A4 + A5 + A11 per source."""
    counts = (plan.groupBy(*SRC).agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "changed").alias("changed"),
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if(F.col("change") == "unchanged").alias("unchanged")))
    facts = run_facts(fetched, installs)
    out = facts.join(counts, SRC, "left").fillna(0, ["added", "changed", "removed", "unchanged"])
    total = F.col("added") + F.col("changed") + F.col("removed")
    return (out.withColumn("total_changes", total)
            .withColumn("up_to_date", F.col("same_source") & (total == 0) & (F.col("failures") == 0))
            .withColumn("removals_paused", F.col("failures") > 0)
            .withColumn("run_status", F.when(F.col("successes") == 0, F.lit("failed")).otherwise(F.lit("ok"))))


def plan_preview(plan: DataFrame, k: int = 25) -> DataFrame:
    """T2 + T4: the first ``k`` paths (code-unit order) per source and change
    class, and how many more.  ``row_number() <= k`` gets a partial window-group
    limit before the shuffle."""
    keys = SRC + ["change"]
    w = Window.partitionBy(*keys).orderBy("path")
    top = plan.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    totals = plan.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return top.join(totals, keys, "inner").withColumn("more", F.greatest(F.col("total") - k, F.lit(0)))


def _written(fetched: DataFrame, summary: DataFrame) -> DataFrame:
    """The document at each path that the sources which are not up to date (A11) write, the first one where paths clash."""
    return first_documents(fetched.join(summary.filter(~F.col("up_to_date")).select(*SRC), SRC, "left_semi"))


def _removed(plan: DataFrame, summary: DataFrame) -> DataFrame:
    active = summary.filter(~F.col("up_to_date")).select(*SRC)
    return plan.filter(F.col("change") == "removed").join(active, SRC, "left_semi").select("collection", "path").distinct()


def _with_contents(written: DataFrame, contents: DataFrame | None) -> DataFrame:
    """``written`` (narrow) with the ``content`` of its documents; of one URL, one body.  The only join that carries contents."""
    columns = ["collection", "path", "content_sha"]
    if contents is None:
        return written.select(*columns)
    # an entry is one row of ``contents``, so nothing has to be dropped after the join
    return written.join(contents.select(*SRC, "url", "content"), [*SRC, "url"]).select(*columns, "content")


def apply_plan(corpus: DataFrame, fetched: DataFrame, plan: DataFrame, summary: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """Next snapshot = previous corpus without (written paths and removed
    paths) + every successful doc of the sources that are not up to date
    (the first one where paths clash, see ``path_clashes``).  With ``contents`` (collection,
    source_url, url, content; one row per entry) the snapshot has them; they are joined once, to the documents chosen on narrow rows."""
    written = _written(fetched, summary)
    gone = written.select("collection", "path").unionByName(_removed(plan, summary))
    columns = ["collection", "path", "content_sha"] + ["content"] * (contents is not None)
    kept = corpus.select(*columns).join(gone, ["collection", "path"], "left_anti")
    return kept.unionByName(_with_contents(written, contents))


def changed_documents(corpus: DataFrame, fetched: DataFrame, summary: DataFrame) -> DataFrame:
    """(collection, path, source_url, url, content_sha) of the documents that ``corpus`` doesn't have as they are."""
    there = corpus.select("collection", "path", F.col("content_sha").alias("__old"))
    return (_written(fetched, summary).join(there, ["collection", "path"], "left")
            .filter("__old IS NULL OR __old <> content_sha").drop("__old"))


def corpus_delta(corpus: DataFrame, fetched: DataFrame, plan: DataFrame, summary: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """S6 as changes for ``sources.log``: what ``apply_plan`` makes different from ``corpus``, (collection, path, content_sha[, content],
    deleted).  Documents are chosen and compared by hash; contents are joined to the rows that are written and to no other."""
    key = ["collection", "path"]
    removed = (_removed(plan, summary).join(_written(fetched, summary).select(*key), key, "left_anti")
               .join(corpus.select(*key), key, "left_semi").withColumn("deleted", F.lit(True)))
    changed = _with_contents(changed_documents(corpus, fetched, summary), contents)
    return changed.withColumn("deleted", F.lit(False)).unionByName(removed, allowMissingColumns=True)


def normalised(installs: DataFrame) -> DataFrame:
    """U4 on install rows: layout 'flat' or 'nested', prefix default '', source default {}."""
    layout = F.when(F.col("layout") == "flat", F.lit("flat")).otherwise(F.lit("nested"))
    return installs.select(*SRC, "pos", "source_label", layout.alias("layout"),
                           F.coalesce("path_prefix", F.lit("")).alias("path_prefix"), F.coalesce("source", F.lit("{}")).alias("source"))


def upsert_manifest(installs: DataFrame, managed_files: DataFrame, selected_urls: DataFrame,
                    fetched: DataFrame, selected: DataFrame, summary: DataFrame,
                    run_sources: DataFrame):
    """U1-U4 (U3 = the upsert itself), A9, A10 in long form.  Returns
    (installs, managed_files, selected_urls), which the next run takes as they are.

    * a source that ran (and is not up to date) replaces every install it has, in place
      (all get the run's lists), or is appended after the last position in ``seq`` order;
    * managed files: the run's paths, or with failures the distinct union with
      the list of the source's first install (U1);
    * selected URLs: all selected entries in entry order, failed ones included;
    * all other installs are kept, normalised (layout 'flat' or 'nested', prefix default '', distinct lists),
      each with its place and its own lists, repeated and nameless ones too.

    ``run_sources``: (collection, source_url, source_label, layout, path_prefix, seq).
    """
    from ..session import materialize
    from .paths import numbered_within

    active = summary.filter(~F.col("up_to_date")).select(*SRC, "failures")
    record = F.to_json(F.struct(F.col("source_label").alias("label"), F.col("source_url").alias("url")))
    # one row per source that ran: written, as nearly every step below reads it
    runs = materialize(run_sources.join(active, SRC, "inner").withColumn("source", record))
    kept = normalised(installs).join(runs.select(*SRC), SRC, "left_anti")
    replaced = runs.join(installs.select(*INSTALL, "source_url"), SRC, "inner")
    last = installs.groupBy("collection").agg(F.max("pos").alias("__last"))
    new = materialize(runs.join(installs.select(*SRC).distinct(), SRC, "left_anti"))
    appended = (numbered_within(new, ["collection"], ["seq", "source_url"], "__place").join(last, "collection", "left")
                .withColumn("pos", (F.coalesce("__last", F.lit(-1)) + F.col("__place")).cast("int")))
    cols = [*SRC, "pos", "source_label", "layout", "path_prefix", "source"]
    new_installs = kept.select(*cols).unionByName(replaced.select(*cols)).unionByName(appended.select(*cols))

    # the lists of a run go to every place of its source
    places = materialize(replaced.select(*SRC, "pos", "failures").unionByName(appended.select(*SRC, "pos", "failures")))
    run_paths = fetched.filter("ok").select(*SRC, "path").join(places.select(*SRC, "pos"), SRC)
    prev_paths = managed_paths(installs, managed_files).join(places.filter(F.col("failures") > 0).select(*SRC, "pos"), SRC)
    paths = [*INSTALL, "source_url", "path"]
    kept_places = kept.select(*INSTALL)
    new_managed = (run_paths.select(*paths).unionByName(prev_paths.select(*paths))
                   .unionByName(managed_files.join(kept_places, INSTALL, "left_semi").select(*paths)).distinct())

    urls = [*INSTALL, "source_url", "url"]
    run_sel = selected.select(*SRC, "url", F.struct(F.col("line_pos").cast("long").alias("line_pos"), F.col("match_pos").cast("int").alias("match_pos"))
                              .alias("ord")).join(places.select(*SRC, "pos"), SRC)
    new_sel = (run_sel.select(*urls, "ord").unionByName(selected_urls.join(kept_places, INSTALL, "left_semi").select(*urls, "ord"))
               .groupBy(*urls).agg(F.min("ord").alias("ord")))
    return new_installs, new_managed, new_sel
