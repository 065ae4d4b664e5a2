"""The import for what has changed since the last run: same steps, fewer rows.

Work follows two change sets: sources whose index lines or options changed, and URLs whose resource changed.
The links of a changed source are extracted anew; an entry is fetched and converted anew if its source changed or one of its candidates is
a changed URL; the names, the plan and the manifest of a source are made anew if one of its entries has another outcome.  The
others keep the rows of the last run.  The result is that of a full run on the same inputs, as long as the
corpus is as the last run left it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fetch as FE
from ..operators import sync as SY
from ..session import materialize
from . import ingest as IN

SRC = IN.SRC
OPTIONS = ["layout", "path_prefix", "allow_external", "local_root_dir"]


def _digests(df: DataFrame, key: list, columns: list) -> DataFrame:
    """Two sums of 64-bit hashes and the number of the rows of each key, whatever their order."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.sum(one.cast("decimal(38,0)")).alias("__a"), F.sum(two.cast("decimal(38,0)")).alias("__b"))


def changed_keys(old: DataFrame, new: DataFrame, key: list, columns: list) -> DataFrame:
    """Keys whose rows differ between ``old`` and ``new``, keys of one of them included.  (For tables that are kept as a log,
    ``sources.log.since`` gives them without reading the rest.)"""
    names = {c: f"__old{c}" for c in ("__n", "__a", "__b")}
    both = _digests(new, key, columns).join(_digests(old, key, columns).withColumnsRenamed(names), key, "full")
    same = F.lit(True)
    for c, o in names.items():
        same = same & F.col(c).eqNullSafe(F.col(o))
    return both.filter(~same).select(*key)


def changed_sources(old_lines: DataFrame, new_lines: DataFrame) -> DataFrame:
    return changed_keys(old_lines, new_lines, ["source_url"], ["line_pos", "line"])


def changed_urls(old: DataFrame, new: DataFrame) -> DataFrame:
    return changed_keys(old, new, ["url"], ["ok", "http_status", "status_text", "error", "content_type", "body"])


def ingest_changes(previous: dict, index_lines: DataFrame, sources: DataFrame, resources: DataFrame, touched_sources: DataFrame,
                   touched_urls: DataFrame, installs: DataFrame, managed_files: DataFrame, selected_urls: DataFrame, corpus: DataFrame) -> IN.Tables:
    """Run the import for what ``touched_sources(source_url)`` and ``touched_urls(url)`` concern.

    ``previous``: ``sources`` (with options), ``outcomes`` and ``results`` of the last run; the other arguments as in
    ``ingest``, the state as the last run left it.  Returns ``outcomes`` and ``results`` of all entries, ``refetched`` (the entries
    that were fetched anew), ``affected`` sources, ``plan`` and ``summary`` of these, ``delta`` (changes of the corpus for
    ``sources.log``) and the manifest tables.
    """
    state = IN.state_of(index_lines.sparkSession, installs=installs, managed_files=managed_files, selected_urls=selected_urls, corpus=corpus)
    sources = IN._with_root(sources)
    options = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in OPTIONS]
    known = IN._with_root(previous["sources"]).select(*SRC, *[F.col(c).alias(f"__{c}") for c in OPTIONS], F.lit(True).alias("__known"))
    marked = sources.join(known, SRC, "left").join(touched_sources.distinct().withColumn("__touched", F.lit(True)), "source_url", "left")
    same = F.coalesce("__known", F.lit(False)) & options[0] & options[1] & options[2] & options[3]
    marked = materialize(marked.select(*SRC, (F.coalesce("__touched", F.lit(False)) | ~same).alias("touched")))
    touched = sources.join(marked.filter("touched").select(*SRC), SRC, "left_semi")
    rest = marked.filter("NOT touched").select(*SRC)

    lines = index_lines.join(touched.select("source_url").distinct(), "source_url", "left_semi")
    _, selected = IN.entries_of(lines, touched, state)
    kept = previous["outcomes"].drop("content").join(rest, SRC, "left_semi")
    key = [*SRC, "url"]
    again = (kept.select(*key, "href", "path", "query").select(*key, F.explode(FE.candidate_urls()).alias("__candidate"))
             .join(touched_urls.select(F.col("url").alias("__candidate")).distinct(), "__candidate", "left_semi").select(*key).distinct())
    again = materialize(kept.select(*IN.ENTRY).join(again, key, "left_semi"))
    redone = IN.documents_of(selected.unionByName(again), resources)
    outcomes = materialize(kept.join(again.select(*key), key, "left_anti").unionByName(redone.drop("content"), allowMissingColumns=True))

    # sources with another outcome: those that were touched, and those of entries that came out differently
    fate = ["ok", "content_sha", "reason"]
    before = kept.select(*key, *[F.col(c).alias(f"__{c}") for c in fate])
    differs = redone.select(*key, *fate).join(before, key).filter(
        ~(F.col("ok").eqNullSafe(F.col("__ok")) & F.col("content_sha").eqNullSafe(F.col("__content_sha")) & F.col("reason").eqNullSafe(F.col("__reason"))))
    affected = materialize(touched.select(*SRC).unionByName(differs.select(*SRC)).distinct())
    own = sources.join(affected, SRC, "left_semi")
    # a source that isn't touched keeps its prefix, whoever else gets one
    stored = SY.same_source(state["installs"]).select(*SRC, F.coalesce("path_prefix", F.lit("")).alias("__stored"))
    own = (own.join(stored, SRC, "left").withColumn("path_prefix", F.coalesce("path_prefix", "__stored")).drop("__stored"))
    documents = outcomes.join(affected, SRC, "left_semi")
    results = IN.results_of(documents.drop("path_prefix").join(own.select(*SRC, "path_prefix"), SRC), own, state)
    out = IN.finish(results, own, documents.select(*SRC, "url", "line_pos", "match_pos"), state)
    narrow = results.drop("path_prefix")

    def delta():
        changed = SY.changed_documents(state["corpus"], narrow, out["summary"])
        contents = redone.filter("ok").select(*key, "content")
        # a document whose place changed, but not its text: converted again from its resource
        moved = documents.join(changed.select(*key), key, "left_semi").join(contents.select(*key), key, "left_anti")
        more = IN.documents_of(moved.select(*IN.ENTRY), resources).filter("ok").select(*key, "content")
        return {"delta": SY.corpus_delta(state["corpus"], narrow, out["plan"], out["summary"], contents.unionByName(more))}

    out.later["delta"] = delta
    out.update(sources=sources, outcomes=outcomes, refetched=redone, affected=affected,
               results=previous["results"].join(rest.join(affected, SRC, "left_anti"), SRC, "left_semi").unionByName(narrow))
    return out
