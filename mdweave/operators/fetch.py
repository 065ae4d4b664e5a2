"""Candidate URLs and first successful candidate against a crawl snapshot
(P4, S4, J2, A8, T3).

The reference fetches up to four candidate URLs per entry over the network and
keeps the first success.  Here the network is replaced by a crawl snapshot
table ``resources(url, ok, http_status, status_text, content_type,
content_length, final_url, error, body)`` (unique by ``url``):

1. every entry expands to its <= 4 candidates (``posexplode`` keeps the rank);
2. candidates probe a *narrow* projection ``(url, ok, reason)`` of the
   snapshot with an equi-join (no bodies in this shuffle);
3. a group-by per entry picks the lowest-ranked ok candidate and, when there
   is none, joins all candidate failures in rank order (<= 4 per group);
4. a second equi-join fetches body and content type for winners only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import trim_trailing_slash

ENTRY_KEYS = ["source_url", "href"]


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def candidate_urls(href="href", path="path", query="query") -> F.Column:
    """P4 as an array column: original; ``{p}.md``; ``{p}/index.md`` (``{p}index.md``
    for a trailing slash); ``{p}.html.md``; the ``.md`` forms only when the path
    without trailing slashes is longer than one character.  Query kept on all,
    duplicates removed keeping the first."""
    h, p, q = _c(href), _c(path), _c(query)
    origin = F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    q_sfx = F.when(q.isNotNull(), F.concat(F.lit("?"), q)).otherwise(F.lit(""))
    trimmed = trim_trailing_slash(p)
    non_root = F.length(trimmed) > 1
    index_path = F.when(p.endswith("/"), F.concat(p, F.lit("index.md"))).otherwise(F.concat(p, F.lit("/index.md")))
    md = F.when(non_root, F.concat(origin, trimmed, F.lit(".md"), q_sfx))
    idx = F.concat(origin, index_path, q_sfx)
    html_md = F.when(non_root, F.concat(origin, trimmed, F.lit(".html.md"), q_sfx))
    return F.array_distinct(F.filter(F.array(h, md, idx, html_md), lambda x: x.isNotNull()))


def expand_candidates(entries: DataFrame) -> DataFrame:
    """entries (source_url, href, path, query, ...) -> one row per candidate with ``rank``."""
    return entries.select(*entries.columns,
                          F.posexplode(candidate_urls()).alias("rank", "candidate_url"))


def resource_status(resources: DataFrame) -> DataFrame:
    """S4 narrow projection: (url, ok, reason)."""
    reason = F.coalesce(F.col("error"),
                        F.concat(F.lit("HTTP "), F.col("http_status").cast("string"), F.lit(" "),
                                 F.coalesce(F.col("status_text"), F.lit(""))))
    return resources.select(F.col("url").alias("candidate_url"), F.col("ok").alias("res_ok"),
                            F.when(~F.col("ok"), reason).alias("res_reason"))


def first_success(entries: DataFrame, resources: DataFrame) -> DataFrame:
    """J2 + A8 for entries keyed by (source_url, href).

    Where the snapshot has several rows of one URL, one that is ok counts; if none
    is, the first of their reasons (by code points) is the URL's.

    Output: entry columns + ok, fetched_url, via, rank, reason (null when ok).
    """
    carried = [c for c in entries.columns if c not in ENTRY_KEYS]
    cands = expand_candidates(entries)
    probed = cands.join(resource_status(resources), "candidate_url", "left")
    supported = F.col("candidate_url").rlike(r"^(?i)(https?|file):")
    msg = F.concat(F.col("candidate_url"), F.lit(" ("),
                   F.when(~supported,
                          F.concat(F.lit("unsupported protocol "),
                                   F.lower(F.regexp_extract("candidate_url", r"^([^:]*:)", 1))))
                   .otherwise(F.coalesce(F.col("res_reason"), F.lit("not in snapshot"))),
                   F.lit(")"))
    is_ok = F.coalesce(F.col("res_ok"), F.lit(False)) & supported
    # the carried entry columns depend on the key, so grouping by them too
    # costs no extra groups and saves a join back to the entries
    picked = (probed.groupBy(*ENTRY_KEYS, *carried)
              .agg(F.min(F.when(is_ok, F.struct(F.col("rank"), F.col("candidate_url")))).alias("w"),
                   F.array_sort(F.collect_set(F.struct(F.col("rank"), msg.alias("m")))).alias("fails")))
    one_each = F.expr("filter(fails, (x, i) -> i = 0 OR x.rank <> fails[i - 1].rank)")
    result = picked.select(
        *ENTRY_KEYS, *carried,
        F.col("w").isNotNull().alias("ok"),
        F.col("w.candidate_url").alias("fetched_url"),
        F.col("w.rank").alias("rank"),
        F.when(F.col("w").isNull(), F.array_join(F.transform(one_each, lambda x: x["m"]), "; ")).alias("reason"),
    ).withColumn("via", F.when(F.col("ok") & (F.col("fetched_url") != F.col("href")), F.col("fetched_url"))
                 .when(F.col("ok"), F.lit("")))
    return result


def fetch_bodies(fetched: DataFrame, resources: DataFrame, entries_without: bool = False) -> DataFrame:
    """Second join: body and content type for the winners only (``entries_without``: the
    other entries too, with neither).

    Of several ok rows of one URL, the first by content type and body hash is
    taken.  The reduction is grouped by the join key and the entry's columns, so
    after a sort-merge join it needs no further shuffle of the bodies."""
    res = resources.filter("ok").select(F.col("url").alias("fetched_url"), "content_type", "body")
    keys = ["fetched_url", *(c for c in fetched.columns if c != "fetched_url")]
    if entries_without:
        # an entry without a winner has a key of its own, so that they don't meet in one task
        own = F.coalesce("fetched_url", F.concat(F.lit("none "), "source_url", F.lit(" "), "href"))
        found = fetched.withColumn("__url", own).join(res.withColumnRenamed("fetched_url", "__url"), "__url", "left")
        keys = ["__url", *keys]
    else:
        found = fetched.filter("ok").join(res, "fetched_url", "inner")
    order = F.struct("content_type", F.sha2("body", 256))
    return (found.groupBy(*keys).agg(F.min_by(F.struct("content_type", "body"), order).alias("__r"))
            .select(*(k for k in keys if k != "__url"), "__r.*"))


def failure_preview(failures: DataFrame, keys=("source_url",), k: int = 5) -> DataFrame:
    """The first ``k`` failures per run in entry order, and how many more.

    ``row_number() <= k`` lets Spark insert a partial window-group limit before
    the shuffle, so a source with millions of failures ships at most ``k`` rows
    per map partition; the totals come from a partial aggregation.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("line_pos", "match_pos")
    top = failures.withColumn("failure_rank", F.row_number().over(w)).filter(F.col("failure_rank") <= k)
    totals = failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_total"))
    return (top.join(totals, keys, "inner")
            .withColumn("more", F.greatest(F.col("failed_total") - k, F.lit(0))))
