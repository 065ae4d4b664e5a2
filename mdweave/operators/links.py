"""Link-index operators: P1 extract, P2 resolve, A1 dedupe, P3 host policy,
A6/A7 link statistics.

Tables
------
link_index  (source_url, body)                 one whole text per source (S3)
index_lines (source_url, line_pos, line)       the same, one row per line
links       (source_url, line_pos, match_pos, title, raw_href, href_in,
             status, href, scheme, host, path, query)

Document order is the key ``(line_pos, match_pos)`` from ``posexplode``; it is
never a generated id.  Large indexes stay distributed: every step after the
line split is per row, and the only shuffle is the dedupe aggregation keyed by
``(source_url, href)`` with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, normalize_href
from ..functions.urls import resolve_urls

# --- fixed values -----------------------------------------------------------
# Markdown link as the reference matches it: [title](href), title without ']',
# href up to the first ')'.
LINK_RE = r"\[([^\]]+)\]\(([^)]+)\)"
# ---------------------------------------------------------------------------


def split_index_lines(link_index: DataFrame) -> DataFrame:
    """S3 -> lines: split each body on ``\\r?\\n`` keeping the line position."""
    return (link_index
            .select("source_url", F.posexplode(F.split(F.col("body"), "\\r?\\n")).alias("line_pos", "line"))
            .withColumn("line_pos", F.col("line_pos").cast("long")))


def extract_links(index_lines: DataFrame) -> DataFrame:
    """P1 + E1: all non-overlapping ``[title](href)`` matches of every line.

    Lines without ``](`` are dropped by a cheap ``contains`` before the regex.
    Rows whose normalised href is empty are dropped silently (as the reference).
    Output: source_url, line_pos, match_pos, title, raw_href, href_in.
    """
    lines = index_lines.filter(F.col("line").contains("]("))
    matches = lines.select(
        "source_url", "line_pos",
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all("line", F.lit(LINK_RE), 1).alias("t"),
            F.regexp_extract_all("line", F.lit(LINK_RE), 2).alias("h"),
        )).alias("match_pos", "m"))
    out = matches.select(
        "source_url", "line_pos", "match_pos",
        js_trim(F.col("m.t")).alias("title"),
        F.col("m.h").alias("raw_href"),
    ).withColumn("href_in", normalize_href("raw_href"))
    return out.filter(F.col("href_in") != "")


def resolve_links(links: DataFrame, base_col: str = "source_url") -> DataFrame:
    """P2 + E2: resolve ``href_in`` against the index URL; fragment dropped.

    Adds status (ok / invalid / unsupported), href, scheme, host, path, query.
    """
    df = resolve_urls(links, "href_in", "__u", base=base_col, keep_base="__src")
    return df.select(
        *[c for c in links.columns],
        # the index URL's parts, parsed once here and reused by the host policy
        F.col("__src.scheme").alias("src_scheme"),
        F.col("__src.host").alias("src_host"),
        F.col("__u.status").alias("status"),
        F.col("__u.href").alias("href"),
        F.col("__u.scheme").alias("scheme"),
        F.col("__u.host").alias("host"),
        F.col("__u.path").alias("path"),
        F.col("__u.query").alias("query"),
    )


def valid_links(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("status") == "ok")


def link_rejects(resolved: DataFrame) -> DataFrame:
    """P2 rejects: invalid targets and unsupported protocols (warnings in the reference)."""
    return resolved.filter(F.col("status").isin("invalid", "unsupported"))


def dedupe_links(links_ok: DataFrame) -> DataFrame:
    """A1 (a W3 first-wins pick): first occurrence per ``(source_url, href)``
    wins, order kept.

    A group-by with ``min`` of the order struct (map-side partial aggregation),
    not a window: a repeated href collapses before the shuffle.
    """
    first = F.min(F.struct("line_pos", "match_pos", "title", "scheme", "host", "path", "query"))
    # src_scheme / src_host depend on source_url only: grouping by them adds no groups
    return (links_ok.groupBy("source_url", "src_scheme", "src_host", "href")
            .agg(first.alias("f"), F.count(F.lit(1)).alias("occurrences"))
            .select("source_url", "src_scheme", "src_host",
                    F.col("f.line_pos").alias("line_pos"), F.col("f.match_pos").alias("match_pos"),
                    F.col("f.title").alias("title"), "href",
                    F.col("f.scheme").alias("scheme"), F.col("f.host").alias("host"),
                    F.col("f.path").alias("path"), F.col("f.query").alias("query"),
                    "occurrences"))


def apply_host_policy(unique_links: DataFrame, allow_external=False) -> DataFrame:
    """Keep links whose host equals the index host exactly (case-insensitive).

    Only for http(s) sources without the allow flag; local sources and the
    allow flag keep everything.  ``allow_external`` is a bool or a column name.
    Uses the index URL parts carried from ``resolve_links`` (parsing them only
    when absent).  Adds ``allowed``.
    """
    if "src_scheme" in unique_links.columns and "src_host" in unique_links.columns:
        df = unique_links
    else:
        df = resolve_urls(unique_links, "source_url", "__src")
        df = (df.withColumn("src_scheme", F.col("__src.scheme")).withColumn("src_host", F.col("__src.host"))
              .drop("__src"))
    allow = F.col(allow_external) if isinstance(allow_external, str) else F.lit(bool(allow_external))
    remote = F.col("src_scheme").isin("http", "https")
    allowed = ~remote | allow | (F.lower(F.col("host")) == F.lower(F.col("src_host")))
    return df.withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def link_stats(resolved: DataFrame | None, policy: DataFrame, selected: DataFrame | None = None,
               keys=("source_url",)) -> DataFrame:
    """A6 per source: links found, unique URLs, selected and blocked docs, and
    how many hosts are blocked (``blocked_hosts`` lists them).

    ``resolved`` is the resolved link table (per ``source_url``; without it, links are counted by the
    ``occurrences`` of ``policy``), ``policy`` the deduped table with ``allowed``, ``selected`` the entries left after the
    previous selection (J4; without it, all allowed ones).  ``keys`` are
    ``source_url``, with ``collection`` where a source is in several.
    """
    keys = list(keys)
    found = None if resolved is None else (resolved.filter(F.col("status") == "ok").groupBy("source_url")
                                           .agg(F.count(F.lit(1)).alias("links_found")))
    counted = [] if resolved is not None else [F.sum("occurrences").alias("links_found")]
    per = (policy.groupBy(*keys)
           .agg(*counted, F.count(F.lit(1)).alias("unique_urls"),
                F.count_if(F.col("allowed")).alias("selected_docs"),
                F.count_if(~F.col("allowed")).alias("blocked_docs")))
    hosts = blocked_hosts(policy, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("blocked_hosts"))
    per = per.join(hosts, keys, "left").fillna(0, ["blocked_hosts"])
    if selected is not None:
        left = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("__selected"))
        per = (per.join(left, keys, "left")
               .withColumn("selected_docs", F.coalesce("__selected", F.lit(0).cast("long"))).drop("__selected"))
    return per if found is None else found.join(per, "source_url", "left")


def blocked_hosts(policy: DataFrame, keys=("source_url",)) -> DataFrame:
    """A7 in long form: one row per source and blocked host, so that no source's
    list is ever one value."""
    return (policy.filter(~F.col("allowed") & F.col("host").isNotNull()).groupBy(*keys, "host")
            .agg(F.count(F.lit(1)).alias("blocked_links")))
