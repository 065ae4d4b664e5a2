"""Content sniffing expressions (E10-E12, E15) as native columns.

Only the first 2000 characters of a body are inspected (``substring`` before
``rlike``), as in the reference.  Lengths are code points, not UTF-16 units
(documented deviation for astral characters).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, js_trim_start

# --- fixed values -----------------------------------------------------------
SNIFF_CHARS = 2000
HTML_START = rf"(?i)^(<!doctype html|<html[{WS}>])"
HTML_TAG = rf"(?i)<(head|body|article|main)[{WS}>]"
MD_MARKS = rf"(?m)^#{{1,6}}[{WS}]|^[-*+][{WS}]|^[0-9]+\.[{WS}]|^>[{WS}]|\[[^\]]+\]\([^)]+\)"
MD_LINK = r"\[[^\]]+\]\([^)]+\)"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_path(url) -> Column:
    """Pathname of a normalised absolute URL (as produced by the resolver)."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?([^?#]*)", 2)


def is_html(body, content_type, path) -> Column:
    """Declared html/xhtml type, ``.html``/``.htm`` path, or an html
    start / structural tag within the first 2000 characters (any type)."""
    t = F.lower(F.coalesce(_c(content_type), F.lit("")))
    p = F.lower(_c(path))
    sample = js_trim_start(F.substring(_c(body), 1, SNIFF_CHARS))
    return (t.contains("text/html") | t.contains("application/xhtml+xml")
            | p.rlike(r"\.html?\z")
            | sample.rlike(HTML_START) | sample.rlike(HTML_TAG))


def is_markdown(body, content_type, path) -> Column:
    """Markdown or text/plain type, document extension, or Markdown
    marks at a line start / a link within the first 2000 characters."""
    t = F.lower(F.coalesce(_c(content_type), F.lit("")))
    p = F.lower(_c(path))
    sample = F.substring(_c(body), 1, SNIFF_CHARS)
    return (t.contains("markdown") | t.startswith("text/plain")
            | p.rlike(r"\.(md|markdown|mdx)\z")
            | sample.rlike(MD_MARKS))


def content_kind(body, content_type, path) -> Column:
    """P5: empty / html / markdown / unsupported (html is tested first)."""
    b = _c(body)
    # blank = no character outside the whitespace class (stops at the first
    # such character instead of rewriting the whole body)
    return (F.when(~b.rlike(f"[^{WS}]"), F.lit("empty"))
            .when(is_html(b, content_type, path), F.lit("html"))
            .when(is_markdown(b, content_type, path), F.lit("markdown"))
            .otherwise(F.lit("unsupported")))


def looks_html(body) -> Column:
    """E15 (registry review): html start of the left-trimmed body."""
    return js_trim_start(_c(body)).rlike(HTML_START)


def has_markdown_link(body) -> Column:
    """Any ``[x](y)`` anywhere (may span lines)."""
    return _c(body).rlike(MD_LINK)
