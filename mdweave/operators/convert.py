"""Classify fetched content and convert it to Markdown.

* ``markdown`` rows stay in Catalyst: trailing whitespace removed, one final
  newline added (E9).
* the bodies of ``html`` rows -- and only those, other rows hand a null to
  Python -- go through a row UDF with a small ``html.parser`` converter.  Bodies
  are large: a row UDF gets 100 rows at a time, where an Arrow batch has 10,000
  or 64 MB, so a worker's memory doesn't follow the rows of its task.  The
  bodies are read and joined once.
* ``empty`` and ``unsupported`` rows become failures with reason
  ``unsupported content received from {url}``; no other candidate is tried.

The html dialect (our own, documented): ATX headings, fenced code blocks,
``script``/``style``/``noscript``/``title`` dropped (only up to their end tag:
without one, what follows is kept), paragraphs and block
elements separated by blank lines, ``-`` bullets and ``1.`` numbers, inline
``[text](href)`` links, ``![alt](src)`` images, ``_em_``, ``**strong**``,
`` `code` ``, ``>`` quotes, ``---`` rules, table cells joined by `` | ``, HTML
entities decoded, Markdown-significant characters in text escaped.  It is not
byte-identical to the reference's third-party converter (only ``<h1>Hello</h1>``
-> ``# Hello`` is pinned by the reference's tests).
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import content_kind, url_path
from ..functions.text import ensure_trailing_newline, js_trim_end

# --- fixed values -----------------------------------------------------------
DROP_TAGS = {"script", "style", "noscript", "title", "template"}
BLOCK_TAGS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside",
              "ul", "ol", "li", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6",
              "hr", "figure", "figcaption", "dl", "dt", "dd", "form", "address", "body", "html"}
VOID_TAGS = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
# ---------------------------------------------------------------------------

_ESCAPES = [
    (re.compile(r"\\"), r"\\\\"),
    (re.compile(r"\*"), r"\*"),
    (re.compile(r"_"), r"\_"),
    (re.compile(r"`"), r"\`"),
    (re.compile(r"\["), r"\["),
    (re.compile(r"\]"), r"\]"),
    (re.compile(r"^(#{1,6}) ", re.M), r"\\\1 "),
    (re.compile(r"^-", re.M), r"\\-"),
    (re.compile(r"^\+ ", re.M), r"\\+ "),
    (re.compile(r"^>", re.M), r"\\>"),
    (re.compile(r"^(\d+)\. ", re.M), r"\1\\. "),
]


def _escape(text: str) -> str:
    for pat, rep in _ESCAPES:
        text = pat.sub(rep, text)
    return text


class _Converter(HTMLParser):
    """Streaming html -> Markdown; tolerant of unclosed tags: no text is lost by one."""

    def __init__(self, body: str):
        super().__init__(convert_charrefs=True)
        # end tags still to come, so that a dropped element without one drops nothing
        self.ends = Counter(t.lower() for t in re.findall(r"</([A-Za-z]+)", body) if t.lower() in DROP_TAGS)
        self.dropping: list[str] = []
        self.code = 0
        self.language = ""
        self.marker = ""                  # of the list item whose first block is still to come
        self.out: list[str] = []          # finished blocks
        self.line: list[str] = []         # inline buffer of the current block
        self.pre = 0
        self.lists: list[list] = []       # stack of [kind, counter]
        self.quote = 0
        self.links: list[str | None] = []
        self.heading = 0
        self.open_inline: list[str] = []

    # -- block handling -----------------------------------------------------
    def _flush(self):
        text = "".join(self.line)
        self.line = []
        if self.pre:
            return
        text = re.sub(r"[ \t\r\n\f]+", " ", text)
        text = re.sub(r" *\x00 *", "  \n", text).strip()
        if not text:
            return
        if text == "[":  # a link around a block
            self.line = ["["]
            return
        block = "#" * self.heading + " " * bool(self.heading) + text
        block = self._in_list(block)
        if self.quote:
            block = "\n".join("> " + ln for ln in block.split("\n"))
        self.out.append(block)

    def _in_list(self, block):
        """The block behind its list marker, or below the item that it continues."""
        if self.marker:
            block, self.marker = self.marker + block.replace("\n", "\n" + " " * len(self.marker)), ""
        elif self.lists:
            block = "  " * len(self.lists) + block.replace("\n", "\n" + "  " * len(self.lists))
        return block

    def _end_pre(self):
        code = "".join(self.line).strip("\n")
        self.line = []
        self.out.append(self._in_list("```" + self.language + "\n" + code + "\n```"))
        self.language = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROP_TAGS:
            if self.ends[tag] > 0:
                self.dropping.append(tag)
            return
        if self.dropping:
            return
        if tag in BLOCK_TAGS and not self.pre:
            self._flush()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = int(tag[1])
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
            self.marker = "  " * depth + marker
        elif tag == "blockquote":
            self.quote += 1
        elif tag == "pre":
            if not self.pre:
                self._flush()
                self.line = []
            self.pre += 1
        elif tag == "br":
            self.line.append("\x00" if not self.pre else "\n")
        elif tag == "hr":
            self.out.append("---")
        elif tag == "img":
            self.line.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "a":
            self.links.append(a.get("href"))
            self.line.append("[" if a.get("href") else "")
        elif tag in ("em", "i"):
            self.line.append("_")
        elif tag in ("strong", "b"):
            if "b" in self.open_inline or "strong" in self.open_inline:
                return
            self.open_inline.append(tag)
            self.line.append("**")
        elif tag == "code" and not self.pre:
            self.code += 1
            self.line.append("`")
        elif tag == "code":
            named = re.search(r"(?:^|\s)lang(?:uage)?-([^\s`]+)", a.get("class") or "")
            self.language = named[1] if named else self.language
        elif tag in ("td", "th"):
            if self.line and "".join(self.line).strip():
                self.line.append(" | ")

    def handle_endtag(self, tag):
        if tag in DROP_TAGS:
            self.ends[tag] -= 1
            if tag in self.dropping:
                del self.dropping[self.dropping.index(tag):]
            return
        if self.dropping:
            return
        if tag == "pre" and self.pre:
            self.pre -= 1
            if not self.pre:
                self._end_pre()
            return
        if tag == "a" and self.links:
            href = self.links.pop()
            if href and not self.line and self.out and not self.pre:  # the link's text was a block
                self.out[-1] += f"]({href})"
            elif href:
                self.line.append(f"]({href})")
            return
        if tag in ("em", "i"):
            self.line.append("_")
        elif tag in ("strong", "b"):
            if tag in self.open_inline:
                self.open_inline.remove(tag)
                self.line.append("**")
        elif tag == "code" and not self.pre:
            self.code = max(self.code - 1, 0)
            self.line.append("`")
        if tag in BLOCK_TAGS and not self.pre:
            for t in reversed(self.open_inline):
                self.line.append("**")
            self.open_inline = []
            self._flush()
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.heading = 0
            elif tag == "li":
                self.marker = ""
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "blockquote":
                self.quote = max(self.quote - 1, 0)

    def handle_data(self, data):
        if self.dropping:
            return
        self.line.append(data if self.pre or self.code else _escape(data.replace("\x00", "")))

    def result(self) -> str:
        if self.pre:
            self.pre = 0
            self._end_pre()
        for _ in self.open_inline:
            self.line.append("**")
        self._flush()
        return "\n\n".join(self.out).strip()


def html_to_markdown_text(body: str | None) -> str | None:
    """Convert one html document; blank input -> ''."""
    if body is None:
        return None
    if not body.strip():
        return ""
    conv = _Converter(body)
    conv.feed(body)
    conv.close()
    return conv.result()


def _converted(kind: str, body: str) -> F.Column:
    """The Markdown of the html rows (null in all others): the other bodies never go to Python."""
    run = F.udf(html_to_markdown_text, "string", useArrow=False)
    return run(F.when(F.col(kind) == "html", F.col(body)))


def classify(df: DataFrame, url: str = "url", body: str = "body", content_type: str = "content_type") -> DataFrame:
    """P5: add ``kind`` (empty/html/markdown/unsupported)."""
    return df.withColumn("kind", content_kind(F.col(body), F.col(content_type), url_path(F.col(url))))


def convert_markdown_rows(df: DataFrame, url: str = "url") -> DataFrame:
    """P6 native branch for classified rows: markdown -> content, others -> null."""
    content = F.when(F.col("kind") == "markdown", js_trim_end("body"))
    return (df.withColumn("content", F.when(content != "", ensure_trailing_newline(content)))
            .drop("body"))


def convert_html_rows(df: DataFrame) -> DataFrame:
    """P6 html branch of classified rows: html -> content, others -> null."""
    out = df.withColumn("content", _converted("kind", "body")).drop("body")
    return out.withColumn("content", F.when(F.col("content") != "", ensure_trailing_newline("content")))


def to_markdown(df: DataFrame, url: str = "url") -> DataFrame:
    """P5 + P6 over (url, content_type, body, ...): adds kind, content, ok,
    reason, content_sha.  One pass over the bodies: both branches are columns of
    the same rows, and only html bodies are handed to Python."""
    classified = classify(df, url).withColumn("__html", _converted("kind", "body"))
    native = convert_markdown_rows(classified, url)
    html = F.when(F.col("__html") != "", ensure_trailing_newline("__html"))
    out = native.withColumn("content", F.coalesce(html, F.col("content"))).drop("__html")
    ok = F.col("content").isNotNull()
    return (out.withColumn("ok", ok)
            .withColumn("reason", F.when(~ok, F.concat(F.lit("unsupported content received from "), F.col(url))))
            .withColumn("content_sha", F.when(ok, F.sha2(F.col("content"), 256))))
