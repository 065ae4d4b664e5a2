"""Input views derived from the driver tables.

The driver data has no link indexes, crawl snapshot, registry, manifest or
corpus, so they are derived here by deterministic, row-wise rules from
``pages`` and ``documents``.  ``plans/oracle.py`` writes the same definitions
in DuckDB SQL.  All rows of the driver tables are used; the ``page_id % k`` /
``doc_id % k`` rules only assign each row to a variant (which URL form a
resource is stored under, which content type it carries, how the previous
snapshot differed), they never cut rows from the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import parse_urls
from ..operators.fetch import candidate_urls
from ..session import materialize
from ..sources.tables import load_table

# --- fixed values of the derived fixtures -----------------------------------
ANCHOR_RE = r'<a href="([^"]*)">([^<]*)</a>'
TITLE_RE = r"<title>([^<]*)</title>"
CRAWL_INDEX_URL = "https://crawl.example.org/llms.txt"
EXTRA_LINE_BASE = 1_000_000_000  # line positions of the per-index extra lines
LOCAL_EXTENSIONS = (".html", ".HTM", ".md", ".MDX", ".markdown", ".txt", "")
MANIFEST_FORMS = (  # ~id~ stands for the document's id, ~site~ for its source
    '{"version":2,"installs":[{"source":{"label":"~lang~","seen":{"by":~id~},"url":"~site~/llms.txt"},"managedFiles":["b/~id~.md",~id~,"a/~id~.md",'
    '"b/~id~.md",null],"selectedUrls":["~site~/b/~id~",null,"~site~/a/~id~",true,"~site~/b/~id~"],"layout":"flat","pathPrefix":"~lang~"},'
    '{"source":{"label":"no url"},"managedFiles":["n/~id~.md"],"layout":"other"},null,7,'
    '{"source":{"label":"twice","url":"~site~/llms.txt"},"managedFiles":["t/~id~.md"],"selectedUrls":["~site~/t/~id~"]},'
    '{"managedFiles":["o/~id~.md"],"selectedUrls":["~site~/o/~id~","~site~/n/~id~"]}]}',
    '{"source":{"label":~id~,"url":"~site~/llms.txt"},"managedFiles":["c/~id~.md"],"selectedUrls":"~site~/c","pathPrefix":5}',
    '{"layout":null}',
    '{"installs":[{"source":{"url":"~site~/llms.txt"}',
    '{"version":2,"installs":"~id~"}',
    '{"installs":{},"source":{"url":"~site~/~id~/llms.txt"},"selectedUrls":["~id~",~id~]}',
)
# ---------------------------------------------------------------------------


def page_host(url_col="url"):
    return F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z]+://([^/?#:]+)", 1))


def page_domain(url_col="url"):
    """Registrable part used to group pages into site indexes: last 3 labels."""
    return F.regexp_extract(page_host(url_col), r"([^.]+\.[^.]+\.[^.]+)$", 1)


def page_title(html_col="html"):
    return F.regexp_extract(F.col(html_col), TITLE_RE, 1)


def anchor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one link index per page: source_url = page url, body = one
    ``- [text](href)`` line per anchor of the page's html."""
    pages = load_table(spark, sf_dir, "pages")
    anchors = F.regexp_extract_all(F.col("html"), F.lit(ANCHOR_RE), 0)
    body = F.array_join(F.transform(anchors, lambda a: F.regexp_replace(a, ANCHOR_RE, "- [$2]($1)")), "\n")
    return pages.select(F.col("url").alias("source_url"), body.alias("body"))


def _page_lines(pages: DataFrame, source_url) -> DataFrame:
    line = F.concat(F.lit("- ["), page_title(), F.lit("]("), F.col("url"), F.lit(")"))
    return pages.select(source_url.alias("source_url"),
                        (F.col("page_id") + 1).cast("long").alias("line_pos"), line.alias("line"))


def host_index_lines(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """V2: one index per site (last three host labels) at
    ``https://<domain>/llms.txt``, listing every page of the site's hosts in
    ``page_id`` order (sub-domain pages are external for the host policy),
    plus a header, a ``mailto:`` link, a broken link and a repeat of the
    site's first page.  Returned as lines (source_url, line_pos, line): a site
    index is never assembled into one string."""
    pages = (load_table(spark, sf_dir, "pages") if pages is None else pages).select("page_id", "url", "html")
    src = F.concat(F.lit("https://"), page_domain(), F.lit("/llms.txt"))
    listed = _page_lines(pages, src)
    sites = (pages.groupBy(page_domain().alias("domain"))
             .agg(F.min_by("url", "page_id").alias("first_url")))
    s_url = F.concat(F.lit("https://"), F.col("domain"), F.lit("/llms.txt"))
    def item(pos, line):
        return F.struct(F.lit(pos).cast("long").alias("p"), line.alias("l"))

    extra = sites.select(s_url.alias("source_url"), F.explode(F.array(
        item(0, F.concat(F.lit("# "), F.col("domain"))),
        item(EXTRA_LINE_BASE + 1, F.concat(F.lit("- [Contact](mailto:docs@"), F.col("domain"), F.lit(")"))),
        item(EXTRA_LINE_BASE + 2, F.lit("- [Broken](http://[)")),
        item(EXTRA_LINE_BASE + 3, F.concat(F.lit("- [Again](<"), F.col("first_url"), F.lit('> "first page again")'))),
    )).alias("x")).select("source_url", F.col("x.p").alias("line_pos"), F.col("x.l").alias("line"))
    return listed.unionByName(extra)


def crawl_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index listing every page; paths collide across hosts."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return _page_lines(pages, F.lit(CRAWL_INDEX_URL))


def crawl_resources(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """V3: the crawl snapshot.  Each page is stored under one of its candidate
    URLs by ``page_id % 5`` (original, ``.md``, ``/index.md``, ``.html.md``);
    the fifth variant is a failed fetch (HTTP 404 for even ids, a transport
    error for odd ids).  Content type by ``page_id % 3``: ``text/html``,
    missing, ``application/octet-stream``."""
    pages = (load_table(spark, sf_dir, "pages") if pages is None else pages).select("page_id", "url", "html")
    parsed = parse_urls(pages, "url", "u")
    variant = F.col("page_id") % 5
    cands = candidate_urls(F.col("u.href"), F.col("u.path"), F.col("u.query"))
    stored = F.when(variant == 4, F.col("u.href")).otherwise(F.element_at(cands, (variant + 1).cast("int")))
    ok = variant != 4
    http404 = (F.col("page_id") % 2) == 0
    ctype = (F.when(F.col("page_id") % 3 == 0, F.lit("text/html"))
             .when(F.col("page_id") % 3 == 1, F.lit(""))
             .otherwise(F.lit("application/octet-stream")))
    return parsed.select(
        stored.alias("url"),
        ok.alias("ok"),
        F.when(ok, F.lit(200)).when(http404, F.lit(404)).cast("int").alias("http_status"),
        F.when(ok, F.lit("OK")).when(http404, F.lit("Not Found")).alias("status_text"),
        F.when(ok, ctype).alias("content_type"),
        F.when(ok, F.length("html").cast("long")).alias("content_length"),
        F.when(ok, stored).alias("final_url"),
        F.when(~ok & ~http404, F.lit("socket hang up")).alias("error"),
        F.when(ok, F.col("html")).alias("body"),
    )


def later_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a second crawl: those with ``page_id % 50 = 7`` are gone (from the indexes too), and those
    with ``page_id % 40 = 3`` have one more paragraph."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url", "html").filter(F.col("page_id") % 50 != 7)
    more = F.concat("html", F.lit("<p>second edition</p>"))
    return pages.withColumn("html", F.when(F.col("page_id") % 40 == 3, more).otherwise(F.col("html")))


LOG_RUNS = 4


def corpus_at(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    """The corpus after ``run`` (from 1) of several: a document is missing in it if ``(doc_id + run) % 9 = 0``, and its
    content is another from the run on that ``doc_id % 10`` names (2 to ``LOG_RUNS``)."""
    base = _doc_base(spark, sf_dir).filter((F.col("doc_id") + run) % 9 != 0)
    edition = F.when((F.col("doc_id") % 10).between(2, run), F.lit("second")).otherwise(F.lit("first"))
    content = F.concat("content", edition)
    return base.select("collection", "path", F.sha2(content, 256).alias("content_sha"), content.alias("content"))


def doc_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: ``documents`` as fetched text resources at
    ``https://<source>.example.org/<lang>/<doc_id>``; content type by
    ``doc_id % 3``: ``text/plain``, missing, ``text/html`` (so the classifier
    meets markdown, unsupported and html rows)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/"),
                   F.col("doc_id").cast("string"))
    ctype = (F.when(F.col("doc_id") % 3 == 0, F.lit("text/plain"))
             .when(F.col("doc_id") % 3 == 1, F.lit(""))
             .otherwise(F.lit("text/html")))
    return docs.select(F.col("doc_id"), url.alias("url"), F.lit(True).alias("ok"),
                       F.lit(200).cast("int").alias("http_status"), F.lit("OK").alias("status_text"),
                       ctype.alias("content_type"), F.length("text").cast("long").alias("content_length"),
                       url.alias("final_url"), F.lit(None).cast("string").alias("error"),
                       F.col("text").alias("body"))


def fetched_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 ok rows and V4: every successfully fetched body (url, content_type, body)."""
    v3 = crawl_resources(spark, sf_dir).filter("ok").select("url", "content_type", "body")
    v4 = doc_resources(spark, sf_dir).select("url", "content_type", "body")
    return v3.unionByName(v4)


def crawl_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique links of the crawl index V2b (host policy allows all: the index
    host is not a page host).  Columns of the link table."""
    from ..operators import links as L
    lines = crawl_index_lines(spark, sf_dir)
    return L.dedupe_links(L.valid_links(L.resolve_links(L.extract_links(lines))))


def local_mirror_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 input: every page anchor as a file in a local mirror,
    ``file:///srv/mirror/<host><href>``, with the index root
    ``/srv/mirror/<domain>`` -- pages of the site's own host fall inside the
    root, sub-domain pages outside it."""
    pages = load_table(spark, sf_dir, "pages").select("url", "html")
    anchors = pages.select(page_host().alias("host_name"), page_domain().alias("domain"),
                           F.explode(F.regexp_extract_all("html", F.lit(ANCHOR_RE), 0)).alias("a"))
    rows = anchors.select(
        F.concat(F.lit("file:///srv/mirror/"), F.col("host_name"), F.regexp_replace("a", ANCHOR_RE, "$1"))
        .alias("file_url"),
        F.regexp_replace("a", ANCHOR_RE, "$2").alias("title"),
        F.concat(F.lit("/srv/mirror/"), F.col("domain")).alias("local_root_dir"),
    )
    parsed = parse_urls(rows, "file_url", "u")
    return parsed.select("file_url", "title", "local_root_dir", F.col("u.href").alias("href"),
                         F.col("u.scheme").alias("scheme"), F.col("u.host").alias("host"),
                         F.col("u.path").alias("path"))


# --- V6: previous snapshot and manifest for the sync queries -----------------------

def _doc_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per document, grouped in sources and two collections.

    ``k`` = doc_id div 20 numbers the documents inside their source (the
    driver assigns sources by doc_id modulo 20); the variant rules below use it.

    source_url = https://<source>.example.org/llms.txt, collection =
    docs-<n % 2> (n = the number in the source name), path prefix = source,
    path = <source>/<lang>/<doc_id>.md, content = text without trailing
    whitespace plus one newline."""
    from ..functions.text import ensure_trailing_newline, js_trim_end
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    n = F.regexp_extract("source", r"[0-9]+", 0).cast("int")
    return docs.select(
        "doc_id", (F.col("doc_id") / 20).cast("long").alias("k"), "lang", "source", n.alias("src_n"),
        F.concat(F.lit("docs-"), (n % 2).cast("string")).alias("collection"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/llms.txt")).alias("source_url"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("url"),
        F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
        .alias("path"),
        ensure_trailing_newline(js_trim_end("text")).alias("content"),
    )


#: n % 5, first pos, source_url (~source~ stands for the source) and label, k % 2 of the documents in its lists, their folder
OTHER_INSTALLS = ((0, 1000, "https://~source~.example.org/llms.txt", "second", 0, "second"), (1, 2000, None, "nameless", 0, "one"),
                  (1, 3000, None, "nameless", 1, "two"), (2, 4000, "https://~source~.old.example.org/llms.txt", "old", 0, "old"),
                  (2, 5000, "https://~source~.old.example.org/llms.txt", "old", 1, "older"))


def _other_installs(base: DataFrame) -> DataFrame:
    """(collection, pos, source_url, source_label, source, src_n, path, url, doc_id): a row for every entry of their lists."""
    out = None
    for n, pos, url, label, k, folder in OTHER_INSTALLS:
        source_url = F.concat(*(F.col("source") if x == "source" else F.lit(x) for x in url.split("~"))) if url else F.lit(None).cast("string")
        fields = [F.lit(label).alias("label"), F.lit(folder).alias("seen"), *([source_url.alias("url")] if url else [])]
        rows = base.filter((F.col("src_n") % 5 == n) & (F.col("k") % 2 == k)).select(
            "collection", (F.col("src_n") + pos).cast("int").alias("pos"), source_url.alias("source_url"), F.lit(label).alias("source_label"),
            F.to_json(F.struct(*fields)).alias("source"), F.concat_ws("/", F.lit(folder), "path").alias("path"),
            F.concat("url", F.lit(f"#{folder}")).alias("url"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def sync_inputs(spark: SparkSession, sf_dir: str) -> dict:
    """Entries of this run and the previous manifest + corpus (V6).

    * sources whose number n has n % 5 = 4 are new (no install);
    * the previous install of a source managed every doc with k % 10 != 0,
      plus a ghost path <source>/<lang>/<doc_id>-old.md for k % 11 = 0;
    * its selection: empty for even n (take all), else its managed doc URLs;
    * the corpus lacks managed docs with k % 13 = 0 (deleted by hand),
      holds an older content for k % 7 = 0 and unmanaged files for the
      docs with k % 10 = 0 and k % 3 = 0;
    * this run fails the fetch of k % 4 = 0 in sources with n % 5 = 3;
    * behind those, the manifest has a second install of sources with n % 5 = 0 (pos 1000 + n), two
      nameless ones for n % 5 = 1 (pos 2000 + n and 3000 + n) and two of a source that doesn't
      run for n % 5 = 2 (pos 4000 + n and 5000 + n), each with lists of its own (``OTHER_INSTALLS``).
    """
    base = materialize(_doc_base(spark, sf_dir))
    installed = base.filter(F.col("src_n") % 5 != 4)
    entries = base.select("collection", "source_url", "url", F.col("doc_id").cast("long").alias("line_pos"),
                          F.lit(0).alias("match_pos"), "path", "content", "src_n", "doc_id", "k")
    sources = base.select("collection", "source_url", "source", "src_n").distinct()
    run_sources = sources.select(
        "collection", "source_url",
        F.concat(F.col("source"), F.lit(" docs (") , F.col("source"), F.lit(")")).alias("source_label"),
        F.lit("nested").alias("layout"), F.col("source").alias("path_prefix"), F.col("src_n").alias("seq"))
    w = Window.partitionBy("collection").orderBy("src_n")
    installs = (sources.filter(F.col("src_n") % 5 != 4)
                .withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
                .select("collection", "pos", "source_url",
                        F.concat(F.col("source"), F.lit(" docs (") , F.col("source"), F.lit(")")).alias("source_label"),
                        F.lit("nested").alias("layout"), F.col("source").alias("path_prefix"),
                        F.to_json(F.struct(F.col("source").alias("label"), F.col("source_url").alias("url"))).alias("source")))
    places = installs.select("collection", "source_url", "pos")
    others = _other_installs(base)
    installs = installs.unionByName(others.select("collection", "pos", "source_url", "source_label", F.lit("flat").alias("layout"),
                                                  F.lit(None).cast("string").alias("path_prefix"), "source").distinct())
    prev_docs = installed.filter(F.col("k") % 10 != 0)
    ghost = installed.filter(F.col("k") % 11 == 0).select(
        "collection", "source_url", "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("-old.md"))).alias("path"))
    managed_files = (prev_docs.select("collection", "source_url", "path").unionByName(ghost.select("collection", "source_url", "path"))
                     .join(places, ["collection", "source_url"]).unionByName(others.select("collection", "source_url", "path", "pos")))
    selected_urls = (prev_docs.filter(F.col("src_n") % 2 == 1).select("collection", "source_url", "url", "doc_id")
                     .join(places, ["collection", "source_url"]).unionByName(others.select("collection", "source_url", "url", "doc_id", "pos"))
                     .withColumn("ord", F.struct(F.col("doc_id").cast("long").alias("line_pos"), F.lit(0).alias("match_pos"))).drop("doc_id"))
    old_content = F.when(F.col("k") % 7 == 0, F.concat(F.col("content"), F.lit("old"))).otherwise(F.col("content"))
    corpus = (prev_docs.filter(F.col("k") % 13 != 0)
              .select("collection", "path", F.sha2(old_content, 256).alias("content_sha"))
              .unionByName(ghost.select("collection", "path", F.sha2(F.lit("ghost\n"), 256).alias("content_sha")))
              .unionByName(base.filter((F.col("k") % 10 == 0) & (F.col("k") % 3 == 0))
                           .select("collection", "path", F.sha2(F.lit("unmanaged\n"), 256).alias("content_sha"))))
    # the previous run's tables are tables, not plans that each step would run again
    out = {"entries": entries, "installs": materialize(installs), "managed_files": materialize(managed_files),
           "selected_urls": materialize(selected_urls), "corpus": corpus, "run_sources": run_sources}
    return out


def fetch_selected(selected: DataFrame) -> DataFrame:
    """This run's fetch outcome for the selected entries (see sync_inputs)."""
    failed = (F.col("src_n") % 5 == 3) & (F.col("k") % 4 == 0)
    return selected.select(
        "collection", "source_url", "url", "line_pos", "match_pos", "path",
        (~failed).alias("ok"),
        F.when(~failed, F.sha2("content", 256)).alias("content_sha"),
        F.when(failed, F.concat(F.col("url"), F.lit(" (HTTP 404 Not Found)"))).alias("reason"))


def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest files, one per document, by ``doc_id % 6``: a version-2 record whose lists
    hold numbers, nulls and repeats, with an install without a URL and entries that are no
    installs; a legacy record with values of wrong types; a legacy record known by
    one key with a null; cut off text; ``installs`` that is a string; and ``installs``
    that is an object beside a legacy key."""
    docs = load_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 6).alias("v"), "lang",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org")).alias("site"))

    def filled(template):
        parts = [F.col(p) if p in ("id", "lang", "site") else F.lit(p) for p in template.split("~")]
        return F.concat(*parts)

    text = F.when(F.col("v") == 0, filled(MANIFEST_FORMS[0]))
    for v, form in enumerate(MANIFEST_FORMS[1:], 1):
        text = text.when(F.col("v") == v, filled(form))
    return docs.select(F.concat(F.lit("m-"), F.col("id")).alias("collection"), text.alias("text"))


#: published pairs of an international label and its ASCII form
INTERNATIONAL = (("b\u00fccher", "xn--bcher-kva"), ("fa\u00df", "xn--fa-hia"), ("\u4f8b\u3048", "xn--r8jz45g"),
                 ("\u30c6\u30b9\u30c8", "xn--zckzah"), ("\u2603", "xn--n3h"))


def host_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, 13 per page: its own, and forms with numbers from ``page_id`` that a URL parser rewrites or refuses."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    n, text = F.col("page_id"), F.col("page_id").cast("string")
    byte = (n % 256).cast("string")
    label = F.get(F.array(*[F.lit(a) for a, _ in INTERNATIONAL]), (n % len(INTERNATIONAL)).cast("int"))
    forms = [page_host(), F.upper(page_host()), F.concat(F.lit("ex%61mple-"), text, F.lit(".com")),
             ((n * 7919 + 65536) % 4294967296).cast("string"), F.concat(F.lit("0x7F."), ((n * 31) % 16777216).cast("string")),
             F.concat(F.lit("0"), F.conv(byte, 10, 8), F.lit(".0.0.1")), F.concat(F.lit("10.0.7."), byte, F.lit(".")),
             F.concat(F.lit("[2001:DB8:0:0:0:0:0:"), F.hex(n % 65535 + 1), F.lit("]")),
             F.concat(F.lit("[::ffff:1.2."), byte, F.lit(".4]")), F.concat(label, F.lit("."), page_host()),
             F.concat(F.lit("\uff25\uff58"), text, F.lit("\u3002com")), F.concat(F.lit("1.2.3."), (n % 100 + 256).cast("string")),
             F.concat(F.lit("ex%20ample"), text)]
    return pages.select("page_id", F.posexplode(F.array(*forms)).alias("form", "host"))


def private_host_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names, 14 per page: its own, and private, public and malformed forms with
    numbers from ``page_id``."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.col("page_id")
    a, b, c = ((n % 256).cast("string"), ((n / 256).cast("long") % 256).cast("string"), (n % 64).cast("string"))
    forms = [page_host(), F.concat(page_host(), F.lit(".INTERNAL")), F.concat(page_host(), F.lit(".local")),
             F.concat(page_host(), F.lit(".locale")), F.lit("LocalHost"), F.concat_ws(".", a, b, c, a),
             F.concat(F.lit("172."), c, F.lit(".0."), a), F.concat(F.lit("192."), a, F.lit(".7."), b),
             F.concat(F.lit("169."), a, F.lit(".1.1")), F.concat(F.lit("10."), (n % 512).cast("string"), F.lit(".0.1")),
             F.concat(F.lit("fd00::"), F.hex(n)), F.concat(F.lit("FE80::"), F.hex(n)),
             F.concat(F.lit("2001:db8::"), F.hex(n)), F.concat(F.lit("10.0."), a)]
    return pages.select("page_id", F.posexplode(F.array(*forms)).alias("form", "host"))


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of local files, one per page, with an extension by ``page_id % 7``."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    ext = F.get(F.array(*[F.lit(x) for x in LOCAL_EXTENSIONS]), (F.col("page_id") % 7).cast("int"))
    return pages.select("page_id", F.concat(F.lit("/srv/mirror/"), F.regexp_extract("url", "//([^?#]*)", 1), ext).alias("path"))


# --- V5: registry ------------------------------------------------------------------

def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: a registry text with one ``slug|label|url`` line per page (slug =
    host, label = page title, url = page url), after a comment header.  Titles
    may contain ``|``, which gives malformed and shifted lines, and hosts
    repeat, which gives duplicate slugs."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = pages.select((F.col("page_id") + 1).cast("int").alias("line_no"),
                        F.concat_ws("|", page_host(), page_title(), F.col("url")).alias("text"))
    header = spark.range(1).select(F.lit(0).alias("line_no"), F.lit("# slug|label|url").alias("text"))
    return header.unionByName(rows)


def source_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs for source resolution, one per page by ``page_id % 4``: the
    upper-cased host (a slug), the title part before any ``|`` padded with
    spaces (a label), the page URL, or a relative path ``docs/<lang>/<page_id>.txt``."""
    from ..functions.text import js_trim
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    v = F.col("page_id") % 4
    label = js_trim(F.regexp_extract(page_title(), r"^([^|]*)", 1))
    lang = F.regexp_extract("url", r"^[A-Za-z]+://[^/]+/([^/?#]+)", 1)
    inp = (F.when(v == 0, F.upper(page_host()))
           .when(v == 1, F.concat(F.lit("  "), label, F.lit(" ")))
           .when(v == 2, F.col("url"))
           .otherwise(F.concat(F.lit("docs/"), lang, F.lit("/"), F.col("page_id").cast("string"), F.lit(".txt"))))
    return pages.select(F.col("page_id").alias("input_id"), inp.alias("input"))


def site_sources(spark: SparkSession, sf_dir: str) -> dict:
    """W2 input: every page host is a source (``https://<host>/llms.txt``)
    installed into the collection of its site (last three labels), in the
    order of its first page.  The site's first host was installed before with
    prefix '' and its pages' first path segments (the language directories)
    exist in the output directory."""
    pages = load_table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = (pages.groupBy(page_domain().alias("collection"), page_host().alias("host"))
             .agg(F.min("page_id").alias("seq")))
    sources = hosts.select("collection", F.concat(F.lit("https://"), F.col("host"), F.lit("/llms.txt"))
                           .alias("source_url"), "seq", F.lit(None).cast("string").alias("slug"),
                           F.lit("https").alias("scheme"), "host", F.lit("/llms.txt").alias("path"))
    w = Window.partitionBy("collection").orderBy("seq")
    first = hosts.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    installs = first.select("collection", F.lit(0).alias("pos"),
                            F.concat(F.lit("https://"), F.col("host"), F.lit("/llms.txt")).alias("source_url"),
                            F.lit("").alias("path_prefix"))
    top = (pages.join(first.select(F.col("collection").alias("c"), F.col("host").alias("h")),
                      (page_domain() == F.col("c")) & (page_host() == F.col("h")), "inner")
           .select(F.col("c").alias("collection"),
                   F.regexp_extract("url", r"^[A-Za-z]+://[^/]+/([^/?#]+)", 1).alias("name"))
           .filter(F.col("name") != "").distinct())
    return {"sources": sources, "installs": installs, "top_level": top}
