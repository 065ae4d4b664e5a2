"""Registry: scans (S1, S2), source resolution (J1, P15), duplicate flags
(A2, J7), safety review (P11-P13, E13-E15), verdict counts (A3) and the
Markdown report lines (P14, S8).

A registry is a ``(line_no, text)`` table of ``slug|label|url`` lines.
Duplicates are counted with a group-by (partial aggregation) and joined back,
not with a window, so one very common slug does not become one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import has_markdown_link, looks_html
from ..functions.text import escape_table, js_trim
from ..functions.urls import hostname, is_private_hostname, is_text_like, parse_urls, percent_encode

# --- fixed values (messages of the reference; the report marker and title
# carry this package's own name) ---------------------------------------------
MSG_MISSING = "Registry line must contain slug, label, and URL."
MSG_DUP_SLUG = "Duplicate slug."
MSG_INVALID = "URL is not valid."
MSG_HTTPS = "Registry URLs must use HTTPS."
MSG_CREDENTIALS = "Registry URLs must not include credentials."
MSG_PRIVATE = "Registry URLs must point to a public hostname."
MSG_DUP_URL = "Duplicate URL already exists in the registry."
MSG_SUFFIX = "URL does not end with llms.txt."
MSG_REDIRECT = "Request redirected to a different hostname."
MSG_LARGE = "Response is larger than 1 MB."
MSG_HTML = "Endpoint returned HTML instead of plain text/markdown."
MSG_NO_LINKS = "Response did not contain any markdown links."
MSG_LOOKS_GOOD = "Looks good."
LARGE_BYTES = 1024 * 1024
REPORT_MARKER = "<!-- mdweave-registry-review -->"
REPORT_TITLE = "## mdweave Registry Review"
REPORT_FOOTER = "This review is automated and should be treated as a safety pre-check, not a trust guarantee."
NOT_IN_SNAPSHOT = "not in snapshot"
# ---------------------------------------------------------------------------


def scan_registry(lines: DataFrame) -> DataFrame:
    """S1 (lenient): trim, skip blank and ``#`` lines, split on ``|``, trim the
    parts, first three parts, missing -> ''.  Adds ``valid`` (S2: all three
    non-empty; the strict scan keeps only those)."""
    t = lines.select("line_no", js_trim("text").alias("__l"))
    t = t.filter((F.col("__l") != "") & ~F.col("__l").startswith("#"))
    parts = F.split("__l", r"\|")

    def part(i):
        return F.coalesce(js_trim(F.get(parts, i)), F.lit(""))

    out = t.select("line_no", part(0).alias("slug"), part(1).alias("label"), part(2).alias("url"))
    return out.withColumn("valid", (F.col("slug") != "") & (F.col("label") != "") & (F.col("url") != ""))


def strict_registry(lines: DataFrame) -> DataFrame:
    """S2 rows (rejects = ``valid = false``); T1 order is ``label_order()``."""
    return scan_registry(lines).filter("valid").drop("valid")


def label_order():
    """Locale order of labels (ICU root collation), then line number."""
    return [F.collate("label", "UNICODE"), F.col("line_no")]


def resolve_sources(inputs: DataFrame, registry: DataFrame, base_dir: str) -> DataFrame:
    """J1 + P15 for ``inputs(input_id, input)`` against the strict registry.

    Registry hit (trimmed lower-cased input equals the lower-cased slug or
    label; never for inputs that look like paths): first entry in label order,
    label ``Label (slug)``.  Else an absolute http(s) URL.  Else a local path
    resolved against ``base_dir`` (a parameter, not the process directory).
    The registry is reduced to its first entry per lower-cased slug and per
    lower-cased label before two equi-joins, so an input has at most two hits.
    Output: input_id, input, kind, slug, label, url, local_root_dir.
    """
    norm = F.lower(js_trim("input"))
    # Inputs that look like paths never match the registry
    looks_path = (F.col("input").contains("/") | F.col("input").contains(":")
                  | F.col("input").startswith(".") | F.col("input").startswith("~"))
    cand = inputs.withColumn("__key", F.when(~looks_path, norm))
    reg = registry.select("line_no", "slug", "label", F.col("url").alias("reg_url"))
    entry = F.struct("line_no", "slug", "label", "reg_url")

    def first_by(column):
        return (reg.groupBy(F.lower(column).alias("__key")).agg(F.min_by(entry, F.struct(*label_order())).alias("e"))
                .select("__key", "e.*"))

    hits = cand.join(first_by("slug"), "__key", "inner").unionByName(cand.join(first_by("label"), "__key", "inner"))
    first = (hits.groupBy("input_id").agg(F.min_by(entry, F.struct(*label_order())).alias("e"))
             .select("input_id", "e.slug", "e.label", "e.reg_url"))
    df = inputs.join(first, "input_id", "left")
    df = parse_urls(df, "reg_url", "__reg")
    df = parse_urls(df, "input", "__in")
    def with_fragment(parts, raw):
        # WHATWG href keeps the fragment (fragment percent-encode set)
        frag = percent_encode(f"regexp_extract(`{raw}`, '#(.*)$', 1)", r'[^\x21-\x7E]|["<>`]')
        return F.concat(F.col(parts + ".href"),
                        F.when(F.col(raw).contains("#"), F.concat(F.lit("#"), frag)).otherwise(F.lit("")))

    in_href = with_fragment("__in", "input")
    reg_href = F.when(F.col("__reg.status").isin("ok", "unsupported"), with_fragment("__reg", "reg_url"))
    is_url = F.col("__in.status").isin("ok") & F.col("__in.scheme").isin("http", "https")
    # path.resolve: absolute input as is, else under base_dir; dot segments
    # removed by the URL parse; trailing slashes dropped
    joined = F.when(F.col("input").startswith("/"), F.col("input")).otherwise(
        F.concat(F.lit(base_dir.rstrip("/") + "/"), F.col("input")))
    df = df.withColumn("__abs", F.concat(F.lit("file://"), joined))
    df = parse_urls(df, "__abs", "__file")
    enc_path = F.when(F.col("__file.path") == "/", F.col("__file.path")) \
        .otherwise(F.regexp_replace(F.col("__file.path"), "/+$", ""))
    abs_norm = F.expr("try_url_decode(replace(`__file`.path, '+', '%2B'))")
    abs_norm = F.when(abs_norm == "/", abs_norm).otherwise(F.regexp_replace(abs_norm, "/+$", ""))
    dirname = F.when(F.regexp_replace(abs_norm, "/[^/]*$", "") == "", F.lit("/")) \
        .otherwise(F.regexp_replace(abs_norm, "/[^/]*$", ""))
    reg_root = F.expr("try_url_decode(replace(`__reg`.path, '+', '%2B'))")
    reg_dir = F.when(F.regexp_replace(reg_root, "/[^/]*$", "") == "", F.lit("/")) \
        .otherwise(F.regexp_replace(reg_root, "/[^/]*$", ""))
    kind = (F.when(F.col("reg_url").isNotNull(), F.lit("registry"))
            .when(is_url, F.lit("url")).otherwise(F.lit("path")))
    return df.select(
        "input_id", "input", kind.alias("kind"),
        F.when(kind == "registry", F.col("slug")).alias("slug"),
        F.when(kind == "registry", F.concat(F.col("label"), F.lit(" ("), F.col("slug"), F.lit(")")))
        .when(kind == "url", in_href).otherwise(abs_norm).alias("label"),
        F.when(kind == "registry", reg_href).when(kind == "url", in_href)
        .otherwise(F.concat(F.lit("file://"), enc_path)).alias("url"),
        F.when(kind == "registry", F.when(F.col("__reg.scheme") == "file", reg_dir))
        .when(kind == "path", dirname).alias("local_root_dir"),
    )


def duplicate_flags(registry: DataFrame) -> DataFrame:
    """A2 + J7: flag every row whose lower-cased slug / URL occurs more than
    once (first occurrence and empty keys included)."""
    slugs = (registry.groupBy(F.lower("slug").alias("__s")).count()
             .filter("count > 1").select("__s", F.lit(True).alias("duplicate_slug")))
    urls = (registry.groupBy(F.lower("url").alias("__u")).count()
            .filter("count > 1").select("__u", F.lit(True).alias("duplicate_url")))
    out = (registry.withColumn("__s", F.lower("slug")).withColumn("__u", F.lower("url"))
           .join(slugs, "__s", "left").join(urls, "__u", "left"))
    return (out.withColumn("duplicate_slug", F.coalesce("duplicate_slug", F.lit(False)))
            .withColumn("duplicate_url", F.coalesce("duplicate_url", F.lit(False)))
            .drop("__s", "__u"))


def _msgs(*pairs):
    return F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in pairs]), lambda x: x.isNotNull())


def static_review(registry: DataFrame) -> DataFrame:
    """P11 on the lenient registry (with duplicate flags): issues and warnings
    arrays in the reference's order; the four URL rules need a parsable URL."""
    d = parse_urls(duplicate_flags(registry), "url", "__p")
    parsed = F.col("__p.status").isin("ok", "unsupported")
    opaque_path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"[?#].*$", "")
    path = F.coalesce(F.col("__p.path"), opaque_path)
    host = hostname(F.coalesce(F.col("__p.host"), F.lit("")))
    missing = (F.col("slug") == "") | (F.col("label") == "") | (F.col("url") == "")
    issues = F.concat(
        _msgs((missing, MSG_MISSING), (F.col("duplicate_slug"), MSG_DUP_SLUG), (~parsed, MSG_INVALID)),
        F.when(parsed, _msgs((F.col("__p.scheme") != "https", MSG_HTTPS),
                             (F.coalesce(F.col("__p.userinfo"), F.lit("")) != "", MSG_CREDENTIALS),
                             (is_private_hostname(host), MSG_PRIVATE)))
        .otherwise(F.array().cast("array<string>")))
    warnings = F.concat(
        _msgs((F.col("duplicate_url"), MSG_DUP_URL)),
        F.when(parsed, _msgs((~F.lower(path).endswith("llms.txt"), MSG_SUFFIX)))
        .otherwise(F.array().cast("array<string>")))
    return (d.withColumn("issues", issues).withColumn("warnings", warnings)
            .withColumn("parsed_href", F.when(parsed, F.col("__p.href")))
            .withColumn("parsed_host", F.when(parsed, host))
            .drop("__p"))


def review(registry: DataFrame, resources: DataFrame) -> DataFrame:
    """P11 + P12 + P13: static rules, then -- only for entries without issues --
    a left join with the crawl snapshot on the parsed href and the
    fetched-resource rules.  Output per registry row: slug, label, url,
    final_url, status_code, content_type, content_length, issues, warnings,
    notes, verdict."""
    s = static_review(registry)
    res = resources.select(F.col("url").alias("parsed_href"), F.col("ok").alias("r_ok"),
                           F.col("http_status").alias("r_status"), F.col("content_type").alias("r_type"),
                           F.col("content_length").alias("r_len"), F.col("final_url").alias("r_final"),
                           F.col("error").alias("r_error"),
                           # what the rules need of the body; the body itself stays out of the shuffle
                           F.length("body").cast("long").alias("r_body_len"), looks_html(F.col("body")).alias("r_html"),
                           has_markdown_link(F.col("body")).alias("r_links"))
    # one row per URL: an ok one first, then the first by its values
    values = [c for c in res.columns if c != "parsed_href"]
    rank = F.struct((~F.col("r_ok")).alias("failed"), *(c for c in values if c != "r_ok"))
    res = res.groupBy("parsed_href").agg(F.min_by(F.struct(*values), rank).alias("__r")).select("parsed_href", "__r.*")
    probe = s.withColumn("__fetch", F.size("issues") == 0)
    # an entry with issues has a key of its own that no URL is equal to: it finds nothing, and they don't meet in one task
    key = F.when(F.col("__fetch"), F.col("parsed_href")).otherwise(F.concat(F.lit("none "), F.col("line_no").cast("string")))
    d = probe.withColumn("__key", key).join(res.withColumnRenamed("parsed_href", "__key"), "__key", "left").drop("__key")
    fetched = F.col("__fetch") & F.col("r_ok").isNotNull()
    ok = fetched & F.col("r_ok")
    header_len = F.when(fetched, F.coalesce(F.col("r_len"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    eff = F.when(header_len > 0, header_len).otherwise(F.col("r_body_len"))
    final_host = F.expr("regexp_extract(r_final, '^[A-Za-z][A-Za-z0-9+.\\\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)")
    ctype = F.coalesce(F.col("r_type"), F.lit(""))
    fetch_issue = (F.when(F.col("__fetch") & F.col("r_ok").isNull(), F.lit(NOT_IN_SNAPSHOT))
                   .when(fetched & ~F.col("r_ok") & F.col("r_error").isNotNull(), F.col("r_error"))
                   .when(fetched & ~F.col("r_ok"), F.concat(F.lit("Fetch failed with HTTP "),
                                                             F.col("r_status").cast("string"), F.lit(".")))
                   .when(ok & ~is_text_like(ctype),
                         F.concat(F.lit("Unexpected content type: "),
                                  F.when(ctype == "", F.lit("unknown")).otherwise(ctype), F.lit("."))))
    issues = F.concat(F.col("issues"), F.filter(F.array(fetch_issue), lambda x: x.isNotNull()))
    warnings = F.concat(F.col("warnings"), F.when(ok, _msgs(
        (F.lower(final_host) != F.col("parsed_host"), MSG_REDIRECT),
        (eff > LARGE_BYTES, MSG_LARGE),
        (F.col("r_html"), MSG_HTML),
        (~F.col("r_links"), MSG_NO_LINKS))).otherwise(F.array().cast("array<string>")))
    notes = F.when(ok, F.array(F.concat(F.lit("Fetched "), F.format_number(eff, 0), F.lit(" bytes."))))\
        .otherwise(F.array().cast("array<string>"))
    d = d.withColumn("issues", issues).withColumn("warnings", warnings).withColumn("notes", notes)
    verdict = (F.when(F.size("issues") > 0, F.lit("unsafe"))
               .when(F.size("warnings") > 0, F.lit("needs-review")).otherwise(F.lit("safe")))
    return d.select(
        "line_no", "slug", "label", "url",
        # after a transport error the entry's own URL stays
        F.when(fetched & (F.col("r_ok") | F.col("r_error").isNull()), F.coalesce(F.col("r_final"), F.col("parsed_href")))
        .otherwise(F.col("url")).alias("final_url"),
        F.when(fetched, F.coalesce(F.col("r_status"), F.lit(0))).otherwise(F.lit(0)).cast("int").alias("status_code"),
        F.when(fetched, ctype).otherwise(F.lit("")).alias("content_type"),
        header_len.alias("content_length"),
        "issues", "warnings", "notes", verdict.alias("verdict"))


def verdict_counts(reviewed: DataFrame) -> DataFrame:
    """A3: one row, all three verdicts present (zero-filled by construction)."""
    return reviewed.agg(
        F.count_if(F.col("verdict") == "safe").alias("safe"),
        F.count_if(F.col("verdict") == "needs-review").alias("needs_review"),
        F.count_if(F.col("verdict") == "unsafe").alias("unsafe"))


def report_lines(reviewed: DataFrame) -> DataFrame:
    """P14 + S8 as a line table (section, ord, sub, line); only this final
    small report is ever ordered (``orderBy('section', 'ord', 'sub')``)."""
    counts = verdict_counts(reviewed)
    head = counts.select(F.explode(F.array(
        *[F.struct(F.lit(i).alias("ord"), x.alias("line")) for i, x in enumerate([
            F.lit(REPORT_MARKER), F.lit(REPORT_TITLE), F.lit(""),
            F.concat(F.lit("- Safe: "), F.col("safe").cast("string")),
            F.concat(F.lit("- Needs review: "), F.col("needs_review").cast("string")),
            F.concat(F.lit("- Unsafe: "), F.col("unsafe").cast("string")),
            F.lit(""), F.lit("| Slug | Verdict | Status | Notes |"), F.lit("| --- | --- | --- | --- |")])]))
        .alias("x")).select(F.lit(0).alias("section"), F.col("x.ord").cast("long").alias("ord"),
                            F.lit(0).alias("sub"), F.col("x.line").alias("line"))
    detail = F.array_join(F.concat("issues", "warnings", "notes"), " ")
    detail = F.when(detail == "", F.lit(MSG_LOOKS_GOOD)).otherwise(detail)
    status = F.when(F.col("status_code") != 0, F.col("status_code").cast("string")).otherwise(F.lit("n/a"))
    rows = reviewed.select(
        F.lit(1).alias("section"), F.col("line_no").cast("long").alias("ord"), F.lit(0).alias("sub"),
        F.concat(F.lit("| "), F.col("slug"), F.lit(" | "), F.col("verdict"), F.lit(" | "), status, F.lit(" | "),
                 escape_table(detail), F.lit(" |")).alias("line"))
    mid = counts.select(F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("").alias("line")),
        F.struct(F.lit(1).alias("ord"), F.lit("### Checked URLs").alias("line")),
        F.struct(F.lit(2).alias("ord"), F.lit("").alias("line")))).alias("x")) \
        .select(F.lit(2).alias("section"), F.col("x.ord").cast("long").alias("ord"), F.lit(0).alias("sub"),
                F.col("x.line").alias("line"))
    checked = reviewed.select(
        F.lit(3).alias("section"), F.col("line_no").cast("long").alias("ord"),
        F.explode(F.filter(F.array(
            F.struct(F.lit(0).alias("sub"), F.concat(F.lit("- "), F.col("slug"), F.lit(": "), F.col("url")).alias("line")),
            F.when(F.col("final_url").isNotNull() & (F.col("final_url") != "") & (F.col("final_url") != F.col("url")),
                   F.struct(F.lit(1).alias("sub"), F.concat(F.lit("- Final URL for "), F.col("slug"), F.lit(": "),
                                                           F.col("final_url")).alias("line")))),
            lambda x: x.isNotNull())).alias("x")).select("section", "ord", F.col("x.sub").alias("sub"),
                                                          F.col("x.line").alias("line"))
    tail = counts.select(F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("").alias("line")),
        F.struct(F.lit(1).alias("ord"), F.lit(REPORT_FOOTER).alias("line")))).alias("x")) \
        .select(F.lit(4).alias("section"), F.col("x.ord").cast("long").alias("ord"), F.lit(0).alias("sub"),
                F.col("x.line").alias("line"))
    return head.unionByName(rows).unionByName(mid).unionByName(checked).unionByName(tail)
