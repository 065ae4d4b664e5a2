"""DuckDB oracle SQL for the registered queries.

Each query is written independently of the Spark code, as plain SQL over the
driver's pre-registered views (``pages``, ``documents``, ...).  The derived
inputs (SURVEY 7.3 V1-V6) are CTEs with the same definitions as
``plans/views.py``.  The URL resolution here covers the reference forms that
occur in the derived inputs (absolute http(s) URLs, root-relative and
path-relative references, queries, fragments, non-ASCII paths, ``mailto:``
and a broken host); the full resolver is covered by unit tests.

Python only assembles strings; every value is computed by DuckDB.
"""

from __future__ import annotations

from ..functions.text import WS
from .views import MANIFEST_FORMS

# --- fixed values (same as plans/views.py) ----------------------------------
LOG_RUNS = 4
CRAWL_INDEX_URL = "https://crawl.example.org/llms.txt"
EXTRA_LINE_BASE = 1_000_000_000
LOCAL_EXTENSIONS = (".html", ".HTM", ".md", ".MDX", ".markdown", ".txt", "")
# ---------------------------------------------------------------------------


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def jtrim_end(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '', 'g')"


def enc(x: str, charset: str) -> str:
    """Per-character UTF-8 percent-encoding of the characters in ``charset``."""
    return (f"CASE WHEN regexp_matches({x}, '{charset}') THEN array_to_string(list_transform("
            f"string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '{charset}') THEN url_encode(c) "
            f"ELSE c END), '') ELSE {x} END")


PATH_SET = r"""[^\x21-\x7E]|["<>`{}]"""
QUERY_SET = r"""[^\x21-\x7E]|["<>'']"""


def sanitize(x: str) -> str:
    """E3 on ASCII / already folded text."""
    s = f"regexp_replace({x}, '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"
    s = f"regexp_replace({s}, '%[0-9A-Fa-f]{{2}}', '-', 'g')"
    s = f"regexp_replace({s}, '[^A-Za-z0-9._-]+', '-', 'g')"
    s = f"regexp_replace({s}, '-+', '-', 'g')"
    s = f"regexp_replace({s}, '^[-._]+|[-._]+$', '', 'g')"
    return f"lower({s})"


def strip_ext(x: str) -> str:
    return f"regexp_replace({x}, '(?i)(\\.html\\.md|\\.md|\\.markdown|\\.mdx|\\.html|\\.htm)$', '')"


# --- derived inputs ----------------------------------------------------------

V1_INDEX = """
v1_index AS (
  SELECT url AS source_url,
         array_to_string(list_transform(
            regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'),
            lambda a: regexp_replace(a, '<a href="([^"]*)">([^<]*)</a>', '- [\\2](\\1)')), chr(10)) AS body
  FROM pages
),
v1_lines AS (
  SELECT source_url, CAST(generate_subscripts(arr, 1) - 1 AS BIGINT) AS line_pos, unnest(arr) AS line
  FROM (SELECT source_url, string_split_regex(body, '\\r?\\n') AS arr FROM v1_index)
)"""

PAGE_DOMAIN = "regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '([^.]+\\.[^.]+\\.[^.]+)$', 1)"
PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"

V2_LINES = f"""
v2_lines AS (
  SELECT 'https://' || {PAGE_DOMAIN} || '/llms.txt' AS source_url,
         CAST(page_id + 1 AS BIGINT) AS line_pos,
         '- [' || {PAGE_TITLE} || '](' || url || ')' AS line
  FROM pages
  UNION ALL
  SELECT 'https://' || domain || '/llms.txt', CAST(x.p AS BIGINT), x.l
  FROM (
    SELECT domain, unnest([
      {{'p': 0, 'l': '# ' || domain}},
      {{'p': {EXTRA_LINE_BASE + 1}, 'l': '- [Contact](mailto:docs@' || domain || ')'}},
      {{'p': {EXTRA_LINE_BASE + 2}, 'l': '- [Broken](http://[)'}},
      {{'p': {EXTRA_LINE_BASE + 3}, 'l': '- [Again](<' || first_url || '> "first page again")'}}
    ]) AS x
    FROM (SELECT {PAGE_DOMAIN} AS domain, arg_min(url, page_id) AS first_url FROM pages GROUP BY 1)
  )
)"""

V2B_LINES = f"""
v2b_lines AS (
  SELECT '{CRAWL_INDEX_URL}' AS source_url, CAST(page_id + 1 AS BIGINT) AS line_pos,
         '- [' || {PAGE_TITLE} || '](' || url || ')' AS line
  FROM pages
)"""


def links_ctes(lines_table: str, prefix: str = "") -> str:
    """extract (P1, E1) and resolve (P2, E2) over a (source_url, line_pos, line) CTE."""
    p = prefix
    h1 = jtrim("raw_href")
    return f"""
{p}matches AS (
  SELECT source_url, line_pos,
         CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS match_pos,
         unnest(t) AS t1, unnest(h) AS raw_href
  FROM (SELECT source_url, line_pos,
               regexp_extract_all(line, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 1) AS t,
               regexp_extract_all(line, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2) AS h
        FROM {lines_table} WHERE contains(line, ']('))
),
{p}norm1 AS (
  SELECT source_url, line_pos, match_pos, {jtrim('t1')} AS title, raw_href, {h1} AS h1 FROM {p}matches
),
{p}norm2 AS (
  SELECT *, CASE WHEN starts_with(h1, '<') AND ends_with(h1, '>') AND length(h1) >= 2
                 THEN {jtrim("substr(h1, 2, length(h1) - 2)")} ELSE h1 END AS h2
  FROM {p}norm1
),
{p}extracted AS (
  SELECT source_url, line_pos, match_pos, title, raw_href,
         CASE WHEN regexp_matches(h2, '^([^{WS}]+)[{WS}]+["''][^"'']+["'']$')
              THEN regexp_extract(h2, '^([^{WS}]+)[{WS}]+["''][^"'']+["'']$', 1) ELSE h2 END AS href_in
  FROM {p}norm2
),
{p}parsed AS (
  SELECT *,
    regexp_matches(href_in, '^[A-Za-z][A-Za-z0-9+.-]*:') AS has_scheme,
    lower(regexp_extract(href_in, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS r_scheme,
    lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS b_scheme,
    lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#]*)', 1)) AS b_host,
    regexp_extract(source_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS b_path,
    CASE WHEN regexp_matches(source_url, '^[^#]*\\?') THEN regexp_extract(source_url, '^[^?#]*\\?([^#]*)', 1) END AS b_query
  FROM {p}extracted WHERE href_in <> ''
),
{p}parts AS (
  SELECT *,
    CASE WHEN has_scheme THEN r_scheme ELSE b_scheme END AS scheme,
    CASE WHEN has_scheme THEN lower(regexp_extract(href_in, '^[A-Za-z]+://([^/?#]*)', 1)) ELSE b_host END AS host0,
    CASE WHEN has_scheme THEN regexp_extract(href_in, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)
         WHEN starts_with(href_in, '/') THEN regexp_extract(href_in, '^([^?#]*)', 1)
         WHEN regexp_extract(href_in, '^([^?#]*)', 1) = '' THEN b_path
         ELSE regexp_replace(b_path, '[^/]*$', '') || regexp_extract(href_in, '^([^?#]*)', 1) END AS path0,
    CASE WHEN regexp_matches(href_in, '^[^#]*\\?') THEN regexp_extract(href_in, '^[^?#]*\\?([^#]*)', 1)
         WHEN NOT has_scheme AND regexp_extract(href_in, '^([^?#]*)', 1) = '' THEN b_query END AS query0
  FROM {p}parsed
),
{p}resolved AS (
  SELECT source_url, line_pos, match_pos, title, raw_href, href_in,
    CASE WHEN has_scheme AND r_scheme NOT IN ('http', 'https', 'file', 'ws', 'wss', 'ftp') THEN 'unsupported'
         WHEN host0 = '' OR regexp_matches(host0, '[\\x00-\\x20#%/<>?@\\[\\\\\\]^|]') THEN 'invalid'
         WHEN scheme NOT IN ('http', 'https', 'file') THEN 'unsupported'
         ELSE 'ok' END AS status,
    scheme, host0 AS host,
    {enc("CASE WHEN path0 = '' THEN '/' ELSE path0 END", PATH_SET)} AS path,
    {enc('query0', QUERY_SET)} AS query
  FROM {p}parts
),
{p}links AS (
  SELECT *, CASE WHEN status = 'ok'
                 THEN scheme || '://' || host || path || coalesce('?' || query, '')
                 WHEN status = 'unsupported' AND has_scheme_opaque THEN regexp_replace(href_in, '#.*$', '')
                 ELSE regexp_replace(href_in, '#.*$', '') END AS href
  FROM (SELECT *, true AS has_scheme_opaque FROM {p}resolved)
)"""


def all_lines_cte() -> str:
    return f"""{V1_INDEX},
{V2_LINES},
all_lines AS (SELECT * FROM v1_lines UNION ALL SELECT * FROM v2_lines)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def q_extract_links() -> str:
    return _with(all_lines_cte(), links_ctes("all_lines")) + """
SELECT source_url, line_pos, match_pos, title, raw_href, href_in FROM extracted WHERE href_in <> ''"""


def q_resolve_links() -> str:
    return _with(all_lines_cte(), links_ctes("all_lines")) + """
SELECT source_url, line_pos, match_pos, title, href, scheme, host, path, query
FROM links WHERE status = 'ok'"""


def q_link_rejects() -> str:
    return _with(all_lines_cte(), links_ctes("all_lines")) + """
SELECT source_url, line_pos, match_pos, status, href FROM links WHERE status IN ('invalid', 'unsupported')"""


DEDUPE = """
dedup AS (
  SELECT source_url, href,
         CAST(min(line_pos * 1000000 + match_pos) AS BIGINT) AS ordkey,
         arg_min(struct_pack(line_pos := line_pos, match_pos := match_pos, title := title, host := host),
                 line_pos * 1000000 + match_pos) AS f,
         count(*) AS occurrences
  FROM links WHERE status = 'ok' GROUP BY source_url, href
),
unique_links AS (
  SELECT source_url, href, f.line_pos AS line_pos, f.match_pos AS match_pos, f.title AS title,
         f.host AS host, occurrences FROM dedup
)"""

POLICY = """
policy AS (
  SELECT u.*,
         (lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https'))
         OR lower(host) = lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS allowed
  FROM unique_links u
)"""


def q_dedupe_links() -> str:
    return _with(all_lines_cte(), links_ctes("all_lines"), DEDUPE) + """
SELECT source_url, href, line_pos, match_pos, title, occurrences FROM unique_links"""


def q_host_policy() -> str:
    return _with(all_lines_cte(), links_ctes("all_lines"), DEDUPE, POLICY) + """
SELECT source_url, href, line_pos, match_pos, host, allowed FROM policy"""


def q_blocked_hosts() -> str:
    return _with(all_lines_cte(), links_ctes("all_lines"), DEDUPE, POLICY) + """
SELECT source_url, host, count(*) AS blocked_links FROM policy
WHERE NOT allowed AND host IS NOT NULL GROUP BY source_url, host"""


def q_link_stats() -> str:
    return _with(all_lines_cte(), links_ctes("all_lines"), DEDUPE, POLICY) + """
SELECT f.source_url, f.links_found, p.unique_urls, p.selected_docs, p.blocked_docs,
       p.blocked_hosts
FROM (SELECT source_url, count(*) AS links_found FROM links WHERE status = 'ok' GROUP BY 1) f
LEFT JOIN (SELECT source_url, count(*) AS unique_urls, count_if(allowed) AS selected_docs,
                  count_if(NOT allowed) AS blocked_docs,
                  count(DISTINCT host) FILTER (WHERE NOT allowed) AS blocked_hosts
           FROM policy GROUP BY 1) p USING (source_url)"""


def site_selected_ctes() -> str:
    """V2 link pipeline up to the allowed unique links (entries to fetch)."""
    return f"""{V2_LINES},
{links_ctes("v2_lines", "s_").strip()},
s_unique AS (
  SELECT source_url, href,
         arg_min(struct_pack(line_pos := line_pos, match_pos := match_pos, title := title, host := host,
                             path := path, query := query), line_pos * 1000000 + match_pos) AS f
  FROM s_links WHERE status = 'ok' GROUP BY source_url, href
),
sel AS (
  SELECT source_url, href, f.line_pos AS line_pos, f.match_pos AS match_pos, f.title AS title,
         f.path AS path, f.query AS query
  FROM s_unique
  WHERE lower(f.host) = lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#:]*)', 1))
)"""


CANDIDATES = """
cand0 AS (
  SELECT *, regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin,
         CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END AS trimmed,
         coalesce('?' || query, '') AS qs
  FROM sel
),
cand_raw AS (
  SELECT source_url, href, line_pos, match_pos, unnest(lst) AS candidate_url, generate_subscripts(lst, 1) AS k
  FROM (SELECT *, [href,
                   CASE WHEN length(trimmed) > 1 THEN origin || trimmed || '.md' || qs END,
                   origin || CASE WHEN ends_with(path, '/') THEN path || 'index.md' ELSE path || '/index.md' END || qs,
                   CASE WHEN length(trimmed) > 1 THEN origin || trimmed || '.html.md' || qs END] AS lst
        FROM cand0)
),
cands AS (
  SELECT source_url, href, line_pos, match_pos, candidate_url,
         CAST(row_number() OVER (PARTITION BY source_url, href ORDER BY min(k)) - 1 AS INTEGER) AS rank
  FROM cand_raw WHERE candidate_url IS NOT NULL
  GROUP BY source_url, href, line_pos, match_pos, candidate_url
)"""

RESOURCES = """
res_pages AS (
  SELECT page_id, html, regexp_replace(url, '#.*$', '') AS href FROM pages
),
res_parts AS (
  SELECT *, regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin,
         CASE WHEN regexp_extract(href, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
              ELSE regexp_extract(href, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END AS path,
         CASE WHEN contains(href, '?') THEN '?' || regexp_extract(href, '\\?(.*)$', 1) ELSE '' END AS qs
  FROM res_pages
),
resources AS (
  SELECT CASE page_id % 5
           WHEN 0 THEN href
           WHEN 1 THEN origin || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || '.md' || qs
           WHEN 2 THEN origin || CASE WHEN ends_with(path, '/') THEN path || 'index.md' ELSE path || '/index.md' END || qs
           WHEN 3 THEN origin || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || '.html.md' || qs
           ELSE href END AS url,
         page_id % 5 <> 4 AS ok,
         CAST(CASE WHEN page_id % 5 <> 4 THEN 200 WHEN page_id % 2 = 0 THEN 404 END AS INTEGER) AS http_status,
         CASE WHEN page_id % 5 <> 4 THEN 'OK' WHEN page_id % 2 = 0 THEN 'Not Found' END AS status_text,
         CASE WHEN page_id % 5 <> 4 THEN CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN ''
                                               ELSE 'application/octet-stream' END END AS content_type,
         CASE WHEN page_id % 5 = 4 AND page_id % 2 = 1 THEN 'socket hang up' END AS error,
         CASE WHEN page_id % 5 <> 4 THEN html END AS body,
         CASE WHEN page_id % 5 <> 4 THEN CAST(length(html) AS BIGINT) END AS content_length
  FROM res_parts
),
resources_f AS (SELECT *, CASE WHEN ok THEN url END AS final_url FROM resources)"""

FIRST_SUCCESS = """
probe AS (
  SELECT c.*, r.ok AS res_ok,
         CASE WHEN NOT r.ok THEN coalesce(r.error, 'HTTP ' || CAST(r.http_status AS VARCHAR) || ' ' || coalesce(r.status_text, '')) END AS res_reason
  FROM cands c LEFT JOIN resources r ON r.url = c.candidate_url
),
fs0 AS (
  SELECT source_url, href, line_pos, match_pos,
         bool_or(coalesce(res_ok, false)) AS ok,
         arg_min(candidate_url, rank) FILTER (WHERE coalesce(res_ok, false)) AS fetched_url,
         min(rank) FILTER (WHERE coalesce(res_ok, false)) AS rank,
         string_agg(candidate_url || ' (' || coalesce(res_reason, 'not in snapshot') || ')', '; ' ORDER BY rank) AS all_reasons
  FROM probe GROUP BY source_url, href, line_pos, match_pos
),
fs AS (
  SELECT source_url, href, line_pos, match_pos, ok, fetched_url, rank,
         CASE WHEN NOT ok THEN all_reasons END AS reason,
         CASE WHEN ok AND fetched_url <> href THEN fetched_url WHEN ok THEN '' END AS via
  FROM fs0
)"""


def q_candidate_urls() -> str:
    return _with(site_selected_ctes(), CANDIDATES) + """
SELECT source_url, href, rank, candidate_url FROM cands"""


def q_first_success() -> str:
    return _with(site_selected_ctes(), CANDIDATES, RESOURCES, FIRST_SUCCESS) + """
SELECT source_url, href, line_pos, match_pos, ok, fetched_url, via, rank FROM fs"""


def q_fetch_failures() -> str:
    return _with(site_selected_ctes(), CANDIDATES, RESOURCES, FIRST_SUCCESS) + """,
failed AS (SELECT * FROM fs WHERE NOT ok),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_url ORDER BY line_pos, match_pos) AS INTEGER) AS failure_rank
           FROM failed),
tot AS (SELECT source_url, count(*) AS failed_total FROM failed GROUP BY 1)
SELECT r.source_url, href, line_pos, match_pos, reason, failure_rank, failed_total,
       greatest(failed_total - 5, 0) AS more
FROM ranked r JOIN tot USING (source_url) WHERE failure_rank <= 5"""


# --- content ---------------------------------------------------------------------

def _ws_ltrim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+', '')"


URL_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?([^?#]*)', 2)"

FETCHED = f"""
v4 AS (
  SELECT 'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
         CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN '' ELSE 'text/html' END AS content_type,
         text AS body
  FROM documents
),
fetched AS (
  SELECT url, content_type, body FROM resources WHERE ok
  UNION ALL SELECT url, content_type, body FROM v4
),
classified AS (
  SELECT url, content_type, body,
    CASE WHEN {jtrim('body')} = '' THEN 'empty'
         WHEN contains(lower(content_type), 'text/html') OR contains(lower(content_type), 'application/xhtml+xml')
              OR regexp_matches(lower({URL_PATH}), '\\.html?$')
              OR regexp_matches({_ws_ltrim('substr(body, 1, 2000)')}, '(?i)^(<!doctype html|<html[{WS}>])')
              OR regexp_matches({_ws_ltrim('substr(body, 1, 2000)')}, '(?i)<(head|body|article|main)[{WS}>]')
              THEN 'html'
         WHEN contains(lower(content_type), 'markdown') OR starts_with(lower(content_type), 'text/plain')
              OR regexp_matches(lower({URL_PATH}), '\\.(md|markdown|mdx)$')
              OR regexp_matches(substr(body, 1, 2000),
                   '(?m)^#{{1,6}}[{WS}]|^[-*+][{WS}]|^[0-9]+\\.[{WS}]|^>[{WS}]|\\[[^\\]]+\\]\\([^)]+\\)')
              THEN 'markdown'
         ELSE 'unsupported' END AS kind
  FROM fetched
)"""


def q_classify_content() -> str:
    return _with(RESOURCES, FETCHED) + """
SELECT url, kind FROM classified"""


def q_markdown_docs() -> str:
    return _with(RESOURCES, FETCHED) + f""",
md AS (
  SELECT url, kind, CASE WHEN kind = 'markdown' THEN {jtrim_end('body')} END AS c0 FROM classified WHERE kind <> 'html'
),
md2 AS (
  SELECT url, kind, CASE WHEN c0 <> '' THEN CASE WHEN ends_with(c0, chr(10)) THEN c0 ELSE c0 || chr(10) END END AS content
  FROM md
)
SELECT url, kind, content IS NOT NULL AS ok, sha256(content) AS content_sha,
       CASE WHEN content IS NULL THEN 'unsupported content received from ' || url END AS reason
FROM md2"""


# --- paths -------------------------------------------------------------------------

def _or(x: str, fb: str) -> str:
    return f"coalesce(nullif({x}, ''), {fb})"


def _dirs_file(segs: str, ends_slash: str, stem_fb: str) -> str:
    all_dirs = f"list_transform({segs}, lambda s: {_or(sanitize('s'), chr(39) + 'section' + chr(39))})"
    dirs = (f"list_transform({segs}[1:len({segs}) - 1], "
            f"lambda s: {_or(sanitize('s'), chr(39) + 'section' + chr(39))})")
    stem = _or(sanitize(strip_ext(f"{segs}[len({segs})]")), stem_fb)
    return (f"CASE WHEN {ends_slash} THEN array_to_string(list_concat({all_dirs}, ['index.md']), '/') "
            f"ELSE array_to_string(list_concat({dirs}, [{stem} || '.md']), '/') END")


def _segs(x: str) -> str:
    return f"list_filter(string_split({x}, '/'), lambda s: s <> '')"


def remote_path(path: str, title_clean: str) -> str:
    return (f"CASE WHEN len({_segs(path)}) = 0 THEN 'index.md' ELSE "
            f"{_dirs_file(_segs(path), f'ends_with({path}, chr(47))', _or(title_clean, chr(39) + 'index' + chr(39)))} END")


def url_slug(scheme: str, host: str, path: str) -> str:
    parts = f"list_filter(list_transform({_segs(path)}, lambda s: {sanitize(strip_ext('s'))}), lambda s: s <> '')"
    with_host = f"CASE WHEN {scheme} IN ('http', 'https') THEN list_concat([{host}], {parts}) ELSE {parts} END"
    return f"CASE WHEN len({with_host}) = 0 THEN 'index' ELSE array_to_string({with_host}, '-') END"


def flat_name(title_clean: str, scheme: str, host: str, path: str) -> str:
    return f"{_or(title_clean, sanitize(url_slug(scheme, host, path)))} || '.md'"


def title_clean(x: str) -> str:
    return sanitize(f"strip_accents({x})")


def crawl_entries_ctes() -> str:
    return f"""{V2B_LINES},
{links_ctes("v2b_lines", "c_").strip()},
crawl_entries AS (
  SELECT source_url, href, f.line_pos AS line_pos, f.match_pos AS match_pos, f.title AS title,
         f.scheme AS scheme, f.host AS host, f.path AS path
  FROM (SELECT source_url, href,
               arg_min(struct_pack(line_pos := line_pos, match_pos := match_pos, title := title,
                                   scheme := scheme, host := host, path := path),
                       line_pos * 1000000 + match_pos) AS f
        FROM c_links WHERE status = 'ok' GROUP BY source_url, href)
),
crawl_named AS (
  SELECT *, {remote_path('path', title_clean('title'))} AS nested,
         {flat_name(title_clean('title'), 'scheme', 'host', 'path')} AS flat
  FROM crawl_entries
)"""


def q_nested_paths() -> str:
    return _with(crawl_entries_ctes()) + """
SELECT source_url, href, nested AS rel_path FROM crawl_named"""


def q_flat_paths() -> str:
    return _with(crawl_entries_ctes()) + """
SELECT source_url, href, flat AS rel_path FROM crawl_named"""


def q_unique_paths() -> str:
    return _with(crawl_entries_ctes()) + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source_url, nested ORDER BY line_pos, match_pos) AS k FROM crawl_named
)
SELECT source_url, href, line_pos, match_pos, nested AS rel_path,
       CASE WHEN k = 1 THEN nested
            ELSE regexp_extract(nested, '^(.*?)(\\.[^./]*)?$', 1) || '-' || CAST(k AS VARCHAR)
                 || regexp_extract(nested, '^.*?(\\.[^./]*)?$', 1) END AS path
FROM numbered"""


def q_local_paths() -> str:
    host = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
    dom = f"regexp_extract({host}, '([^.]+\\.[^.]+\\.[^.]+)$', 1)"
    return f"""WITH anchors AS (
  SELECT {host} AS host_name, {dom} AS domain, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a
  FROM pages
),
mirror AS (
  SELECT 'file:///srv/mirror/' || host_name || regexp_extract(a, 'href="([^"]*)"', 1) AS file_url,
         '/srv/mirror/' || host_name || regexp_extract(a, 'href="([^"]*)"', 1) AS abs_path,
         regexp_extract(a, '>([^<]*)</a>', 1) AS title,
         '/srv/mirror/' || domain AS local_root_dir
  FROM anchors
),
rel AS (
  SELECT *, regexp_replace(CASE WHEN starts_with(abs_path, local_root_dir || '/')
                                THEN substr(abs_path, length(local_root_dir) + 2) END, '/+$', '') AS rel,
         {enc('abs_path', PATH_SET)} AS enc_path,
         {title_clean('title')} AS tclean
  FROM mirror
)
SELECT file_url, title, local_root_dir,
       CASE WHEN rel IS NOT NULL AND rel <> '' AND NOT starts_with(rel, '..')
            THEN {_dirs_file(_segs('strip_accents(rel)'), "ends_with(abs_path, '/')", _or('tclean', chr(39) + 'document' + chr(39)))}
            ELSE {flat_name('tclean', "'file'", "''", 'enc_path')} END AS rel_path
FROM rel"""


# --- sync ---------------------------------------------------------------------------

#: n % 5, first pos, source_url, label, k % 2 and folder of the installs behind the first ones
OTHER_INSTALLS = ((0, 1000, "'https://' || source || '.example.org/llms.txt'", "second", 0, "second"), (1, 2000, None, "nameless", 0, "one"),
                  (1, 3000, None, "nameless", 1, "two"), (2, 4000, "'https://' || source || '.old.example.org/llms.txt'", "old", 0, "old"),
                  (2, 5000, "'https://' || source || '.old.example.org/llms.txt'", "old", 1, "older"))
OTHERS = " UNION ALL ".join(
    f"SELECT collection, src_n + {pos} AS pos, {url or 'CAST(NULL AS VARCHAR)'} AS source_url, '{label}' AS source_label, "
    f"json_object('label', '{label}', 'seen', '{folder}'{f', \'url\', {url}' if url else ''}) AS source, '{folder}/' || path AS path, "
    f"url || '#{folder}' AS url, doc_id FROM base WHERE src_n % 5 = {n} AND k % 2 = {k}" for n, pos, url, label, k, folder in OTHER_INSTALLS)


def sync_ctes() -> str:
    n = "CAST(regexp_extract(source, '[0-9]+', 0) AS INTEGER)"
    return f"""
base AS (
  SELECT doc_id, doc_id // 20 AS k, lang, source, {n} AS src_n,
         'docs-' || CAST({n} % 2 AS VARCHAR) AS collection,
         'https://' || source || '.example.org/llms.txt' AS source_url,
         'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url,
         source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path,
         {jtrim_end('text')} || chr(10) AS content
  FROM documents
),
installed AS (SELECT * FROM base WHERE src_n % 5 <> 4),
sources AS (SELECT DISTINCT collection, source_url, source, src_n FROM base),
first_installs AS (
  SELECT collection, CAST(row_number() OVER (PARTITION BY collection ORDER BY src_n) - 1 AS INTEGER) AS pos,
         source_url, source || ' docs (' || source || ')' AS source_label, 'nested' AS layout, source AS path_prefix,
         json_object('label', source, 'url', source_url) AS source
  FROM sources WHERE src_n % 5 <> 4
),
others AS ({OTHERS}),
installs AS (
  SELECT * FROM first_installs
  UNION ALL SELECT DISTINCT collection, pos, source_url, source_label, 'flat', CAST(NULL AS VARCHAR), source FROM others
),
run_sources AS (
  SELECT collection, source_url, source || ' docs (' || source || ')' AS source_label, 'nested' AS layout,
         source AS path_prefix, src_n AS seq FROM sources
),
prev_docs AS (SELECT * FROM installed WHERE k % 10 <> 0),
ghost AS (
  SELECT collection, source_url, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '-old.md' AS path
  FROM installed WHERE k % 11 = 0
),
managed AS (SELECT collection, source_url, path FROM prev_docs UNION ALL SELECT * FROM ghost),
selected_urls AS (SELECT collection, source_url, url, doc_id FROM prev_docs WHERE src_n % 2 = 1),
corpus AS (
  SELECT collection, path, sha256(CASE WHEN k % 7 = 0 THEN content || 'old' ELSE content END) AS content_sha
  FROM prev_docs WHERE k % 13 <> 0
  UNION ALL SELECT collection, path, sha256('ghost' || chr(10)) FROM ghost
  UNION ALL SELECT collection, path, sha256('unmanaged' || chr(10)) FROM base WHERE k % 10 = 0 AND k % 3 = 0
),
marked AS (
  SELECT b.*, s.url IS NOT NULL AS hit,
         EXISTS (SELECT 1 FROM selected_urls p WHERE p.collection = b.collection AND p.source_url = b.source_url) AS has_prev
  FROM base b LEFT JOIN selected_urls s USING (collection, source_url, url)
),
marked2 AS (
  SELECT *, has_prev AND bool_or(hit) OVER (PARTITION BY collection, source_url) AS use_prev FROM marked
),
selected AS (
  SELECT *, CASE WHEN use_prev THEN 'previous' ELSE 'all' END AS selection FROM marked2 WHERE NOT use_prev OR hit
),
fetched AS (
  SELECT collection, source_url, url, CAST(doc_id AS BIGINT) AS line_pos, path,
         NOT (src_n % 5 = 3 AND k % 4 = 0) AS ok,
         CASE WHEN NOT (src_n % 5 = 3 AND k % 4 = 0) THEN sha256(content) END AS content_sha
  FROM selected
),
docs AS (SELECT collection, source_url, path, content_sha FROM fetched WHERE ok),
cur_managed AS (SELECT DISTINCT m.collection, m.source_url, m.path FROM managed m),
readable AS (
  SELECT m.collection, m.source_url, m.path, c.content_sha AS old_sha
  FROM cur_managed m JOIN corpus c USING (collection, path)
),
facts AS (
  SELECT f.collection, f.source_url, count_if(ok) AS successes, count_if(NOT ok) AS failures,
         i.source_url IS NOT NULL AS same_source
  FROM fetched f LEFT JOIN first_installs i USING (collection, source_url)
  GROUP BY f.collection, f.source_url, i.source_url
),
plan AS (
  SELECT d.collection, d.source_url, d.path,
         CASE WHEN r.old_sha IS NULL THEN 'added' WHEN r.old_sha = d.content_sha THEN 'unchanged' ELSE 'changed' END AS change
  FROM docs d LEFT JOIN readable r USING (collection, source_url, path)
  UNION ALL
  SELECT m.collection, m.source_url, m.path, 'removed'
  FROM cur_managed m JOIN facts f USING (collection, source_url)
  WHERE f.same_source AND f.failures = 0
    AND NOT EXISTS (SELECT 1 FROM docs d WHERE d.collection = m.collection AND d.source_url = m.source_url AND d.path = m.path)
),
summary AS (
  SELECT f.collection, f.source_url, f.successes, f.failures, f.same_source,
         count(*) FILTER (WHERE p.change = 'added') AS added, count(*) FILTER (WHERE p.change = 'changed') AS changed,
         count(*) FILTER (WHERE p.change = 'removed') AS removed,
         count(*) FILTER (WHERE p.change = 'unchanged') AS unchanged
  FROM facts f LEFT JOIN plan p USING (collection, source_url)
  GROUP BY f.collection, f.source_url, f.successes, f.failures, f.same_source
),
summary2 AS (
  SELECT *, added + changed + removed AS total_changes,
         same_source AND added + changed + removed = 0 AND failures = 0 AS up_to_date,
         failures > 0 AS removals_paused,
         CASE WHEN successes = 0 THEN 'failed' ELSE 'ok' END AS run_status
  FROM summary
)"""


def q_previous_selection() -> str:
    return _with(sync_ctes()) + """
SELECT collection, source_url, url, CAST(doc_id AS BIGINT) AS line_pos, selection FROM selected"""


def q_explicit_selection() -> str:
    return _with(sync_ctes()) + """
SELECT collection, source_url, url, CAST(doc_id AS BIGINT) AS line_pos FROM base
WHERE contains(url, '.example.org/en/')"""


def q_install_plan() -> str:
    return _with(sync_ctes()) + """
SELECT collection, source_url, path, change FROM plan"""


def q_plan_summary() -> str:
    return _with(sync_ctes()) + """
SELECT collection, source_url, successes, failures, same_source, added, changed, removed, unchanged,
       total_changes, up_to_date, removals_paused, run_status FROM summary2"""


def q_plan_preview() -> str:
    return _with(sync_ctes()) + """,
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY collection, source_url, change ORDER BY path) AS INTEGER) AS rank,
         count(*) OVER (PARTITION BY collection, source_url, change) AS total
  FROM plan
)
SELECT collection, source_url, change, path, rank, total, greatest(total - 25, 0) AS more
FROM ranked WHERE rank <= 25"""


def q_apply_plan() -> str:
    return _with(sync_ctes()) + """,
active AS (SELECT collection, source_url FROM summary2 WHERE NOT up_to_date),
written AS (
  SELECT f.collection, f.path, f.content_sha FROM fetched f JOIN active USING (collection, source_url) WHERE f.ok
),
gone AS (
  SELECT collection, path FROM written
  UNION ALL
  SELECT p.collection, p.path FROM plan p JOIN active USING (collection, source_url) WHERE p.change = 'removed'
)
SELECT collection, path, content_sha FROM corpus c
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.collection = c.collection AND g.path = c.path)
UNION ALL
SELECT collection, path, content_sha FROM written"""


def upsert_ctes() -> str:
    """The manifest after the upsert; its lists by place."""
    return _with(sync_ctes()) + """,
runs AS (
  SELECT r.*, s.failures, json_object('label', r.source_label, 'url', r.source_url) AS source
  FROM run_sources r JOIN summary2 s USING (collection, source_url) WHERE NOT s.up_to_date
),
kept AS (
  SELECT i.* FROM installs i
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.collection = i.collection AND r.source_url = i.source_url)
),
last_pos AS (SELECT collection, max(pos) AS last FROM installs GROUP BY 1),
places AS (
  SELECT r.*, i.pos FROM runs r JOIN installs i ON i.collection = r.collection AND i.source_url = r.source_url
  UNION ALL
  SELECT r.*,
         CAST(coalesce(l.last, -1) + row_number() OVER (PARTITION BY r.collection ORDER BY r.seq, r.source_url) AS INTEGER)
  FROM runs r LEFT JOIN last_pos l USING (collection)
  WHERE NOT EXISTS (SELECT 1 FROM installs i WHERE i.collection = r.collection AND i.source_url = r.source_url)
),
new_installs AS (
  SELECT collection, pos, source_url, source_label, layout, coalesce(path_prefix, '') AS path_prefix, source FROM kept
  UNION ALL
  SELECT collection, pos, source_url, source_label, layout, path_prefix, source FROM places
),
new_managed AS (
  SELECT DISTINCT collection, pos, path FROM (
    SELECT p.collection, p.pos, f.path FROM fetched f JOIN places p USING (collection, source_url) WHERE f.ok
    UNION ALL
    SELECT p.collection, p.pos, m.path FROM managed m JOIN places p USING (collection, source_url) WHERE p.failures > 0
    UNION ALL
    SELECT k.collection, k.pos, m.path FROM managed m JOIN kept k USING (collection, source_url) JOIN first_installs USING (collection, pos)
    UNION ALL
    SELECT k.collection, k.pos, o.path FROM others o JOIN kept k USING (collection, pos)
  )
),
new_sel AS (
  SELECT collection, pos, source_url, url, min(line_pos) AS line_pos FROM (
    SELECT p.collection, p.pos, p.source_url, s.url, s.doc_id AS line_pos FROM selected s JOIN places p USING (collection, source_url)
    UNION ALL
    SELECT k.collection, k.pos, k.source_url, u.url, u.doc_id FROM selected_urls u JOIN kept k USING (collection, source_url) JOIN first_installs USING (collection, pos)
    UNION ALL
    SELECT k.collection, k.pos, k.source_url, o.url, o.doc_id FROM others o JOIN kept k USING (collection, pos)
  ) GROUP BY ALL
)"""


def q_manifest_upsert() -> str:
    return upsert_ctes() + """,
m AS (SELECT collection, pos, count(*) AS n_managed, min(path) AS first_managed, max(path) AS last_managed
      FROM new_managed GROUP BY 1, 2),
u AS (SELECT collection, pos, count(*) AS n_selected FROM new_sel GROUP BY 1, 2)
SELECT i.collection, i.pos, i.source_url, i.source_label, i.layout, i.path_prefix, i.source,
       coalesce(m.n_managed, 0) AS n_managed, m.first_managed, m.last_managed, coalesce(u.n_selected, 0) AS n_selected
FROM new_installs i LEFT JOIN m USING (collection, pos) LEFT JOIN u USING (collection, pos)"""


def q_manifest_files() -> str:
    return upsert_ctes() + """,
m AS (SELECT collection, pos, count(*) AS n_managed FROM new_managed GROUP BY 1, 2),
u AS (SELECT collection, pos, count(*) AS n_selected FROM new_sel GROUP BY 1, 2)
SELECT i.collection, CAST(row_number() OVER (PARTITION BY i.collection ORDER BY i.pos) - 1 AS INTEGER) AS pos, i.source_url,
       json_extract_string(i.source, '$.label') AS source_label, i.path_prefix, i.source,
       coalesce(m.n_managed, 0) AS n_managed, coalesce(u.n_selected, 0) AS n_selected
FROM new_installs i LEFT JOIN m USING (collection, pos) LEFT JOIN u USING (collection, pos)"""


def q_manifest_selection() -> str:
    return upsert_ctes() + """
SELECT collection, pos, source_url, url, CAST(line_pos AS BIGINT) AS line_pos, 0 AS match_pos FROM new_sel"""


def manifest_ctes() -> str:
    def filled(form: str) -> str:
        return " || ".join(p if p in ("id", "lang", "site") else f"'{p}'" for p in form.split("~") if p)

    cases = " ".join(f"WHEN {v} THEN {filled(form)}" for v, form in enumerate(MANIFEST_FORMS))
    keys = ", ".join(f"'{k}'" for k in ("source", "managedFiles", "selectedUrls", "layout", "pathPrefix"))

    def text(path: str) -> str:
        return f"CASE WHEN json_type(i, '{path}') = 'VARCHAR' THEN i ->> '{path}' END"

    return f"""
m0 AS (
  SELECT 'm-' || id AS collection, CASE v {cases} END AS text
  FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id % 6 AS v, lang, 'https://' || source || '.example.org' AS site FROM documents)
),
m1 AS (SELECT collection, CAST(text AS JSON) AS j FROM m0 WHERE json_valid(text)),
m2 AS (
  SELECT collection, CASE WHEN json_type(j, '$.installs') = 'ARRAY'
           THEN list_filter(CAST(j -> '$.installs' AS JSON[]), lambda x: json_type(x) IN ('OBJECT', 'ARRAY'))
         WHEN len(list_intersect(json_keys(j), [{keys}])) > 0 THEN [j] ELSE [] END AS installs
  FROM m1
),
m3 AS (SELECT collection, unnest(range(len(installs))) AS pos, unnest(installs) AS i FROM m2),
m AS (SELECT collection, CAST(pos AS INTEGER) AS pos, i, {text('$.source.url')} AS source_url, {text('$.source.label')} AS source_label,
             {text('$.layout')} AS layout, {text('$.pathPrefix')} AS path_prefix,
             CASE WHEN json_type(i, '$.source') = 'OBJECT' THEN CAST(i -> '$.source' AS VARCHAR) ELSE '{{}}' END AS source FROM m3)"""


def q_manifest_scan() -> str:
    return _with(manifest_ctes()) + """
SELECT collection, pos, source_url, source_label, CASE WHEN layout = 'flat' THEN 'flat' ELSE 'nested' END AS layout,
       coalesce(path_prefix, '') AS path_prefix, source FROM m"""


def q_manifest_lists() -> str:
    def entries(key: str) -> str:
        return (f"SELECT collection, pos, source_url, unnest(list_filter(CAST(i -> '$.{key}' AS JSON[]), "
                f"lambda x: json_type(x) = 'VARCHAR')) AS x, generate_subscripts(list_filter(CAST(i -> '$.{key}' AS JSON[]), "
                f"lambda x: json_type(x) = 'VARCHAR'), 1) - 1 AS n FROM m WHERE json_type(i, '$.{key}') = 'ARRAY'")

    return _with(manifest_ctes()) + f""",
entries AS (
  SELECT collection, pos, source_url, 'managed' AS list, x ->> '$' AS value, 0 AS n FROM ({entries('managedFiles')})
  UNION ALL
  SELECT collection, pos, source_url, 'selected', x ->> '$', n FROM ({entries('selectedUrls')})
)
SELECT collection, pos, source_url, list, value, CAST(min(n) AS BIGINT) AS ord FROM entries GROUP BY ALL"""


# --- registry -------------------------------------------------------------------------

REG_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"

REGISTRY = f"""
reg_lines AS (
  SELECT 0 AS line_no, '# slug|label|url' AS text
  UNION ALL
  SELECT CAST(page_id + 1 AS INTEGER), concat_ws('|', {REG_HOST}, {PAGE_TITLE}, url) FROM pages
),
reg0 AS (SELECT line_no, {jtrim('text')} AS l FROM reg_lines),
reg AS (
  SELECT line_no,
         coalesce({jtrim("string_split(l, '|')[1]")}, '') AS slug,
         coalesce({jtrim("string_split(l, '|')[2]")}, '') AS label,
         coalesce({jtrim("string_split(l, '|')[3]")}, '') AS url
  FROM reg0 WHERE l <> '' AND NOT starts_with(l, '#')
),
reg_v AS (SELECT *, slug <> '' AND label <> '' AND url <> '' AS valid FROM reg),
dup AS (
  SELECT *, count(*) OVER (PARTITION BY lower(slug)) > 1 AS duplicate_slug,
            count(*) OVER (PARTITION BY lower(url)) > 1 AS duplicate_url
  FROM reg
),
rparse0 AS (
  SELECT *, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS has_scheme,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
         regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS after
  FROM dup
),
rparse AS (
  SELECT *,
    CASE WHEN NOT has_scheme THEN false
         WHEN scheme NOT IN ('http', 'https', 'ws', 'wss', 'ftp', 'file') THEN true
         ELSE regexp_matches(after, '^//[^/?#@\\[\\]<>^| %]+([/?#]|$)') END AS parsed,
    lower(regexp_extract(after, '^//([^/?#:]*)', 1)) AS host,
    CASE WHEN scheme IN ('http', 'https', 'ws', 'wss', 'ftp', 'file')
         THEN CASE WHEN regexp_extract(after, '^//[^/?#]*([^?#]*)', 1) = '' THEN '/'
                   ELSE regexp_extract(after, '^//[^/?#]*([^?#]*)', 1) END
         ELSE regexp_replace(after, '[?#].*$', '') END AS upath,
    CASE WHEN regexp_matches(after, '^[^#]*\\?') THEN '?' || regexp_extract(after, '^[^?#]*\\?([^#]*)', 1) ELSE '' END AS uq
  FROM rparse0
),
static AS (
  SELECT line_no, slug, label, url, parsed,
    CASE WHEN parsed THEN host END AS parsed_host,
    CASE WHEN parsed THEN scheme || '://' || host || upath || uq END AS parsed_href,
    list_filter([
      CASE WHEN slug = '' OR label = '' OR url = '' THEN 'Registry line must contain slug, label, and URL.' END,
      CASE WHEN duplicate_slug THEN 'Duplicate slug.' END,
      CASE WHEN NOT parsed THEN 'URL is not valid.' END,
      CASE WHEN parsed AND scheme <> 'https' THEN 'Registry URLs must use HTTPS.' END,
      CASE WHEN parsed AND (host = 'localhost' OR ends_with(host, '.local') OR ends_with(host, '.internal')
                            OR regexp_matches(host, '^(0|10|127)\\.[0-9]+\\.[0-9]+\\.[0-9]+$')
                            OR regexp_matches(host, '^169\\.254\\.[0-9]+\\.[0-9]+$')
                            OR regexp_matches(host, '^172\\.(1[6-9]|2[0-9]|3[01])\\.[0-9]+\\.[0-9]+$')
                            OR regexp_matches(host, '^192\\.168\\.[0-9]+\\.[0-9]+$'))
           THEN 'Registry URLs must point to a public hostname.' END
    ], lambda x: x IS NOT NULL) AS issues,
    list_filter([
      CASE WHEN duplicate_url THEN 'Duplicate URL already exists in the registry.' END,
      CASE WHEN parsed AND NOT ends_with(lower(upath), 'llms.txt') THEN 'URL does not end with llms.txt.' END
    ], lambda x: x IS NOT NULL) AS warnings
  FROM rparse
),
probe AS (
  SELECT s.*, len(s.issues) = 0 AS do_fetch, r.ok AS r_ok, r.http_status AS r_status,
         r.content_type AS r_type, r.content_length AS r_len, r.final_url AS r_final, r.error AS r_error, r.body AS r_body
  FROM static s LEFT JOIN resources_f r ON len(s.issues) = 0 AND r.url = s.parsed_href
),
probe2 AS (
  SELECT *, do_fetch AND r_ok IS NOT NULL AS fetched, do_fetch AND coalesce(r_ok, false) AS okf,
         CASE WHEN do_fetch AND r_ok IS NOT NULL THEN coalesce(r_len, 0) ELSE 0 END AS header_len,
         coalesce(r_type, '') AS ctype
  FROM probe
),
probe3 AS (SELECT *, CASE WHEN header_len > 0 THEN header_len ELSE length(r_body) END AS eff FROM probe2),
reviewed AS (
  SELECT line_no, slug, label, url,
    CASE WHEN fetched AND (r_ok OR r_error IS NULL) THEN coalesce(r_final, parsed_href) ELSE url END AS final_url,
    CAST(CASE WHEN fetched THEN coalesce(r_status, 0) ELSE 0 END AS INTEGER) AS status_code,
    CASE WHEN fetched THEN ctype ELSE '' END AS content_type,
    CAST(header_len AS BIGINT) AS content_length,
    list_concat(issues, list_filter([
      CASE WHEN do_fetch AND r_ok IS NULL THEN 'not in snapshot'
           WHEN fetched AND NOT r_ok AND r_error IS NOT NULL THEN r_error
           WHEN fetched AND NOT r_ok THEN 'Fetch failed with HTTP ' || CAST(r_status AS VARCHAR) || '.'
           WHEN okf AND NOT (starts_with(lower(ctype), 'text/') OR contains(lower(ctype), 'markdown')
                             OR contains(lower(ctype), 'json') OR contains(lower(ctype), 'xml'))
             THEN 'Unexpected content type: ' || CASE WHEN ctype = '' THEN 'unknown' ELSE ctype END || '.' END
    ], lambda x: x IS NOT NULL)) AS issues,
    list_concat(warnings, CASE WHEN okf THEN list_filter([
      CASE WHEN lower(regexp_extract(r_final, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) <> parsed_host
           THEN 'Request redirected to a different hostname.' END,
      CASE WHEN eff > 1048576 THEN 'Response is larger than 1 MB.' END,
      CASE WHEN regexp_matches({_ws_ltrim('r_body')}, '(?i)^(<!doctype html|<html[{WS}>])')
           THEN 'Endpoint returned HTML instead of plain text/markdown.' END,
      CASE WHEN NOT regexp_matches(r_body, '\\[[^\\]]+\\]\\([^)]+\\)') THEN 'Response did not contain any markdown links.' END
    ], lambda x: x IS NOT NULL) ELSE [] END) AS warnings,
    CASE WHEN okf THEN ['Fetched ' || format('{{:,}}', eff) || ' bytes.'] ELSE [] END AS notes
  FROM probe3
),
reviewed2 AS (
  SELECT *, CASE WHEN len(issues) > 0 THEN 'unsafe' WHEN len(warnings) > 0 THEN 'needs-review' ELSE 'safe' END AS verdict
  FROM reviewed
)"""


def q_registry_scan() -> str:
    return _with(REGISTRY) + """
SELECT line_no, slug, label, url, valid FROM reg_v"""


def q_registry_order() -> str:
    return _with(REGISTRY) + """
SELECT line_no, label, row_number() OVER (ORDER BY icu_sort_key(label, 'en'), line_no) AS position
FROM reg_v WHERE valid"""


#: published pairs of an international label and its ASCII form
INTERNATIONAL = (("b\u00fccher", "xn--bcher-kva"), ("fa\u00df", "xn--fa-hia"), ("\u4f8b\u3048", "xn--r8jz45g"),
                 ("\u30c6\u30b9\u30c8", "xn--zckzah"), ("\u2603", "xn--n3h"))


def q_parsed_hosts() -> str:
    labels, codes = ("[" + ", ".join(f"'{x[k]}'" for x in INTERNATIONAL) + "]" for k in (0, 1))
    dotted = "format('{}.{}.{}.{}', %s >> 24, (%s >> 16) & 255, (%s >> 8) & 255, %s & 255)"
    four, two = "(n * 7919 + 65536) % 4294967296", "(2130706432 + (n * 31) % 16777216)"
    pairs = [("h", "h"), ("upper(h)", "h"), ("'ex%61mple-' || n || '.com'", "'example-' || n || '.com'"),
             (f"CAST({four} AS VARCHAR)", dotted.replace("%s", f"({four})")), ("'0x7F.' || (n * 31) % 16777216", dotted.replace("%s", two)),
             ("'0' || format('{:o}', n % 256) || '.0.0.1'", "n % 256 || '.0.0.1'"), ("'10.0.7.' || n % 256 || '.'", "'10.0.7.' || n % 256"),
             ("'[2001:DB8:0:0:0:0:0:' || format('{:X}', n % 65535 + 1) || ']'", "'[2001:db8::' || format('{:x}', n % 65535 + 1) || ']'"),
             ("'[::ffff:1.2.' || n % 256 || '.4]'", "'[::ffff:102:' || format('{:x}', (n % 256) * 256 + 4) || ']'"),
             (f"{labels}[1 + n % {len(INTERNATIONAL)}] || '.' || h", f"{codes}[1 + n % {len(INTERNATIONAL)}] || '.' || h"),
             ("'\uff25\uff58' || n || '\u3002com'", "'ex' || n || '.com'"), ("'1.2.3.' || (n % 100 + 256)", "NULL"), ("'ex%20ample' || n", "NULL")]
    rows = " UNION ALL ".join(f"SELECT n AS page_id, {k} AS form, {a} AS host, CAST({b} AS VARCHAR) AS parsed FROM p" for k, (a, b) in enumerate(pairs))
    return f"""
WITH p AS (SELECT page_id AS n, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS h FROM pages)
{rows}"""


def q_private_hosts() -> str:
    host = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
    return f"""WITH p AS (
  SELECT page_id, {host} AS h, CAST(page_id % 256 AS VARCHAR) AS a, CAST(page_id // 256 % 256 AS VARCHAR) AS b,
         CAST(page_id % 64 AS VARCHAR) AS c FROM pages
),
f AS (
  SELECT page_id, [h, h || '.INTERNAL', h || '.local', h || '.locale', 'LocalHost', a || '.' || b || '.' || c || '.' || a,
         '172.' || c || '.0.' || a, '192.' || a || '.7.' || b, '169.' || a || '.1.1', '10.' || (page_id % 512) || '.0.1',
         'fd00::' || hex(page_id), 'FE80::' || hex(page_id), '2001:db8::' || hex(page_id), '10.0.' || a] AS forms FROM p
),
e AS (SELECT page_id, unnest(range(14)) AS form, unnest(forms) AS host FROM f),
q AS (SELECT *, lower(host) AS l, [TRY_CAST(x AS INTEGER) FOR x IN string_split(host, '.')] AS o FROM e)
SELECT page_id, CAST(form AS INTEGER) AS form, host,
       l = 'localhost' OR ends_with(l, '.local') OR ends_with(l, '.internal')
       OR starts_with(l, 'fd') AND contains(l, ':') OR starts_with(l, 'fe80:')
       OR coalesce(len(o) = 4 AND list_max(o) < 256 AND len(list_filter(o, lambda x: x IS NULL)) = 0
                   AND (o[1] IN (0, 10, 127) OR o[1] = 169 AND o[2] = 254 OR o[1] = 172 AND o[2] BETWEEN 16 AND 31
                        OR o[1] = 192 AND o[2] = 168), false) AS private
FROM q"""


def q_local_content_types() -> str:
    ext = ", ".join(f"'{x}'" for x in LOCAL_EXTENSIONS)
    return f"""WITH p AS (
  SELECT page_id, '/srv/mirror/' || regexp_extract(url, '//([^?#]*)', 1) || [{ext}][page_id % 7 + 1] AS path FROM pages
)
SELECT page_id, path, CASE WHEN path ILIKE '%.html' OR path ILIKE '%.htm' THEN 'text/html'
       WHEN path ILIKE '%.md' OR path ILIKE '%.markdown' OR path ILIKE '%.mdx' THEN 'text/markdown' ELSE 'text/plain' END AS content_type
FROM p"""


def q_registry_duplicates() -> str:
    return _with(REGISTRY) + """
SELECT line_no, slug, url, duplicate_slug, duplicate_url FROM dup"""


def q_registry_static_review() -> str:
    return _with(REGISTRY) + """
SELECT line_no, slug, array_to_string(issues, ' ') AS issues, array_to_string(warnings, ' ') AS warnings FROM static"""


def q_registry_review() -> str:
    return _with(RESOURCES, REGISTRY) + """
SELECT line_no, slug, url, final_url, status_code, content_type, content_length,
       array_to_string(issues, ' ') AS issues, array_to_string(warnings, ' ') AS warnings,
       array_to_string(notes, ' ') AS notes, verdict
FROM reviewed2"""


def q_verdict_counts() -> str:
    return _with(RESOURCES, REGISTRY) + """
SELECT count_if(verdict = 'safe') AS safe, count_if(verdict = 'needs-review') AS needs_review,
       count_if(verdict = 'unsafe') AS unsafe
FROM reviewed2"""


def q_review_report() -> str:
    esc = "replace(regexp_replace(d, '\\r?\\n', ' ', 'g'), '|', '\\|')"
    return _with(RESOURCES, REGISTRY) + f""",
counts AS (
  SELECT count_if(verdict = 'safe') AS safe, count_if(verdict = 'needs-review') AS nr,
         count_if(verdict = 'unsafe') AS unsafe FROM reviewed2
),
details AS (
  SELECT *, CASE WHEN array_to_string(list_concat(issues, warnings, notes), ' ') = '' THEN 'Looks good.'
                 ELSE array_to_string(list_concat(issues, warnings, notes), ' ') END AS d
  FROM reviewed2
)
SELECT 0 AS section, CAST(x.o AS BIGINT) AS ord, 0 AS sub, x.l AS line
FROM (SELECT unnest([
  {{'o': 0, 'l': '<!-- mdweave-registry-review -->'}}, {{'o': 1, 'l': '## mdweave Registry Review'}},
  {{'o': 2, 'l': ''}}, {{'o': 3, 'l': '- Safe: ' || CAST(safe AS VARCHAR)}},
  {{'o': 4, 'l': '- Needs review: ' || CAST(nr AS VARCHAR)}}, {{'o': 5, 'l': '- Unsafe: ' || CAST(unsafe AS VARCHAR)}},
  {{'o': 6, 'l': ''}}, {{'o': 7, 'l': '| Slug | Verdict | Status | Notes |'}}, {{'o': 8, 'l': '| --- | --- | --- | --- |'}}
]) AS x FROM counts)
UNION ALL
SELECT 1, CAST(line_no AS BIGINT), 0,
       '| ' || slug || ' | ' || verdict || ' | ' || CASE WHEN status_code <> 0 THEN CAST(status_code AS VARCHAR) ELSE 'n/a' END
       || ' | ' || {esc} || ' |'
FROM details
UNION ALL SELECT 2, 0, 0, '' UNION ALL SELECT 2, 1, 0, '### Checked URLs' UNION ALL SELECT 2, 2, 0, ''
UNION ALL
SELECT 3, CAST(line_no AS BIGINT), 0, '- ' || slug || ': ' || url FROM reviewed2
UNION ALL
SELECT 3, CAST(line_no AS BIGINT), 1, '- Final URL for ' || slug || ': ' || final_url FROM reviewed2
WHERE final_url IS NOT NULL AND final_url <> '' AND final_url <> url
UNION ALL SELECT 4, 0, 0, ''
UNION ALL SELECT 4, 1, 0, 'This review is automated and should be treated as a safety pre-check, not a trust guarantee.'"""


def q_source_resolution() -> str:
    title_label = jtrim(f"regexp_extract({PAGE_TITLE}, '^([^|]*)', 1)")
    return _with(REGISTRY) + f""",
inputs AS (
  SELECT page_id AS input_id,
         CASE page_id % 4 WHEN 0 THEN upper({REG_HOST}) WHEN 1 THEN '  ' || {title_label} || ' ' WHEN 2 THEN url
              ELSE 'docs/' || regexp_extract(url, '^[A-Za-z]+://[^/]+/([^/?#]+)', 1) || '/' || CAST(page_id AS VARCHAR) || '.txt'
         END AS input
  FROM pages
),
strict AS (SELECT * FROM reg_v WHERE valid),
keyed AS (
  SELECT *, CASE WHEN NOT (contains(input, '/') OR contains(input, ':') OR starts_with(input, '.') OR starts_with(input, '~'))
                 THEN lower({jtrim('input')}) END AS k
  FROM inputs
),
hits AS (
  SELECT k.input_id, arg_min(struct_pack(slug := s.slug, label := s.label, url := s.url),
                             struct_pack(a := icu_sort_key(s.label, 'und'), b := s.line_no)) AS f
  FROM keyed k JOIN strict s ON lower(s.slug) = k.k OR lower(s.label) = k.k
  GROUP BY k.input_id
),
res AS (
  SELECT i.input_id, i.input, h.f,
         regexp_matches(i.input, '^https?://[^/?#@\\[\\]<>^| %]+([/?#]|$)') AS is_url,
         regexp_replace(CASE WHEN starts_with(i.input, '/') THEN i.input ELSE '/work/project/' || i.input END, '/+$', '') AS abs
  FROM inputs i LEFT JOIN hits h USING (input_id)
)
SELECT input_id, input,
  CASE WHEN f IS NOT NULL THEN 'registry' WHEN is_url THEN 'url' ELSE 'path' END AS kind,
  CASE WHEN f IS NOT NULL THEN f.slug END AS slug,
  CASE WHEN f IS NOT NULL THEN f.label || ' (' || f.slug || ')'
       WHEN is_url THEN lower(regexp_extract(input, '^([A-Za-z]+://[^/?#]*)', 1))
            || CASE WHEN regexp_extract(input, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                    ELSE regexp_extract(input, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
            || regexp_extract(input, '^[^?#]*(\\?[^#]*)?', 1) || regexp_extract(input, '(#.*)$', 1)
       ELSE abs END AS label,
  CASE WHEN f IS NOT NULL THEN
         CASE WHEN regexp_matches(f.url, '^https?://[^/?#@\\[\\]<>^| %]+([/?#]|$)')
              THEN lower(regexp_extract(f.url, '^([A-Za-z]+://[^/?#]*)', 1))
                   || CASE WHEN regexp_extract(f.url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                           ELSE regexp_extract(f.url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
                   || regexp_extract(f.url, '^[^?#]*(\\?[^#]*)?', 1) || regexp_extract(f.url, '(#.*)$', 1) END
       WHEN is_url THEN lower(regexp_extract(input, '^([A-Za-z]+://[^/?#]*)', 1))
            || CASE WHEN regexp_extract(input, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
                    ELSE regexp_extract(input, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END
            || regexp_extract(input, '^[^?#]*(\\?[^#]*)?', 1) || regexp_extract(input, '(#.*)$', 1)
       ELSE 'file://' || {enc('abs', PATH_SET)} END AS url,
  CASE WHEN f IS NULL AND NOT is_url THEN regexp_replace(abs, '/[^/]*$', '') END AS local_root_dir
FROM res"""


def q_path_prefixes() -> str:
    host = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))"
    return f"""WITH hosts AS (
  SELECT {PAGE_DOMAIN} AS collection, {host} AS host, min(page_id) AS seq FROM pages GROUP BY 1, 2
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY seq) AS rn FROM hosts)
SELECT collection, 'https://' || host || '/llms.txt' AS source_url, seq,
       CASE WHEN rn = 1 THEN '' ELSE {_or(sanitize("regexp_replace(host, '\\.+', '-', 'g')"), "'docs'")} END AS path_prefix
FROM ranked"""


def q_prefixed_paths() -> str:
    return _with(crawl_entries_ctes()) + f""",
prefixes AS ({q_path_prefixes()})
SELECT 'https://' || c.host || '/llms.txt' AS source_url, c.href,
       CASE WHEN coalesce(p.path_prefix, '') <> '' THEN p.path_prefix || '/' || c.nested ELSE c.nested END AS path
FROM crawl_named c LEFT JOIN prefixes p ON p.source_url = 'https://' || c.host || '/llms.txt'"""


def q_unique_paths_greedy() -> str:
    """W1 row by row: step i gives row i of each source the first free name."""
    return "WITH RECURSIVE" + _with(crawl_entries_ctes()).removeprefix("WITH") + """,
lang AS (
  SELECT *, regexp_extract(path, '^/([^/]+)/', 1) AS lang, CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS num
  FROM crawl_entries
),
claims AS (
  SELECT source_url, href, line_pos, match_pos,
         CASE WHEN num % 3 = 0 THEN lang || '.md' ELSE lang || '-' || CAST(num % 4 AS VARCHAR) || '.md' END AS rel_path,
         row_number() OVER (PARTITION BY source_url ORDER BY line_pos, match_pos) AS i
  FROM lang
),
claimed AS (
  SELECT source_url, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used FROM claims GROUP BY 1
  UNION ALL
  SELECT source_url, i, list_prepend(list_filter(names, lambda x: NOT list_contains(used, x))[1], used)
  FROM (SELECT c.source_url, c.i, s.used,
               list_prepend(c.rel_path, list_transform(range(2, c.i + 2),
                 lambda k: regexp_replace(c.rel_path, '\\.md$', '-' || CAST(k AS VARCHAR) || '.md'))) AS names
        FROM claimed s JOIN claims c ON c.source_url = s.source_url AND c.i = s.i + 1)
)
SELECT c.source_url, c.href, c.line_pos, c.match_pos, c.rel_path, s.used[1] AS path
FROM claims c JOIN claimed s USING (source_url, i)"""


def shown_text(body: str) -> str:
    """Letters and digits that an html body shows, without its markup."""
    dropped = "title|script|style|noscript|template"
    shown = (f"regexp_replace({body}, '(?is)<({dropped})(\\s[^>]*)?>.*?</({dropped})\\s*>|<!--.*?-->"
             "|<!doctype[^>]*>|</?[a-z][^>]*>', '', 'g')")
    for name, char in [("middot", "·"), ("copy", "©"), ("nbsp", " "), ("quot", '"'), ("gt", ">"), ("lt", "<"), ("amp", "&")]:
        # HTML reads these names without their semicolon too
        shown = f"regexp_replace({shown}, '&{name};?', '{char}', 'g')"
    return f"regexp_replace({shown}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def q_html_text() -> str:
    return _with(RESOURCES, FETCHED) + f""",
shown AS (SELECT url, {shown_text('body')} AS t FROM classified WHERE kind = 'html')
SELECT url, sha256(t) AS text_sha, length(t) AS text_chars FROM shown"""


def q_corpus_snapshot() -> str:
    return _with(site_selected_ctes(), CANDIDATES, RESOURCES, FIRST_SUCCESS) + f""",
named AS (
  SELECT fs.source_url, fs.line_pos, fs.match_pos, {shown_text('r.body')} AS t,
         {remote_path('s.path', title_clean('s.title'))} AS nested
  FROM fs JOIN sel s ON s.source_url = fs.source_url AND s.href = fs.href
  JOIN resources r ON r.url = fs.fetched_url WHERE fs.ok AND r.ok
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source_url, nested ORDER BY line_pos, match_pos) AS k FROM named WHERE t <> ''
)
SELECT 'site:' || regexp_extract(source_url, '://([^/]+)/', 1) AS collection,
       CASE WHEN k = 1 THEN nested ELSE regexp_replace(nested, '\\.md$', '-' || CAST(k AS VARCHAR) || '.md') END AS path,
       sha256(t) AS text_sha
FROM numbered"""


def q_index_file_lines() -> str:
    return _with(V2_LINES) + """
SELECT regexp_extract(source_url, '//([^/]+)/', 1) AS site, row_number() OVER (PARTITION BY source_url ORDER BY line_pos) - 1 AS line_pos, line
FROM v2_lines"""


def q_corpus_log() -> str:
    """Each document at each run; the last run that changed it wrote it."""
    return _with(sync_ctes().split("installed AS")[0].rstrip().rstrip(",")) + f""",
runs AS (
  SELECT b.*, r.run, (doc_id + run) % 9 <> 0 AS there,
         content || CASE WHEN doc_id % 10 BETWEEN 2 AND run THEN 'second' ELSE 'first' END AS edition
  FROM base b CROSS JOIN (SELECT unnest(range(1, {LOG_RUNS + 1})) AS run) r
),
steps AS (
  SELECT *, lag(there) OVER w AS there_before, lag(edition) OVER w AS before FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY run)
),
written AS (
  SELECT doc_id, max(run) AS seq FROM steps WHERE there AND (there_before IS DISTINCT FROM true OR before <> edition) GROUP BY 1
)
SELECT collection, path, sha256(edition) AS content_sha, CAST(seq AS BIGINT) AS seq
FROM runs JOIN written USING (doc_id) WHERE run = {LOG_RUNS} AND there"""


def q_document_tree() -> str:
    return _with(sync_ctes().split("installed AS")[0].rstrip().rstrip(",")) + """
SELECT collection, path, sha256(content || CASE WHEN doc_id % 10 = 2 THEN 'second' ELSE 'first' END) AS content_sha
FROM base WHERE (doc_id + 2) % 9 <> 0"""


def q_changed_import() -> str:
    """The documents of both crawls, each from all its pages; one that is gone stays while its source has failures."""
    body = site_selected_ctes() + "," + CANDIDATES + "," + RESOURCES + "," + FIRST_SUCCESS + f""",
named AS (
  SELECT fs.source_url, fs.line_pos, fs.match_pos, coalesce(fs.ok AND {shown_text('r.body')} <> '', false) AS ok, {shown_text('r.body')} AS t,
         {remote_path('s.path', title_clean('s.title'))} AS nested
  FROM fs JOIN sel s ON s.source_url = fs.source_url AND s.href = fs.href
  LEFT JOIN resources r ON r.url = fs.fetched_url AND r.ok
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source_url, nested ORDER BY line_pos, match_pos) AS k FROM named WHERE ok
),
failing AS (SELECT source_url, count_if(NOT ok) AS failures FROM named GROUP BY 1)
SELECT source_url, CASE WHEN k = 1 THEN nested ELSE regexp_replace(nested, '\\.md$', '-' || CAST(k AS VARCHAR) || '.md') END AS path,
       sha256(t) AS text_sha, failures
FROM failing LEFT JOIN numbered USING (source_url)"""
    later = ("pages AS (SELECT page_id, url, CASE WHEN page_id % 40 = 3 THEN html || '<p>second edition</p>' ELSE html END AS html "
             "FROM all_pages WHERE page_id % 50 <> 7)")
    return f"""
WITH all_pages AS (SELECT page_id, url, html FROM pages),
first_run AS (WITH pages AS (SELECT * FROM all_pages), {body}),
second_run AS (WITH {later}, {body}),
facts AS (SELECT DISTINCT source_url, failures FROM second_run),
kept AS (
  SELECT f.source_url, f.path, f.text_sha FROM first_run f LEFT JOIN facts USING (source_url)
  WHERE f.path IS NOT NULL AND coalesce(facts.failures, 1) > 0
    AND NOT EXISTS (SELECT 1 FROM second_run s WHERE s.source_url = f.source_url AND s.path = f.path)
)
SELECT 'site:' || regexp_extract(source_url, '://([^/]+)/', 1) AS collection, path, text_sha
FROM (SELECT source_url, path, text_sha FROM second_run WHERE path IS NOT NULL UNION ALL SELECT * FROM kept)"""


def q_source_failures() -> str:
    return _with(site_selected_ctes()) + """
SELECT 'site:' || regexp_extract(v.source_url, '://([^/]+)/', 1) AS collection, v.source_url,
       CASE WHEN NOT v.listed THEN 'no index' WHEN l.source_url IS NULL THEN 'no links in the index'
            ELSE 'no link is allowed' END AS reason
FROM (SELECT source_url, bool_or(listed) AS listed
      FROM (SELECT source_url, true AS listed FROM v2_lines
            UNION ALL SELECT 'https://' || source || '.example.org/llms.txt', false FROM documents) GROUP BY 1) v
LEFT JOIN (SELECT DISTINCT source_url FROM s_links WHERE status = 'ok') l ON l.source_url = v.source_url
WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.source_url = v.source_url)"""


def q_ingest_summary() -> str:
    """A first install of every site: all documents that are fetched and have text are added."""
    visible = "regexp_replace(regexp_replace(body, '(?s)<(title|script|style|noscript|template)[^>]*>.*?</(title|script|style|noscript|template)>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    return _with(site_selected_ctes(), CANDIDATES, RESOURCES, FIRST_SUCCESS) + f""",
texts AS (SELECT url, {jtrim(visible)} <> '' AS has_text FROM resources WHERE ok),
runs AS (
  SELECT fs.source_url, count_if(fs.ok AND t.has_text) AS successes, count_if(NOT (fs.ok AND t.has_text)) AS failures
  FROM fs LEFT JOIN texts t ON t.url = fs.fetched_url GROUP BY 1
),
found AS (SELECT source_url, count(*) AS links_found FROM s_links WHERE status = 'ok' GROUP BY 1),
uniq AS (
  SELECT u.source_url, count(*) AS unique_urls, count(s.href) AS selected_docs, count(*) - count(s.href) AS blocked_docs,
         count(DISTINCT u.f.host) FILTER (WHERE s.href IS NULL) AS blocked_hosts
  FROM s_unique u LEFT JOIN sel s ON s.source_url = u.source_url AND s.href = u.href GROUP BY 1
),
sums AS (
  SELECT v.source_url, coalesce(r.successes, 0) AS successes, coalesce(r.failures, 0) AS failures,
         coalesce(f.links_found, 0) AS links_found, coalesce(u.unique_urls, 0) AS unique_urls,
         coalesce(u.selected_docs, 0) AS selected_docs, coalesce(u.blocked_docs, 0) AS blocked_docs,
         coalesce(u.blocked_hosts, 0) AS blocked_hosts
  FROM (SELECT DISTINCT source_url FROM v2_lines) v LEFT JOIN runs r USING (source_url)
  LEFT JOIN found f USING (source_url) LEFT JOIN uniq u USING (source_url)
)
SELECT 'site:' || regexp_extract(source_url, '://([^/]+)/', 1) AS collection, source_url, successes, failures,
       successes AS added, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS unchanged,
       successes AS total_changes, false AS same_source, false AS up_to_date,
       CASE WHEN successes = 0 THEN 'failed' ELSE 'ok' END AS run_status,
       links_found, unique_urls, selected_docs, blocked_docs, blocked_hosts,
       CASE WHEN links_found = 0 THEN 'no links in the index' WHEN selected_docs = 0 THEN 'no link is allowed' END AS source_failure
FROM sums"""


def oracle_sql() -> dict[str, str]:
    return {
        "parsed_hosts": q_parsed_hosts(),
        "index_file_lines": q_index_file_lines(),
        "document_tree": q_document_tree(),
        "manifest_files": q_manifest_files(),
        "corpus_log": q_corpus_log(),
        "changed_import": q_changed_import(),
        "manifest_selection": q_manifest_selection(),
        "manifest_scan": q_manifest_scan(),
        "manifest_lists": q_manifest_lists(),
        "registry_order": q_registry_order(),
        "private_hosts": q_private_hosts(),
        "local_content_types": q_local_content_types(),
        "prefixed_paths": q_prefixed_paths(),
        "unique_paths_greedy": q_unique_paths_greedy(),
        "html_text": q_html_text(),
        "ingest_summary": q_ingest_summary(),
        "corpus_snapshot": q_corpus_snapshot(),
        "source_failures": q_source_failures(),
        "extract_links": q_extract_links(),
        "resolve_links": q_resolve_links(),
        "link_rejects": q_link_rejects(),
        "dedupe_links": q_dedupe_links(),
        "host_policy": q_host_policy(),
        "link_stats": q_link_stats(),
        "blocked_hosts": q_blocked_hosts(),
        "candidate_urls": q_candidate_urls(),
        "first_success": q_first_success(),
        "fetch_failures": q_fetch_failures(),
        "classify_content": q_classify_content(),
        "markdown_docs": q_markdown_docs(),
        "nested_paths": q_nested_paths(),
        "local_paths": q_local_paths(),
        "flat_paths": q_flat_paths(),
        "unique_paths": q_unique_paths(),
        "path_prefixes": q_path_prefixes(),
        "previous_selection": q_previous_selection(),
        "explicit_selection": q_explicit_selection(),
        "install_plan": q_install_plan(),
        "plan_summary": q_plan_summary(),
        "plan_preview": q_plan_preview(),
        "apply_plan": q_apply_plan(),
        "manifest_upsert": q_manifest_upsert(),
        "registry_scan": q_registry_scan(),
        "source_resolution": q_source_resolution(),
        "registry_duplicates": q_registry_duplicates(),
        "registry_static_review": q_registry_static_review(),
        "registry_review": q_registry_review(),
        "verdict_counts": q_verdict_counts(),
        "review_report": q_review_report(),
    }
