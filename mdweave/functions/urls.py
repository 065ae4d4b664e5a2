"""URL expressions: WHATWG-style resolution as native Catalyst columns.

``resolve_urls(df, ref, out, base)`` adds a struct ``(status, href, scheme, userinfo,
host, port, path, query)``.  ``status`` is one of ``ok``, ``empty``,
``invalid``, ``unsupported`` (protocol outside file/http/https).  The fragment is
always dropped, the query kept.

Supported subset (stated, everything else is ``invalid`` rather than wrong):
  * absolute references with any scheme; special schemes http, https, ws, wss,
    ftp, file; backslash as slash for special schemes; tab/newline removal;
    leading/trailing C0-or-space strip;
  * scheme-relative ``//host``, path-absolute ``/p``, query-only ``?q``,
    fragment-only ``#f``, empty and path-relative references, dot segments
    including the ``%2e`` spellings;
  * hosts of special schemes as ``functions.hosts`` parses them: names in lower case, percent-decoded, international
    ones in Punycode (without Unicode normalisation), IPv4 numbers, IPv6 in its shortest form;
  * ports: digits, <= 65535, scheme default dropped;
  * percent-encoding: the WHATWG path and special-query sets (UTF-8).

``parse_urls`` parses a stand-alone absolute URL the same way.
No ``parse_url`` built-in is used: under ANSI mode it raises on inputs WHATWG
accepts, ``try_parse_url`` returns NULL for them and neither lower-cases hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hosts import host_sql

# --- fixed values (WHATWG URL standard) -------------------------------------
SPECIAL_SCHEMES = ("ftp", "file", "http", "https", "ws", "wss")
DEFAULT_PORTS = {"ftp": "21", "http": "80", "https": "443", "ws": "80", "wss": "443"}
SUPPORTED_PROTOCOLS = ("file", "http", "https")
# characters percent-encoded in a path: C0 controls, space, non-ASCII, " < > ` { }
PATH_ENCODE = r'[^\x21-\x7E]|["<>`{}]'
# characters percent-encoded in a special query: C0, space, non-ASCII, " < > '
QUERY_ENCODE = r"""[^\x21-\x7E]|["<>']"""
# ---------------------------------------------------------------------------

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _is_special(scheme: Column) -> Column:
    return scheme.isin(*SPECIAL_SCHEMES)


def percent_encode(x: str, charset: str) -> Column:
    """The SQL expression ``x`` with the characters of ``charset`` as UTF-8 ``%XX``."""
    return F.expr(_encode_sql(x, charset))


_SPECIAL_SQL = ", ".join(f"'{x}'" for x in SPECIAL_SCHEMES)
_SUPPORTED_SQL = ", ".join(f"'{x}'" for x in SUPPORTED_PROTOCOLS)


def _raw(pattern: str) -> str:
    """A Spark SQL raw string literal (no quote may occur in the pattern)."""
    assert "'" not in pattern
    return f"r'{pattern}'"


# ASCII characters that url_encode (java.net.URLEncoder) escapes besides space
_URLENCODER_ESCAPED = "!\"#$%&'()+,/:;<=>?@[\\]^`{|}~"


def _kept_ascii(charset: str) -> list[str]:
    """Printable ASCII characters escaped by url_encode that ``charset`` keeps."""
    import re
    return [c for c in _URLENCODER_ESCAPED if c != "%" and not re.fullmatch(
        charset.replace(r"\x", r"\x"), c)]


def _encode_sql(x: str, charset: str) -> str:
    """Percent-encode the characters of ``charset`` (which must contain the C0
    controls, space, DEL and all non-ASCII) as UTF-8 ``%XX``.

    ``url_encode`` escapes a superset; the escapes of the ASCII characters the
    set keeps are turned back with plain ``replace`` calls (native, inside
    codegen) and ``%25`` -> ``%`` last, so no escape is decoded twice.  Rows
    without any such character skip the whole chain."""
    cs = _raw(charset.replace("'", r"\x27"))
    e = f"replace(url_encode({x}), '+', '%20')"
    for c in _kept_ascii(charset):
        lit = c.replace("\\", "\\\\").replace("'", "\\'")
        e = f"replace({e}, '%{ord(c):02X}', '{lit}')"
    e = f"replace({e}, '%25', '%')"
    return f"CASE WHEN {x} RLIKE {cs} THEN {e} ELSE {x} END"


def _stage(df: DataFrame, exprs: dict) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS `{n}`" for n, e in exprs.items()])


def resolve_urls(df: DataFrame, ref: str, out: str, base: str | None = None,
                 base_parts: str | None = None, keep_base: str | None = None) -> DataFrame:
    """Add struct column ``out`` = ``ref`` resolved against ``base``.

    ``base`` names a string column with the absolute base URL; ``base_parts``
    instead names a struct column produced by an earlier call (a base shared by
    many references, e.g. a link index URL, is then parsed once and reused).
    With neither, ``ref`` must be absolute.

    The work is a chain of projection stages written as SQL text (one JVM call
    per stage); each stage references earlier ones by name and Catalyst keeps
    the stages apart where merging would duplicate work.
    Result: struct<status, href, scheme, userinfo, host, port, path, query>.
    ``keep_base`` names a column that receives the parsed base (same struct).
    """
    t = f"__{out}_"
    if base is not None and base_parts is None:
        df = resolve_urls(df, base, t + "base", None, None)
        base_parts = t + "base"
    has_base = base_parts is not None
    B = f"`{base_parts}`" if has_base else None
    v = {k: f"`{t}{k}`" for k in (
        "r0 has_scheme r_scheme after b_scheme b_ok scheme special is_file same_scheme body opaque authority "
        "auth_body auth auth_rest userinfo_a hostport pq_src host_a port_rest p0 q0 host0 userinfo port_str "
        "port_junk host1 path_raw query_raw rel_possible host port_num path_abs default_port nseg port_ok path_dots "
        "host_ok path query port status").split()}
    scheme_re = _raw(r"^([A-Za-z][A-Za-z0-9+.\-]*):")
    df = _stage(df, {t + "r0": f"regexp_replace(regexp_replace(`{ref}`, {_raw(r'[\t\n\r]')}, ''), "
                               f"{_raw(r'^[\x00-\x20]+|[\x00-\x20]+\z')}, '')"})
    df = _stage(df, {
        t + "has_scheme": f"{v['r0']} RLIKE {scheme_re}",
        t + "r_scheme": f"lower(regexp_extract({v['r0']}, {scheme_re}, 1))",
        t + "after": f"regexp_replace({v['r0']}, {scheme_re}, '')",
        t + "b_scheme": f"{B}.scheme" if has_base else "CAST(NULL AS STRING)",
        t + "b_ok": f"coalesce({B}.status = 'ok', false)" if has_base else "false",
    })
    df = _stage(df, {t + "scheme": f"CASE WHEN {v['has_scheme']} THEN {v['r_scheme']} ELSE {v['b_scheme']} END"})
    df = _stage(df, {
        t + "special": f"coalesce({v['scheme']} IN ({_SPECIAL_SQL}), false)",
        t + "is_file": f"coalesce({v['scheme']} = 'file', false)",
        t + "same_scheme": f"coalesce({v['scheme']} = {v['b_scheme']}, false)",
    })
    body0 = f"CASE WHEN {v['has_scheme']} THEN {v['after']} ELSE {v['r0']} END"
    df = _stage(df, {t + "body": f"CASE WHEN {v['special']} THEN translate({body0}, chr(92), '/') ELSE {body0} END"})
    hs, sp, fi, same, body = v["has_scheme"], v["special"], v["is_file"], v["same_scheme"], v["body"]
    df = _stage(df, {
        t + "opaque": f"{hs} AND NOT {sp} AND NOT startswith({body}, '/')",
        t + "authority": (f"({hs} AND {sp} AND NOT {fi} AND NOT ({same} AND {v['b_ok']} AND NOT startswith({body}, '/')))"
                          f" OR ({hs} AND {fi} AND startswith({body}, '//'))"
                          f" OR ({hs} AND NOT {sp} AND startswith({body}, '//'))"
                          f" OR (NOT {hs} AND startswith({body}, '//'))"),
        t + "auth_body": f"CASE WHEN {hs} AND {sp} AND NOT {fi} THEN concat('//', regexp_replace({body}, '^/*', '')) "
                         f"ELSE {body} END",
    })
    df = _stage(df, {
        t + "auth": f"regexp_extract({v['auth_body']}, {_raw(r'^//([^/?#]*)')}, 1)",
        t + "auth_rest": f"regexp_replace({v['auth_body']}, {_raw(r'^//[^/?#]*')}, '')",
    })
    df = _stage(df, {
        t + "userinfo_a": f"CASE WHEN contains({v['auth']}, '@') THEN regexp_extract({v['auth']}, {_raw(r'^(.*)@')}, 1) ELSE '' END",
        t + "hostport": f"regexp_replace({v['auth']}, {_raw(r'^.*@')}, '')",
        t + "pq_src": f"CASE WHEN {v['authority']} THEN {v['auth_rest']} ELSE {body} END",
    })
    hp, pq = v["hostport"], v["pq_src"]
    df = _stage(df, {
        t + "host_a": f"CASE WHEN startswith({hp}, '[') THEN regexp_extract({hp}, {_raw(r'^(\[[^\]]*\]?)')}, 1) "
                      f"ELSE regexp_extract({hp}, {_raw(r'^([^:]*)')}, 1) END",
        t + "port_rest": f"CASE WHEN startswith({hp}, '[') THEN regexp_replace({hp}, {_raw(r'^\[[^\]]*\]?')}, '') "
                         f"ELSE regexp_replace({hp}, {_raw(r'^[^:]*')}, '') END",
        t + "p0": f"regexp_extract({pq}, {_raw(r'^([^?#]*)')}, 1)",
        t + "q0": f"CASE WHEN {pq} RLIKE {_raw(r'^[^#]*\?')} THEN regexp_extract({pq}, {_raw(r'^[^?#]*\?([^#]*)')}, 1) END",
    })
    au, p0, q0 = v["authority"], v["p0"], v["q0"]
    port_a = f"CASE WHEN startswith({v['port_rest']}, ':') THEN substring({v['port_rest']}, 2) END"
    if has_base:
        cross = f"({hs} AND NOT {same})"
        st10 = {
            t + "host0": f"CASE WHEN {au} THEN {v['host_a']} WHEN {cross} THEN '' ELSE {B}.host END",
            t + "userinfo": f"CASE WHEN {au} THEN regexp_replace({v['userinfo_a']}, {_raw(r':\z')}, '') "
                            f"WHEN {cross} THEN '' ELSE {B}.userinfo END",
            t + "port_str": f"CASE WHEN {au} THEN {port_a} WHEN {cross} THEN NULL ELSE {B}.port END",
            t + "path_raw": (f"CASE WHEN {au} THEN {p0} "
                             f"WHEN {hs} AND {fi} AND NOT {same} THEN "
                             f"(CASE WHEN startswith({p0}, '/') THEN {p0} ELSE concat('/', {p0}) END) "
                             f"WHEN {p0} = '' THEN {B}.path WHEN startswith({p0}, '/') THEN {p0} "
                             f"ELSE concat(regexp_replace({B}.path, {_raw(r'[^/]*\z')}, ''), {p0}) END"),
            t + "query_raw": f"CASE WHEN {au} THEN {q0} WHEN {p0} = '' AND {q0} IS NULL THEN {B}.query ELSE {q0} END",
            t + "rel_possible": (f"coalesce(({v['b_ok']} AND ({B}.scheme IN ({_SPECIAL_SQL}) OR startswith({B}.path, '/')))"
                                 f" OR ({hs} AND {fi}), false)"),
        }
    else:
        st10 = {
            t + "host0": f"CASE WHEN {au} THEN {v['host_a']} ELSE '' END",
            t + "userinfo": f"CASE WHEN {au} THEN regexp_replace({v['userinfo_a']}, {_raw(r':\z')}, '') ELSE '' END",
            t + "port_str": f"CASE WHEN {au} THEN {port_a} END",
            t + "path_raw": f"CASE WHEN {au} THEN {p0} WHEN startswith({p0}, '/') THEN {p0} ELSE concat('/', {p0}) END",
            t + "query_raw": q0,
            t + "rel_possible": f"{hs} AND {fi}",
        }
    st10[t + "port_junk"] = f"{au} AND length({v['port_rest']}) > 0 AND NOT startswith({v['port_rest']}, ':')"
    df = _stage(df, st10)
    ps = v["port_str"]
    port_re = _raw(r"^0*[0-9]{1,5}\z")  # WHATWG accepts zeros in front
    default_port = "CASE " + " ".join(f"WHEN {v['scheme']} = '{k}' THEN '{p}'" for k, p in DEFAULT_PORTS.items()) + " END"
    # a host that the base has parsed already, or one of another scheme, stays
    df = _stage(df, {t + "host1": f"CASE WHEN {au} AND {sp} AND {v['host0']} <> '' THEN {host_sql(v['host0'])} ELSE lower({v['host0']}) END"})
    df = _stage(df, {
        t + "host": f"CASE WHEN {fi} AND {v['host1']} = 'localhost' THEN '' ELSE {v['host1']} END",
        t + "port_num": f"CASE WHEN {ps} RLIKE {port_re} THEN try_cast({ps} AS INT) END",
        t + "path_abs": f"CASE WHEN {sp} AND {v['path_raw']} = '' THEN '/' ELSE {v['path_raw']} END",
        t + "default_port": default_port,
    })
    pa = v["path_abs"]
    df = _stage(df, {t + "nseg": f"size(split(substring({pa}, 2), '/'))"})
    dd, d1 = _raw(r"(?i)^(\.|%2e)(\.|%2e)\z"), _raw(r"(?i)^(\.|%2e)\z")
    pop = "slice(acc, 1, greatest(size(acc) - 1, 0))"
    fold = (f"concat('/', array_join(aggregate("
            f"transform(split(substring({pa}, 2), '/'), (s, i) -> named_struct('s', s, 'i', i)), "
            f"CAST(array() AS ARRAY<STRING>), "
            f"(acc, x) -> CASE WHEN x.s RLIKE {dd} THEN "
            f"(CASE WHEN x.i = {v['nseg']} - 1 THEN concat({pop}, array('')) ELSE {pop} END) "
            f"WHEN x.s RLIKE {d1} THEN (CASE WHEN x.i = {v['nseg']} - 1 THEN concat(acc, array('')) ELSE acc END) "
            f"ELSE concat(acc, array(x.s)) END), '/'))")
    host = v["host"]
    host_ok = f"CASE WHEN {host} = '' THEN ({fi} OR NOT {sp}) ELSE {host} IS NOT NULL END"
    df = _stage(df, {
        t + "port_ok": f"{ps} IS NULL OR {ps} = '' OR ({v['port_num']} IS NOT NULL AND {v['port_num']} <= 65535)",
        t + "path_dots": (f"CASE WHEN startswith({pa}, '/') AND {pa} RLIKE {_raw(r'(?i)/(\.|%2e){1,2}(/|\z)')} "
                          f"THEN {fold} ELSE {pa} END"),
        t + "host_ok": f"coalesce({host_ok}, false)",
    })
    pn = v["port_num"]
    df = _stage(df, {
        t + "path": _encode_sql(v["path_dots"], PATH_ENCODE),
        t + "query": _encode_sql(v["query_raw"], QUERY_ENCODE),
        t + "port": f"CASE WHEN {pn} IS NULL OR CAST({pn} AS STRING) = {v['default_port']} THEN NULL "
                    f"ELSE CAST({pn} AS STRING) END",
        t + "status": (f"CASE WHEN {v['r0']} = '' THEN 'empty' WHEN {v['opaque']} THEN 'unsupported' "
                       f"WHEN NOT {au} AND NOT {v['rel_possible']} THEN 'invalid' "
                       f"WHEN {v['port_junk']} THEN 'invalid' WHEN NOT {v['host_ok']} THEN 'invalid' "
                       f"WHEN NOT {v['port_ok']} THEN 'invalid' "
                       f"WHEN NOT coalesce({v['scheme']} IN ({_SUPPORTED_SQL}), false) THEN 'unsupported' "
                       f"ELSE 'ok' END"),
    })
    st, sch = v["status"], v["scheme"]
    hier = (f"concat({sch}, '://', CASE WHEN {v['userinfo']} <> '' THEN concat({v['userinfo']}, '@') ELSE '' END, "
            f"{host}, CASE WHEN {v['port']} IS NOT NULL THEN concat(':', {v['port']}) ELSE '' END, {v['path']}, "
            f"CASE WHEN {v['query']} IS NOT NULL THEN concat('?', {v['query']}) ELSE '' END)")
    href = (f"CASE WHEN {st} = 'ok' THEN {hier} "
            f"WHEN {st} = 'unsupported' THEN (CASE WHEN {v['opaque']} THEN concat({sch}, ':', "
            f"regexp_replace({v['after']}, {_raw(r'#.*\z')}, '')) ELSE {hier} END) "
            f"ELSE regexp_replace({v['r0']}, {_raw(r'#.*\z')}, '') END")
    ok_like = f"({st} IN ('ok', 'unsupported') AND NOT {v['opaque']})"

    def part(x):
        return f"CASE WHEN {ok_like} THEN {x} END"

    result = (f"named_struct('status', {st}, 'href', {href}, "
              f"'scheme', CASE WHEN {st} <> 'empty' THEN {sch} END, "
              f"'userinfo', {part(v['userinfo'])}, 'host', {part(host)}, 'port', {part(v['port'])}, "
              f"'path', {part(v['path'])}, 'query', {part(v['query'])})")
    # The one-element explode is an optimiser barrier: a later filter on the
    # result (e.g. status = 'ok') is not pushed down through the stage
    # projections, where alias substitution would inline every stage into the
    # predicate (exponential expression growth).
    keep = [f"`{x}`" for x in df.columns if not x.startswith(t)]
    if keep_base and has_base:
        keep.append(f"{B} AS `{keep_base}`")
    return df.selectExpr(*keep, f"explode(array({result})) AS `{out}`")


def parse_urls(df: DataFrame, url: str, out: str) -> DataFrame:
    """E17 tryParseUrl: parts of an absolute URL; status 'invalid' if unparsable."""
    return resolve_urls(df, url, out)


def hostname(host) -> Column:
    """Host without IPv6 brackets (WHATWG hostname keeps them; see E13 note)."""
    return F.regexp_replace(F.regexp_replace(_c(host), r"^\[", ""), r"\]\z", "")


def guess_local_content_type(path) -> Column:
    """E10."""
    p = F.lower(_c(path))
    return (F.when(p.rlike(r"\.html?\z"), F.lit("text/html"))
            .when(p.rlike(r"\.(md|markdown|mdx)\z"), F.lit("text/markdown"))
            .otherwise(F.lit("text/plain")))


def is_private_hostname(host) -> Column:
    """E13 on a hostname (brackets already stripped, see SURVEY 2.10.10)."""
    h = F.lower(_c(host))
    parts = F.split(h, r"\.")
    ipv4 = h.rlike(r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}\z")
    a = F.get(parts, 0).try_cast("int")
    b2 = F.get(parts, 1).try_cast("int")
    v4_private = ((a == 0) | (a == 10) | (a == 127) | ((a == 169) & (b2 == 254))
                  | ((a == 172) & (b2 >= 16) & (b2 <= 31)) | ((a == 192) & (b2 == 168)))
    ipv6 = h.contains(":") & h.rlike(r"^[0-9a-f:.]+\z")
    # an IPv4 address written as IPv6 (::ffff:7f00:1, as the host parser writes it)
    mapped = F.regexp_extract(h, r"^::ffff:([0-9a-f]{1,4}):[0-9a-f]{1,4}\z", 1)
    high = F.when(mapped != "", F.conv(mapped, 16, 10).cast("int"))
    m1, m2 = F.shiftright(high, 8), high % 256
    mapped_private = F.coalesce((m1 == 0) | (m1 == 10) | (m1 == 127) | ((m1 == 169) & (m2 == 254))
                                | ((m1 == 172) & (m2 >= 16) & (m2 <= 31)) | ((m1 == 192) & (m2 == 168)), F.lit(False))
    v6_private = (h == "::1") | h.startswith("fc") | h.startswith("fd") | h.startswith("fe80:") | mapped_private
    return (F.when((h == "localhost") | h.endswith(".local") | h.endswith(".internal"), F.lit(True))
            .when(ipv4, v4_private)
            .when(ipv6, v6_private)
            .otherwise(F.lit(False)))


def is_text_like(content_type) -> Column:
    """E14."""
    t = F.lower(_c(content_type))
    return t.startswith("text/") | t.contains("markdown") | t.contains("json") | t.contains("xml")
