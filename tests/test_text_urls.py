from pyspark.sql import functions as F

from mdweave.functions import text as T
from mdweave.functions import urls as U
from mdweave.operators import paths as PA


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first()["o"]


def test_normalize_href(spark):
    # E1
    assert one(spark, T.normalize_href("v"), " <./docs> ") == "./docs"
    assert one(spark, T.normalize_href("v"), './docs "Title"') == "./docs"
    assert one(spark, T.normalize_href("v"), " x ") == "x"


def test_sanitize_and_extensions(spark):
    df = spark.createDataFrame([("Héllo World!.md",), ("guide.html.md",), ("/docs///",), ("/",)], "v string")
    df = PA.with_title_clean(df, "v", "clean")
    out = {r["v"]: r["clean"] for r in df.collect()}
    assert out["Héllo World!.md"] == "hello-world-.md"  # E3
    assert one(spark, T.strip_document_extension("v"), "guide.html.md") == "guide"  # E4
    assert one(spark, T.strip_document_extension("v"), "Guide.MDX") == "Guide"
    assert one(spark, T.trim_trailing_slash("v"), "/docs///") == "/docs"  # E7
    assert one(spark, T.trim_trailing_slash("v"), "/") == "/"
    assert one(spark, T.trim_trailing_slash("v"), "//") == ""
    assert one(spark, T.ensure_trailing_newline("v"), "a") == "a\n"  # E9
    assert one(spark, T.ensure_trailing_newline("v"), "a\n") == "a\n"
    assert one(spark, T.escape_table("v"), "a|b\nc") == "a\\|b c"  # E18


def test_fold_only_non_ascii_rows(spark):
    df = spark.createDataFrame([("für",), ("plain",), (None,)], "v string")
    out = {r["v"]: r["f"] for r in T.with_folded(df, "v", "f").collect()}
    assert out == {"für": "fur", "plain": "plain", None: None}


CASES = [
    ("./guide#intro", "https://example.com/llms.txt", "ok", "https://example.com/guide"),
    ("mailto:test@example.com", "https://example.com/llms.txt", "unsupported", "mailto:test@example.com"),
    ("http://[", "https://example.com/llms.txt", "invalid", "http://["),
    ("/für", "http://a.example.com/fr/825?page=2", "ok", "http://a.example.com/f%C3%BCr"),
    ("/the,", "http://a.example.com/x", "ok", "http://a.example.com/the,"),
    ("../a/./b/../c", "https://example.com/x/y/z", "ok", "https://example.com/x/a/c"),
    ("..", "https://example.com/x/y/z", "ok", "https://example.com/x/"),
    ("?q=1", "https://example.com/x/y?z#f", "ok", "https://example.com/x/y?q=1"),
    ("#f", "https://example.com/x/y?z#f", "ok", "https://example.com/x/y?z"),
    ("//Other.COM:443/p q", "https://example.com/x", "ok", "https://other.com/p%20q"),
    ("HTTP://EXAMPLE.com:80", "https://example.com/x", "ok", "http://example.com/"),
    ("http://user:pw@h.com:8080/a", "https://example.com/x", "ok", "http://user:pw@h.com:8080/a"),
    ("guide/auth.md", "file:///tmp/project/llms.txt", "ok", "file:///tmp/project/guide/auth.md"),
    ("https://example.com/a%2e%2E/b", "https://x.org/", "ok", "https://example.com/a%2e%2E/b"),
    ("https://example.com/%2e%2E/b", "https://x.org/", "ok", "https://example.com/b"),
    ("https://ex ample.com/", "https://x.org/", "invalid", "https://ex ample.com/"),
    ("https://127.1/", "https://x.org/", "ok", "https://127.0.0.1/"),
    ("https://[fe80::1]/x", "https://x.org/", "ok", "https://[fe80::1]/x"),
    ("https://example.com:99999/", "https://x.org/", "invalid", "https://example.com:99999/"),
    ("ftp://example.com/a", "https://x.org/", "unsupported", "ftp://example.com/a"),
    ("https:foo", "https://example.com/x/y", "ok", "https://example.com/x/foo"),
    ("http:foo.com/bar", "https://example.com/x/y", "ok", "http://foo.com/bar"),
    ("https://example.com/a?b c'd", "https://x.org/", "ok", "https://example.com/a?b%20c%27d"),
    ("https://example.com/?", "https://x.org/", "ok", "https://example.com/?"),
    ("a\\b", "https://example.com/x/", "ok", "https://example.com/x/a/b"),
]


def test_resolve_urls(spark):
    df = spark.createDataFrame([(r, b) for r, b, _, _ in CASES], "ref string, base string")
    out = U.resolve_urls(df, "ref", "u", base="base").select("ref", "u.status", "u.href").collect()
    got = {r["ref"]: (r["status"], r["href"]) for r in out}
    for ref, _, status, href in CASES:
        assert got[ref] == (status, href), ref


def test_private_and_text_like(spark):
    hosts = ["localhost", "192.168.1.1", "169.254.1.10", "172.16.0.10", "fe80::1", "example.com", "10.0.0.1",
             "a.internal", "172.32.0.1"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r["h"]: r["p"] for r in df.select("h", U.is_private_hostname("h").alias("p")).collect()}
    assert got == {"localhost": True, "192.168.1.1": True, "169.254.1.10": True, "172.16.0.10": True,
                   "fe80::1": True, "example.com": False, "10.0.0.1": True, "a.internal": True,
                   "172.32.0.1": False}
    types = spark.createDataFrame([("text/plain",), ("application/json",), ("application/octet-stream",)], "t string")
    assert [r["x"] for r in types.select(U.is_text_like("t").alias("x")).collect()] == [True, True, False]
    paths = spark.createDataFrame([("/a.HTML",), ("/a.mdx",), ("/a.txt",)], "p string")
    assert [r["x"] for r in paths.select(U.guess_local_content_type("p").alias("x")).collect()] == [
        "text/html", "text/markdown", "text/plain"]


def _model_encode(s, charset):
    import re
    out = []
    for ch in s:
        if re.fullmatch(charset, ch):
            out.append("".join(f"%{b:02X}" for b in ch.encode("utf-8")))
        else:
            out.append(ch)
    return "".join(out)


def test_percent_encoding_matches_model(spark):
    import random
    rnd = random.Random(3)
    alphabet = [chr(c) for c in range(0x20, 0x7F)] + ["\x01", "\x7f", "é", "ß", "€", "😀", "%2F", "%25", "+", " "]
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    samples += ["/f%C3%BCr", "/a b", "/%2F%", "/x+y", "/\\\\q", "/'\"<>`{}|^~"]
    df = spark.createDataFrame([(x,) for x in samples], "v string")
    for charset in (U.PATH_ENCODE, U.QUERY_ENCODE):
        sql = U._encode_sql("v", charset)
        got = [r["e"] for r in df.selectExpr("v", f"{sql} AS e").collect()]
        assert got == [_model_encode(x, charset) for x in samples], charset


def test_folds_of_all_code_points(spark):
    """As the standard library folds them, one by one."""
    import unicodedata
    every = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x110000)]]
    rows = ["".join(every[k:k + 256]) for k in range(0, len(every), 256)]
    expected = ["".join(x for c in r for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f") for r in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "n int, v string")
    got = {r.n: r.f for r in T.with_folded(df, "v", "f").collect()}
    assert [n for n in range(len(rows)) if got[n] != expected[n]] == []
    plan = T.with_folded(df, "v", "f")._jdf.queryExecution().toString()
    assert "Python" not in plan
