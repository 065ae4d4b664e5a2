from mdweave.operators import fetch as FE
from mdweave.operators import links as L


def index(spark, url, body):
    return spark.createDataFrame([(url, body)], "source_url string, body string")


def test_extract_and_resolve(spark):
    """P1 + P2: a relative target, one without a target, one of another protocol, one that is no URL."""
    body = "\r\n".join(["# Orchard manual", "* [Pruning](../tools/saw?v=2#blade) and [nothing]( \t )",
                        "* [Phone](tel:+441632960000)", "* [Odd](https://[1:2)"])
    lines = L.split_index_lines(index(spark, "https://orchard.test/de/llms.txt", body))
    res = L.resolve_links(L.extract_links(lines))
    assert [(r["line_pos"], r["title"], r["href"]) for r in L.valid_links(res).collect()] == [(1, "Pruning", "https://orchard.test/tools/saw?v=2")]
    assert sorted((r["line_pos"], r["status"]) for r in L.link_rejects(res).collect()) == [(2, "unsupported"), (3, "invalid")]


def test_nested_brackets_and_positions(spark):
    lines = L.split_index_lines(index(spark, "https://e.com/llms.txt", "[![i](a)](b) [x](c) [ ](d)"))
    got = [(r["line_pos"], r["match_pos"], r["title"], r["href_in"]) for r in L.extract_links(lines).collect()]
    assert got == [(0, 0, "![i", "a"), (0, 1, "x", "c"), (0, 2, "", "d")]


def test_dedupe_first_wins(spark):
    body = "[One](https://e.com/a)\n[Two](https://e.com/b)\n[Three](https://e.com/a#x)"
    lines = L.split_index_lines(index(spark, "https://e.com/llms.txt", body))
    u = L.dedupe_links(L.valid_links(L.resolve_links(L.extract_links(lines))))
    got = sorted((r["href"], r["title"], r["occurrences"]) for r in u.collect())
    assert got == [("https://e.com/a", "One", 2), ("https://e.com/b", "Two", 1)]


def test_host_policy(spark):
    body = "[A](https://example.com/a)\n[B](https://cdn.example.com/b)"
    lines = L.split_index_lines(index(spark, "https://example.com/llms.txt", body))
    u = L.dedupe_links(L.valid_links(L.resolve_links(L.extract_links(lines))))
    p = L.apply_host_policy(u)
    assert sorted((r["href"], r["allowed"]) for r in p.collect()) == [
        ("https://cdn.example.com/b", False), ("https://example.com/a", True)]
    assert all(r["allowed"] for r in L.apply_host_policy(u, True).collect())
    stats = L.link_stats(L.resolve_links(L.extract_links(lines)), p).first()
    assert (stats["selected_docs"], stats["blocked_docs"], stats["blocked_hosts"]) == (1, 1, 1)
    assert [(r["host"], r["blocked_links"]) for r in L.blocked_hosts(p).collect()] == [("cdn.example.com", 1)]


def entries(spark, hrefs):
    rows = []
    for h in hrefs:
        path = "/" + h.split("/", 3)[3].split("?")[0] if h.count("/") >= 3 else "/"
        rows.append(("s", h, path, None, 0, 0))
    return spark.createDataFrame(rows, "source_url string, href string, path string, query string, "
                                       "line_pos long, match_pos int")


def test_candidates(spark):
    c = FE.expand_candidates(entries(spark, ["https://orchard.test/", "https://orchard.test/apple/cox/", "https://orchard.test/pear"]))
    got = {}
    for r in c.orderBy("href", "rank").collect():
        got.setdefault(r["href"], []).append(r["candidate_url"].removeprefix("https://orchard.test"))
    assert got == {"https://orchard.test/": ["/", "/index.md"],
                   "https://orchard.test/apple/cox/": ["/apple/cox/", "/apple/cox.md", "/apple/cox/index.md", "/apple/cox.html.md"],
                   "https://orchard.test/pear": ["/pear", "/pear.md", "/pear/index.md", "/pear.html.md"]}


def test_first_success_and_reasons(spark):
    res = spark.createDataFrame([
        ("https://e.com/guide", False, 404, "Not Found", None, None, None, None, None),
        ("https://e.com/guide.md", True, 200, "OK", "text/markdown", 3, "https://e.com/guide.md", None, "# G"),
        ("https://e.com/x", False, None, None, None, None, None, "socket hang up", None),
    ], "url string, ok boolean, http_status int, status_text string, content_type string, content_length long, "
       "final_url string, error string, body string")
    out = {r["href"]: r for r in FE.first_success(entries(spark, ["https://e.com/guide", "https://e.com/x"]),
                                                    res).collect()}
    g = out["https://e.com/guide"]
    assert (g["ok"], g["fetched_url"], g["via"], g["rank"]) == (True, "https://e.com/guide.md",
                                                                 "https://e.com/guide.md", 1)
    x = out["https://e.com/x"]
    assert not x["ok"]
    assert x["reason"] == ("https://e.com/x (socket hang up); https://e.com/x.md (not in snapshot); "
                           "https://e.com/x/index.md (not in snapshot); https://e.com/x.html.md (not in snapshot)")
    bodies = FE.fetch_bodies(FE.first_success(entries(spark, ["https://e.com/guide"]), res), res).collect()
    assert bodies[0]["body"] == "# G"


def test_failure_preview(spark):
    f = spark.createDataFrame([("s", i, 0) for i in range(6)], "source_url string, line_pos long, match_pos int")
    out = FE.failure_preview(f).collect()
    assert len(out) == 5 and {r["more"] for r in out} == {1} and {r["failed_total"] for r in out} == {6}


def test_snapshot_with_repeated_urls(spark):
    from mdweave.operators import review as RV
    schema = ("url string, ok boolean, http_status int, status_text string, content_type string, content_length long, "
              "final_url string, error string, body string")
    page = "https://r.test/guide"
    snapshot = spark.createDataFrame(
        [(page, False, 500, "Broken", None, None, None, None, None),
         (page, True, 200, "OK", "text/plain", 5, page, None, "# two [a](b)"),
         (page, True, 200, "OK", "text/markdown", 5, page, None, "# one [a](b)"),
         ("https://r.test/gone", False, 404, "Not Found", None, None, None, None, None),
         ("https://r.test/gone", False, 404, "Not Found", None, None, None, None, None)], schema)
    entries = spark.createDataFrame([("s", page, "/guide", None), ("s", "https://r.test/gone", "/gone", None)],
                                    "source_url string, href string, path string, query string")
    fetched = FE.first_success(entries, snapshot)
    reason = fetched.filter("NOT ok").first()["reason"]
    # different reasons of one URL: the first by code points stands for it
    two = spark.createDataFrame([("https://r.test/gone", False, s, "Twice", None, None, None, None, None) for s in (503, 410)], schema)
    twice = FE.first_success(entries.filter("path = '/gone'"), two).first()["reason"]
    assert twice.startswith("https://r.test/gone (HTTP 410 Twice); https://r.test/gone.md (") and twice.count("; ") == 3
    assert fetched.count() == 2 and reason.count("https://r.test/gone (HTTP 404 Not Found)") == 1
    assert [(r.href, r.content_type, r.body) for r in FE.fetch_bodies(fetched, snapshot).collect()] == [
        (page, "text/markdown", "# one [a](b)")]
    registry = RV.scan_registry(spark.createDataFrame([(0, f"r|R|{page}")], "line_no int, text string"))
    reviewed = RV.review(registry, snapshot).collect()
    assert [(r.status_code, r.content_type) for r in reviewed] == [(200, "text/markdown")]
