"""The whole import on a small case: clashes, local sources, prefixes that W2 assigns,
sources that fail, installs without a source URL, a second run over the first one's output."""

import hashlib

from pyspark.sql import functions as F

from mdweave.operators import sync as SY
from mdweave.plans import ingest as IN
from mdweave.sources import sinks as SK

RES = ("url string, ok boolean, http_status int, status_text string, content_type string, content_length long, "
       "final_url string, error string, body string")


def resources(spark, pages):
    return spark.createDataFrame([(u, True, 200, "OK", "text/markdown", len(b), u, None, b) for u, b in pages], RES)


def run(spark, **previous):
    lines = spark.createDataFrame([
        ("https://a.test/llms.txt", 0, "[G](https://a.test/b-org/guide.md)"), ("https://a.test/llms.txt", 1, "[H](https://a.test/x.md)"),
        ("https://b.org/llms.txt", 0, "[G](https://b.org/guide.md)"),
        ("file:///srv/tw/llms.txt", 0, "[P](./pages/guide.md)"),
        ("https://c.test/llms.txt", 0, "no link here"), ("https://d.test/llms.txt", 0, "[E](https://e.test/q.md)"),
    ], "source_url string, line_pos int, line string")
    sources = spark.createDataFrame([
        ("m", "https://a.test/llms.txt", "nested", None, False, 1, None), ("m", "https://b.org/llms.txt", "nested", None, False, 2, None),
        ("l", "file:///srv/tw/llms.txt", "nested", "", False, 1, "/srv/tw"), ("m", "https://c.test/llms.txt", "nested", "c", False, 3, None),
        ("m", "https://d.test/llms.txt", "nested", "d", False, 4, None), ("m", "https://gone.test/llms.txt", "nested", "g", False, 5, None),
    ], "collection string, source_url string, layout string, path_prefix string, allow_external boolean, seq long, local_root_dir string")
    res = resources(spark, [("https://a.test/b-org/guide.md", "# A guide"), ("https://a.test/x.md", "# X"), ("https://b.org/guide.md", "# B guide"),
                            ("file:///srv/tw/pages/guide.md", "# P")])
    return IN.ingest(lines, sources, res, **previous)


def test_ingest(spark, tmp_path):
    out = run(spark)
    snapshot = {(r.collection, r.path): (r.content, r.content_sha) for r in out["snapshot"].collect()}
    # the first source has no prefix and writes b-org/, so the second is numbered past it
    assert {k: v[0] for k, v in snapshot.items()} == {
        ("m", "b-org/guide.md"): "# A guide\n", ("m", "x.md"): "# X\n", ("m", "b-org-2/guide.md"): "# B guide\n", ("l", "pages/guide.md"): "# P\n"}
    assert all(hashlib.sha256(c.encode()).hexdigest() == sha for c, sha in snapshot.values())
    assert out["path_clashes"].count() == 0
    failed = {r.source_url: r.reason for r in out["source_failures"].collect()}
    assert failed == {"https://c.test/llms.txt": "no links in the index", "https://d.test/llms.txt": "no link is allowed",
                      "https://gone.test/llms.txt": "no index"}
    summary = {r.source_url: (r.run_status, r.successes, r.added) for r in IN.ingest_summary(out).collect()}
    assert summary["https://a.test/llms.txt"] == ("ok", 2, 2) and len(summary) == 6
    assert all(summary[u] == ("failed", 0, 0) for u in failed)
    installs = {r.source_url: (r.pos, r.path_prefix) for r in out["installs"].filter("collection = 'm'").collect()}
    assert installs == {"https://a.test/llms.txt": (0, ""), "https://b.org/llms.txt": (1, "b-org-2")}
    # what was written is where the next run starts
    SK.write_manifest({k: out[k] for k in SK.MANIFEST_TABLES}, str(tmp_path / "m"), "1")
    SK.write_snapshot(out["snapshot"], str(tmp_path / "s"), "1")
    manifest = SK.read_manifest(spark, str(tmp_path / "m"))
    corpus = SK.read_snapshot(spark, str(tmp_path / "s"))
    again = run(spark, **manifest, corpus=corpus)
    assert {r.source_url: r.up_to_date for r in again["summary"].collect()} == {
        "https://a.test/llms.txt": True, "https://b.org/llms.txt": True, "file:///srv/tw/llms.txt": True}
    assert again["snapshot"].count() == 4


def test_clashing_documents_are_reported(spark):
    docs = spark.createDataFrame([("c", "s1", "u1", 0, 0, True, "x.md", "h1", None), ("c", "s2", "u2", 0, 0, True, "x.md", "h2", None),
                                  ("c", "s2", "u3", 1, 0, True, "y.md", "h3", None)],
                                 "collection string, source_url string, url string, line_pos int, match_pos int, ok boolean, path string, "
                                 "content_sha string, reason string")
    assert sorted((r.path, r.content_sha) for r in SY.first_documents(docs).collect()) == [("x.md", "h1"), ("y.md", "h3")]
    assert [(r.path, r.url, r.written_url) for r in SY.path_clashes(docs).collect()] == [("x.md", "u2", "u1")]


def test_every_install_is_kept_with_its_own_lists(spark):
    """Nameless and repeated installs keep place, record and lists; a source that runs replaces each of its installs."""
    installs = spark.createDataFrame(
        [("c", 0, None, "A", "flat", "a", '{"label":"A"}'), ("c", 1, None, "B", None, None, None), ("c", 2, "u", "C", "nested", "", '{"kept":1,"url":"u"}'),
         ("c", 3, "run", "first", "flat", "p", "{}"), ("c", 4, "u", "D", "flat", "d", '{"url":"u"}'), ("c", 5, "run", "second", "flat", "q", "{}")],
        "collection string, pos int, source_url string, source_label string, layout string, path_prefix string, source string")
    managed = spark.createDataFrame([("c", 0, None, "a"), ("c", 1, None, "b"), ("c", 2, "u", "c.md"), ("c", 4, "u", "d.md"), ("c", 3, "run", "old1.md"),
                                     ("c", 5, "run", "old2.md")], "collection string, pos int, source_url string, path string")
    urls = spark.createDataFrame([("c", 0, None, "https://x/1", (0, 0)), ("c", 1, None, "https://x/2", (0, 0)), ("c", 5, "run", "https://x/3", (0, 0))],
                                 f"collection string, pos int, source_url string, url string, ord {SY.ORD}")
    schema = ("collection string, source_url string, url string, line_pos int, match_pos int, ok boolean, path string, "
              "content_sha string, reason string")
    runs = "collection string, source_url string, source_label string, layout string, path_prefix string, seq long"
    # two links of one line are selected; a new source is appended
    fetched = spark.createDataFrame([("c", "run", "https://x/a", 3, 1, True, "a.md", "h", None), ("c", "run", "https://x/b", 3, 0, True, "b.md", "h", None),
                                     ("c", "new", "https://x/n", 0, 0, True, "n.md", "h", None)], schema)
    sources = spark.createDataFrame([("c", "run", "R", "nested", "p", 1), ("c", "new", "N", "nested", "n", 2)], runs)
    corpus = spark.createDataFrame([], "collection string, path string, content_sha string")
    for failed, old in ((False, set()), (True, {"old1.md"})):
        docs = fetched.unionByName(spark.createDataFrame([("c", "run", "https://x/f", 9, 0, False, None, None, "gone")], schema)) if failed else fetched
        plan = SY.install_plan(docs, installs, managed, corpus)
        new, files, chosen = SY.upsert_manifest(installs, managed, urls, docs, docs, SY.plan_summary(plan, docs, installs), sources)
        assert sorted((r.pos, r.source_label, r.layout, r.path_prefix, r.source) for r in new.collect()) == [
            (0, "A", "flat", "a", '{"label":"A"}'), (1, "B", "nested", "", "{}"), (2, "C", "nested", "", '{"kept":1,"url":"u"}'),
            (3, "R", "nested", "p", '{"label":"R","url":"run"}'), (4, "D", "flat", "d", '{"url":"u"}'),
            (5, "R", "nested", "p", '{"label":"R","url":"run"}'), (6, "N", "nested", "n", '{"label":"N","url":"new"}')]
        lists = {}
        for r in files.collect():
            lists.setdefault(r.pos, set()).add(r.path)
        own = {"a.md", "b.md"} | old
        assert lists == {0: {"a"}, 1: {"b"}, 2: {"c.md"}, 3: own, 4: {"d.md"}, 5: own, 6: {"n.md"}}
        order = {}
        for r in chosen.orderBy("pos", "ord").collect():
            order.setdefault(r.pos, []).append(r.url)
        own = ["https://x/b", "https://x/a"] + ["https://x/f"] * failed
        assert order == {0: ["https://x/1"], 1: ["https://x/2"], 3: own, 5: own, 6: ["https://x/n"]}
        # what comes out goes in again
        assert [new.schema[c].dataType for c in installs.columns] == [f.dataType for f in installs.schema]
        assert [chosen.schema[c].dataType for c in urls.columns] == [f.dataType for f in urls.schema]
        again = SY.upsert_manifest(new, files, chosen, docs.limit(0), docs.limit(0), SY.plan_summary(plan.limit(0), docs.limit(0), new), sources.limit(0))
        assert again[1].count() == files.count() and again[2].count() == chosen.count()


def test_padded_port(spark):
    from mdweave.functions.urls import parse_urls
    df = parse_urls(spark.createDataFrame([("https://a.com:000443/x",), ("https://a.com:0008080/",), ("https://a.com:99999/",)], "u string"), "u", "p")
    assert [(r.p.status, r.p.href) for r in df.collect()][:2] == [("ok", "https://a.com/x"), ("ok", "https://a.com:8080/")]
    assert df.collect()[2].p.status == "invalid"


def test_pointer_errors_are_not_swallowed(spark, tmp_path):
    assert SK.current_version(spark, str(tmp_path / "none")) is None
    df = spark.createDataFrame([("c", "p")], "collection string, path string")
    for v in ("9", "10"):  # the newest is the last written, not the greatest name
        SK.write_snapshot(df, str(tmp_path / "s"), v)
    assert SK.current_version(spark, str(tmp_path / "s")) == "v=10"
