from mdweave.operators import review as RV
from mdweave.operators import sync as SY
from mdweave.sources import manifest as MF

SRC = "https://e.com/llms.txt"


def sync_tables(spark, same_source=True, fail=False):
    installs = spark.createDataFrame([("c", 0, SRC, "E", "nested", "", "{}")] if same_source else [],
                                     "collection string, pos int, source_url string, source_label string, "
                                     "layout string, path_prefix string, source string")
    managed = spark.createDataFrame([("c", 0, SRC, p) for p in ("keep.md", "change.md", "remove.md")],
                                    "collection string, pos int, source_url string, path string")
    corpus = spark.createDataFrame([("c", "keep.md", "k"), ("c", "change.md", "old"), ("c", "remove.md", "r")],
                                   "collection string, path string, content_sha string")
    rows = [("c", SRC, "u1", 0, 0, True, "keep.md", "k", None), ("c", SRC, "u2", 1, 0, True, "change.md", "new", None)]
    if fail:
        rows.append(("c", SRC, "u3", 2, 0, False, None, None, "boom"))
    fetched = spark.createDataFrame(rows, "collection string, source_url string, url string, line_pos long, "
                                          "match_pos int, ok boolean, path string, content_sha string, reason string")
    return installs, managed, corpus, fetched


def plan_of(spark, **kw):
    installs, managed, corpus, fetched = sync_tables(spark, **kw)
    plan = SY.install_plan(fetched, installs, managed, corpus)
    return {r["path"]: r["change"] for r in plan.collect()}, installs, managed, corpus, fetched, plan


def test_install_plan_and_gate(spark):
    got, *_ = plan_of(spark)
    assert got == {"keep.md": "unchanged", "change.md": "changed", "remove.md": "removed"}
    got, *_ = plan_of(spark, fail=True)
    assert got == {"keep.md": "unchanged", "change.md": "changed"}  # removals paused
    got, *_ = plan_of(spark, same_source=False)
    assert got == {"keep.md": "added", "change.md": "added"}


def test_summary_apply_and_manifest(spark):
    _, installs, managed, corpus, fetched, plan = plan_of(spark, fail=True)
    s = SY.plan_summary(plan, fetched, installs).first()
    assert (s["successes"], s["failures"], s["total_changes"], s["up_to_date"]) == (2, 1, 1, False)
    summary = SY.plan_summary(plan, fetched, installs)
    snap = {r["path"]: r["content_sha"] for r in SY.apply_plan(corpus, fetched, plan, summary).collect()}
    assert snap == {"keep.md": "k", "change.md": "new", "remove.md": "r"}
    run_sources = spark.createDataFrame([("c", SRC, "E", "nested", "", 1)],
                                        "collection string, source_url string, source_label string, layout string, "
                                        "path_prefix string, seq long")
    sel_urls = spark.createDataFrame([], f"collection string, pos int, source_url string, url string, ord {SY.ORD}")
    selected = fetched.select("collection", "source_url", "url", "line_pos", "match_pos")
    inst, man, sel = SY.upsert_manifest(installs, managed, sel_urls, fetched, selected, summary, run_sources)
    assert sorted(r["path"] for r in man.collect()) == ["change.md", "keep.md", "remove.md"]  # union with failures
    assert [r["pos"] for r in inst.collect()] == [0]
    assert sorted(r["url"] for r in sel.collect()) == ["u1", "u2", "u3"]


def test_up_to_date(spark):
    installs, managed, corpus, _ = sync_tables(spark)
    managed = managed.filter("path = 'keep.md'")
    fetched = spark.createDataFrame([("c", SRC, "u1", 0, 0, True, "keep.md", "k", None)],
                                    "collection string, source_url string, url string, line_pos long, "
                                    "match_pos int, ok boolean, path string, content_sha string, reason string")
    plan = SY.install_plan(fetched, installs, managed, corpus)
    assert SY.plan_summary(plan, fetched, installs).first()["up_to_date"]


def test_previous_selection(spark):
    installs, *_ = sync_tables(spark)
    entries = spark.createDataFrame([("c", SRC, "one", 0, 0), ("c", SRC, "two", 1, 0)],
                                    "collection string, source_url string, url string, line_pos long, match_pos int")
    prev = spark.createDataFrame([("c", 0, SRC, "two", (0, 0))], f"collection string, pos int, source_url string, url string, ord {SY.ORD}")
    assert [r["url"] for r in SY.select_previous(entries, installs, prev).collect()] == ["two"]
    none = spark.createDataFrame([("c", 0, SRC, "gone", (0, 0))], f"collection string, pos int, source_url string, url string, ord {SY.ORD}")
    assert sorted(r["url"] for r in SY.select_previous(entries, installs, none).collect()) == ["one", "two"]
    assert [r["url"] for r in SY.select_explicit(entries, prev).collect()] == ["two"]


def test_manifest_versions(spark):
    v1 = '{"source": {"label": "L", "url": "https://e.com/llms.txt"}, "managedFiles": ["b.md", "a.md"]}'
    v2 = '{"version": 2, "installs": [{"source": {"url": "https://x/llms.txt"}, "pathPrefix": "p"}, null]}'
    only_version = '{"version": 2}'
    raw = spark.createDataFrame([("c1", v1), ("c2", v2), ("c3", only_version), ("c4", "not json")],
                                "collection string, text string")
    t = MF.manifest_tables(raw)
    inst = sorted((r["collection"], r["source_url"]) for r in t["installs"].collect())
    assert inst == [("c1", "https://e.com/llms.txt"), ("c2", "https://x/llms.txt")]
    assert sorted(r["path"] for r in t["managed_files"].collect()) == ["a.md", "b.md"]


def registry(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, text string")


def test_registry_scan_and_duplicates(spark):
    reg = RV.scan_registry(registry(spark, ["# orchards", "  ", "pome|Apples and pears|https://pome.test/llms.txt|more", "POME|Quinces|https://q.test/llms.txt",
                                            "stone |  ", "| Berries |https://berry.test/llms.txt"]))
    rows = reg.orderBy("line_no").collect()
    assert [(r["slug"], r["label"], r["url"], r["valid"]) for r in rows] == [
        ("pome", "Apples and pears", "https://pome.test/llms.txt", True), ("POME", "Quinces", "https://q.test/llms.txt", True),
        ("stone", "", "", False), ("", "Berries", "https://berry.test/llms.txt", False)]
    d = RV.duplicate_flags(reg).orderBy("line_no").collect()
    assert [(r["duplicate_slug"], r["duplicate_url"]) for r in d] == [(True, False), (True, False), (False, False), (False, False)]


def test_review_rules(spark):
    reg = RV.scan_registry(registry(spark, [
        "ok|Ok|https://ok.test/llms.txt", "big|Big|https://big.test/llms.txt", "bin|Bin|https://bin.test/llms.txt",
        "down|Down|https://down.test/llms.txt", "local|Local|http://localhost/llms.txt",
        "cred|Cred|https://u:p@c.test/llms.txt", "||"]))
    res = spark.createDataFrame([
        ("https://ok.test/llms.txt", True, 200, "OK", "text/plain", 42, "https://ok.test/llms.txt", None,
         "- [a](https://ok.test/a)"),
        ("https://big.test/llms.txt", True, 200, "OK", "text/html", 2000000, "https://other.test/x", None,
         "<!doctype html><p>no links</p>"),
        ("https://bin.test/llms.txt", True, 200, "OK", "application/octet-stream", 0, "https://bin.test/llms.txt",
         None, "[a](b)"),
        ("https://down.test/llms.txt", False, 503, "Service Unavailable", None, None, None, None, None),
    ], "url string, ok boolean, http_status int, status_text string, content_type string, content_length long, "
       "final_url string, error string, body string")
    out = {r["slug"]: r for r in RV.review(reg, res).collect()}
    assert out["ok"]["verdict"] == "safe" and out["ok"]["notes"] == ["Fetched 42 bytes."]
    assert out["big"]["verdict"] == "needs-review" and len(out["big"]["warnings"]) == 4
    assert out["big"]["notes"] == ["Fetched 2,000,000 bytes."]
    assert out["bin"]["issues"] == ["Unexpected content type: application/octet-stream."]
    assert out["down"]["issues"] == ["Fetch failed with HTTP 503."] and out["down"]["status_code"] == 503
    assert out["local"]["issues"] == [RV.MSG_HTTPS, RV.MSG_PRIVATE] and out["local"]["status_code"] == 0
    assert out["cred"]["issues"] == [RV.MSG_CREDENTIALS]
    assert out[""]["issues"] == [RV.MSG_MISSING, RV.MSG_INVALID]
    counts = RV.verdict_counts(RV.review(reg, res)).first()
    assert (counts["safe"], counts["needs_review"], counts["unsafe"]) == (1, 1, 5)
    lines = [r["line"] for r in RV.report_lines(RV.review(reg, res)).orderBy("section", "ord", "sub").collect()]
    assert lines[0] == RV.REPORT_MARKER and lines[-1] == RV.REPORT_FOOTER
    assert "| ok | safe | 200 | Fetched 42 bytes. |" in lines


def test_source_resolution(spark):
    reg = RV.strict_registry(registry(spark, ["stripe|Stripe Docs|https://docs.stripe.com/llms.txt",
                                              "local|Local|file:///srv/docs/llms.txt"]))
    inputs = spark.createDataFrame([(0, "stripe"), (1, " STRIPE DOCS "), (2, "./stripe"), (3, "unknown"),
                                    (4, "https://e.com/x#top"), (5, "local")], "input_id int, input string")
    got = {r["input_id"]: (r["kind"], r["label"], r["url"], r["local_root_dir"])
           for r in RV.resolve_sources(inputs, reg, "/work/project").collect()}
    assert got[0] == ("registry", "Stripe Docs (stripe)", "https://docs.stripe.com/llms.txt", None)
    assert got[1][0] == "registry"
    assert got[2] == ("path", "/work/project/stripe", "file:///work/project/stripe", "/work/project")
    assert got[3][0] == "path"
    assert got[4] == ("url", "https://e.com/x#top", "https://e.com/x#top", None)
    assert got[5] == ("registry", "Local (local)", "file:///srv/docs/llms.txt", "/srv/docs")


def test_ingest_assigns_prefixes(spark):
    from mdweave.plans import ingest as IN
    lines = spark.createDataFrame([
        ("https://a.com/llms.txt", 0, "- [Guide](https://a.com/guide)"),
        ("https://b.org/llms.txt", 0, "- [Intro](https://b.org/guide)"),
    ], "source_url string, line_pos long, line string")
    sources = spark.createDataFrame([
        ("c", "https://a.com/llms.txt", "nested", None, False, 1),
        ("c", "https://b.org/llms.txt", "nested", None, False, 2),
    ], "collection string, source_url string, layout string, path_prefix string, allow_external boolean, seq long")
    res = spark.createDataFrame([
        ("https://a.com/guide", True, 200, "OK", "text/markdown", 3, "https://a.com/guide", None, "# A"),
        ("https://b.org/guide", True, 200, "OK", "text/markdown", 3, "https://b.org/guide", None, "# B"),
    ], "url string, ok boolean, http_status int, status_text string, content_type string, content_length long, "
       "final_url string, error string, body string")
    out = IN.ingest(lines, sources, res)
    got = {r["source_url"]: r["path"] for r in out["docs"].collect()}
    assert got == {"https://a.com/llms.txt": "guide.md", "https://b.org/llms.txt": "b-org/guide.md"}
    s = {r["source_url"]: (r["added"], r["run_status"]) for r in IN.ingest_summary(out).collect()}
    assert s == {"https://a.com/llms.txt": (1, "ok"), "https://b.org/llms.txt": (1, "ok")}
