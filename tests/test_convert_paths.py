import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mdweave.operators import convert as CV
from mdweave.operators import paths as PA


def test_to_markdown_literals(spark):
    df = spark.createDataFrame([
        ("https://e.com/a", "text/html", "<h1>Hello</h1>"),
        ("https://e.com/b", "text/plain", "# Title\n\n"),
        ("https://e.com/c", "text/plain", "   "),
        ("https://e.com/d", "application/octet-stream", "PK\x03\x04"),
        ("https://e.com/e.md", "", "no marks here"),
        ("https://e.com/f", "text/plain", "<main>x</main>"),
    ], "url string, content_type string, body string")
    out = {r["url"]: r for r in CV.to_markdown(df).collect()}
    assert out["https://e.com/a"]["content"] == "# Hello\n"
    assert out["https://e.com/b"]["content"] == "# Title\n"
    assert out["https://e.com/c"]["kind"] == "empty" and not out["https://e.com/c"]["ok"]
    assert out["https://e.com/d"]["kind"] == "unsupported"
    assert out["https://e.com/d"]["reason"] == "unsupported content received from https://e.com/d"
    assert out["https://e.com/e.md"]["kind"] == "markdown"
    assert out["https://e.com/f"]["kind"] == "html"  # html wins even for text/plain


def test_html_dialect():
    md = CV.html_to_markdown_text(
        "<html><head><title>x</title><script>var a='<p>';</script></head><body>"
        "<h2>Sub</h2><p>One <b>bold <a href='/x'>link</a></p><ul><li>a</li><li>b</li></ul>"
        "<pre><code>x = 1</code></pre><p>under_score *star*</p></body></html>")
    assert md == ("## Sub\n\nOne **bold [link](/x)**\n\n- a\n\n- b\n\n```\nx = 1\n```\n\n"
                  "under\\_score \\*star\\*")


def paths_df(spark, rows):
    return spark.createDataFrame(rows, "title string, scheme string, host string, path string")


def test_remote_flat_prefix(spark):
    df = paths_df(spark, [("Auth Guide", "https", "example.com", "/guide/auth"),
                          ("", "https", "example.com", "/"), ("", "https", "example.com", "/guide/"),
                          ("", "https", "example.com", "/%20/file"), ("fallback", "https", "example.com", "/%20"),
                          ("", "https", "example.com", "/%20"), ("", "https", "example.com", "/%20/")])
    nested = [r["rel_path"] for r in PA.add_remote_paths(df).collect()]
    assert sorted(nested) == sorted(["guide/auth.md", "index.md", "guide/index.md", "section/file.md",
                                     "fallback.md", "index.md", "section/index.md"])
    flat = {r["path"]: r["rel_path"] for r in PA.add_flat_paths(df.limit(1)).collect()}
    assert flat["/guide/auth"] == "auth-guide.md"
    slug = PA.add_flat_paths(paths_df(spark, [("", "https", "example.com", "/guide/auth"),
                                              ("", "file", "", "/tmp"), ("", "file", "", "/")]))
    assert sorted(r["rel_path"] for r in slug.collect()) == sorted(["example.com-guide-auth.md", "tmp.md",
                                                                    "index.md"])
    pre = spark.createDataFrame([("guide/auth.md", "supabase"), ("a.md", "")], "p string, x string")
    assert [r["o"] for r in pre.select(PA.with_prefix("p", "x").alias("o")).collect()] == [
        "supabase/guide/auth.md", "a.md"]


def test_local_paths(spark):
    """Inside the root, outside, without one; names that clean to nothing; decoded and folded."""
    root = "/var/notes"
    expected = {("/var/notes/garden/Beds.markdown", root): "garden/beds.md", ("/var/notes/garden/", root): "garden/index.md",
                ("/var/notes/%21%21/soil.html", root): "section/soil.md", ("/var/notes/%21%21/", root): "section/index.md",
                ("/var/notes/garden/%2D.md", root): "garden/document.md", ("/srv/other/soil.md", root): "srv-other-soil.md",
                ("/srv/other/soil.md", None): "srv/other/soil.md", ("/var/notes/b%C3%A4ume+1.md", root): "baume-1.md"}
    df = spark.createDataFrame([("", "file", "", p, r) for p, r in expected], "title string, scheme string, host string, path string, local_root_dir string")
    assert {(r["path"], r["local_root_dir"]): r["rel_path"] for r in PA.add_local_paths(df).collect()} == expected


def test_default_prefix(spark):
    rows = [("supabase", "https", "docs.example.com", "/llms.txt"), (None, "https", "docs.example.com", "/x"),
            (None, "file", "", "/tmp/x/llms.txt"), ("!!!", "https", "a.com", "/"), (None, "https", "...", "/"),
            (None, "file", "", "/tmp/!!!/---")]
    df = spark.createDataFrame(rows, "slug string, scheme string, host string, path string")
    got = [r["p"] for r in df.select(F.expr(PA.default_prefix_sql("slug", "scheme", "host", "path")).alias("p"))
           .collect()]
    assert got == ["supabase", "docs-example-com", "llms", "docs", "docs", "docs"]


def numbered_all(spark, lists):
    """The paths of several lists of names, one source each, by one call."""
    df = spark.createDataFrame([(str(s), i, 0, n) for s, names in enumerate(lists) for i, n in enumerate(names)],
                               "source_url string, line_pos long, match_pos int, rel_path string")
    out = [[None] * len(names) for names in lists]
    for r in PA.unique_paths(df, ["source_url"]).collect():
        out[int(r["source_url"])][r["line_pos"]] = r["path"]
    return out


def numbered(spark, names):
    return numbered_all(spark, [names])[0]


def test_unique_paths_literals(spark):
    assert numbered(spark, ["docs/readme.md", "docs/readme.md"]) == ["docs/readme.md", "docs/readme-2.md"]
    assert numbered(spark, ["a.md", "a.md", "a-2.md"]) == ["a.md", "a-2.md", "a-2-2.md"]


def sequential(names):
    """The rule stated row by row: the first of name, name-2, name-3 ... not used yet."""
    used = []
    for n in names:
        k, free = 1, n
        while free in used:
            k += 1
            free = re.sub(r"\.md$", f"-{k}.md", n)
        used.append(free)
    return used


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a.md", "a-2.md", "a-2-2.md", "b.md", "x/a.md", "a-3.md"]), min_size=1,
                         max_size=12), min_size=1, max_size=40))
def test_unique_paths_matches_sequential_model(spark, lists):
    got = numbered_all(spark, lists)
    assert got == [sequential(names) for names in lists]
    assert all(len(set(paths)) == len(paths) for paths in got)


def test_assign_prefixes(spark):
    sources = spark.createDataFrame([
        ("c", "https://a.example.com/llms.txt", 1, None, "https", "a.example.com", "/llms.txt"),
        ("c", "https://supabase.com/llms.txt", 2, "supabase", "https", "supabase.com", "/llms.txt"),
        ("c", "https://example.com/llms.txt", 3, None, "https", "example.com", "/llms.txt"),
        ("d", "https://first.com/llms.txt", 1, None, "https", "first.com", "/llms.txt"),
        ("d", "https://second.com/llms.txt", 2, None, "https", "second.com", "/llms.txt"),
    ], "collection string, source_url string, seq long, slug string, scheme string, host string, path string")
    installs = spark.createDataFrame([("c", 0, "https://a.example.com/llms.txt", "stored")],
                                     "collection string, pos int, source_url string, path_prefix string")
    top = spark.createDataFrame([("c", "example-com")], "collection string, name string")
    got = {r["source_url"]: r["path_prefix"] for r in PA.assign_prefixes(sources, installs, top).collect()}
    assert got == {"https://a.example.com/llms.txt": "stored", "https://supabase.com/llms.txt": "supabase",
                   "https://example.com/llms.txt": "example-com-2", "https://first.com/llms.txt": "",
                   "https://second.com/llms.txt": "second-com"}


def test_unique_paths_hot_group_path(spark):
    names = ["a.md"] * 40 + ["b.md"] * 2 + ["c/x.md"] * 9
    order = list(range(len(names)))
    random.Random(7).shuffle(order)
    df = spark.createDataFrame([("s", order[i], 0, n) for i, n in enumerate(names)],
                               "source_url string, line_pos long, match_pos int, rel_path string")
    out = PA.unique_paths(df, ["source_url"]).orderBy("line_pos").collect()
    by_order = sorted(zip(order, names))
    assert [r["path"] for r in out] == sequential([n for _, n in by_order])


def test_one_duplicate_among_numbered_names(spark):
    names = [f"release-{k}.md" for k in range(300)] + ["release-5.md"]
    got = numbered(spark, names)
    assert got == sequential(names) and got[-1] == "release-5-2.md"
    names = ["release.md"] + [f"release-{k}.md" for k in range(2, 300)] + ["release.md", "release.md"]
    assert numbered(spark, names)[-2:] == ["release-300.md", "release-301.md"]


def test_many_equal_names(spark):
    df = spark.range(30001).selectExpr("'s' AS source_url", "id AS line_pos", "0 AS match_pos",
                                       "if(id < 30000, 'a.md', 'a-2.md') AS rel_path")
    out = PA.unique_paths(df, ["source_url"])
    assert out.agg(F.countDistinct("path")).first()[0] == 30001
    assert [r["path"] for r in out.filter("line_pos > 29998").orderBy("line_pos").collect()] == ["a-30000.md", "a-2-2.md"]


def test_chains_of_numbered_names_match_sequential_model(spark):
    forms = [f"a{x}{y}.md" for x in ["", *(f"-{k}" for k in range(1, 9))] for y in ["", "-2", "-3", "-2-2"]]
    weights = [40 if len(f) == 4 else 3 if len(f) == 6 else 1 for f in forms]
    lists = [random.Random(seed).choices(forms, weights, k=20 + 5 * seed) for seed in range(40)]
    got = numbered_all(spark, lists)
    assert got == [sequential(names) for names in lists]


def test_prefixes_past_taken_and_earlier_ones(spark):
    sources = spark.createDataFrame(
        [("c", f"https://x{k}.com/", k, s, "https", f"x{k}.com", "/") for k, s in enumerate(["a", "a", "a-2", "a", "a.md", "a.md"])],
        "collection string, source_url string, seq long, slug string, scheme string, host string, path string")
    installs = spark.createDataFrame([("c", 0, "https://old.com/", "a-3")],
                                     "collection string, pos int, source_url string, path_prefix string")
    top = spark.createDataFrame([("c", "a"), ("c", "z")], "collection string, name string")
    got = [r["path_prefix"] for r in PA.assign_prefixes(sources, installs, top).orderBy("seq").collect()]
    assert got == ["a-2", "a-4", "a-2-2", "a-5", "a.md", "a.md-2"]


def test_html_keeps_all_text():
    md = CV.html_to_markdown_text
    assert md("<head><meta x><p>one<noscript>two") == "onetwo"
    assert md("<title>t</title><p>a<br>b</p>") == "a  \nb"
    assert md("<pre><code class='language-py'>x = 1\n  y") == "```py\nx = 1\n  y\n```"
    assert md("<p><code>a_b</code> c_d</p>") == "`a_b` c\\_d"
    assert md("<ul><li>a<ul><li><p>b</p></li></ul></li><li>c</li></ul>") == "- a\n\n  - b\n\n- c"
    assert md("<a href='/x'><h2>T</h2></a>") == "## [T](/x)"
    assert md("<p>k</p><script>var x</script><p>l</p>") == "k\n\nl"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-3, 25), max_size=40), st.integers(0, 30), st.integers(0, 40))
def test_what_a_range_of_forms_passes_over(needs, before, cut):
    """One function for many forms, and the functions of two ranges one after the other."""
    def one_by_one(needs, passed):
        for need in needs:
            passed += passed < need
        return passed

    def function(needs):
        f = PA.PassedOver()
        for need in needs:
            f.add(need)
        assert all(a[1] + 1 < b[0] for a, b in zip(f.intervals, f.intervals[1:]))
        return PA.PassedOver(f.intervals)

    assert function(needs)(before) == one_by_one(needs, before)
    assert function(needs[cut:])(function(needs[:cut])(before)) == one_by_one(needs, before)


def test_a_name_dealt_to_several_tasks(spark, monkeypatch):
    """Names with many claimants or forms, in ranges, as the others."""
    monkeypatch.setattr(PA, "HOT_NAME", 4)
    rng = random.Random(3)
    lists = [["a.md"] + [f"a-{k}.md" for k in rng.sample(range(2, 60), 30)] + ["a.md"] * 20 + [f"a-{k}.md" for k in rng.sample(range(2, 90), 30)]
             + ["a-7-2.md"] * 3]
    forms = [f"a{x}{y}.md" for x in ["", *(f"-{k}" for k in range(1, 9))] for y in ["", "-2", "-3", "-2-2"]]
    lists += [rng.choices(forms, k=60) for _ in range(6)]
    for names in lists[:1]:
        rng.shuffle(names)
    got = numbered_all(spark, lists)
    assert got == [sequential(names) for names in lists]


def test_many_trailing_numbers(spark, monkeypatch):
    """The work follows the chains of forms that occur, not the numbers in a name; a long chain takes few steps."""
    from mdweave import session
    written, write = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda *a, **k: written.append(1) or write(*a, **k))
    deep = "a" + "-2" * 4000
    assert numbered(spark, [f"{deep}.md", f"{deep}.md", f"{deep}-2.md"]) == [f"{deep}.md", f"{deep}-2.md", f"{deep}-2-2.md"]
    assert len(written) <= 10
    written.clear()
    chain = ["a.md"] + ["a" + "-2" * k + ".md" for k in range(40)]  # each is taken by the one above
    assert numbered(spark, chain) == sequential(chain) and len(written) <= 16


def test_a_worker_holds_few_bodies_at_once(spark, monkeypatch):
    """Memory of a Python worker over 4,000 bodies of 50,000 characters, against that over one of 50,000."""
    def resident(body):
        with open("/proc/self/statm") as f:
            return f"{len(body)} {int(f.read().split()[1]) * 4096 // 2**20}"

    monkeypatch.setattr(CV, "html_to_markdown_text", resident)

    def most(n):
        df = spark.range(0, n, 1, 1).select(F.lit("html").alias("kind"), F.repeat(F.lit("<p>x</p> y"), 5000).alias("body"))
        out = CV.convert_html_rows(df).select(F.split(F.trim(F.regexp_replace("content", "\n", "")), " ").alias("x"))
        got = out.agg(F.count("*"), F.min(F.col("x")[0].cast("int")), F.max(F.col("x")[1].cast("int"))).first()
        assert (got[0], got[1]) == (n, 50_000)
        return got[2]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")  # Spark's default
    try:
        assert most(4000) - most(1) < 48
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
