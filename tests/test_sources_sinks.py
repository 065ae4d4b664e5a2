from pyspark.sql import functions as F

from mdweave import session
from mdweave.operators import review as RV
from mdweave.operators import paths as PA
from mdweave.sources import link_index as LI
from mdweave.sources import manifest as MF
from mdweave.sources import resources as RS
from mdweave.sources import sinks as SK
from mdweave.session import materialize, remove_stages


def test_index_files_and_failures(spark, tmp_path):
    d = tmp_path / "site"
    d.mkdir()
    (d / "llms.txt").write_text("# Site\n- [Guide](./guide.md)\n- [Ext](https://x.org/a)\n", encoding="utf-8")
    idx = LI.read_index_files(spark, str(d / "llms.txt"))
    row = idx.first()
    assert row["source_url"] == f"file://{d}/llms.txt" and "[Guide]" in row["body"]
    lines = LI.index_lines(idx)
    assert [r["line_pos"] for r in lines.orderBy("line_pos").collect()] == [0, 1, 2, 3]
    requested = spark.createDataFrame([(row["source_url"],), ("file:///missing/llms.txt",)], "source_url string")
    fails = LI.source_failures(requested, idx).collect()
    assert [(r["source_url"], r["reason"]) for r in fails] == [
        ("file:///missing/llms.txt", "Failed to load llms.txt: not found")]


def test_local_files_as_resources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\n", encoding="utf-8")
    (tmp_path / "b.html").write_text("<h1>B</h1>", encoding="utf-8")
    res = {r["url"].rsplit("/", 1)[1]: r for r in RS.read_local_files(spark, str(tmp_path)).collect()}
    assert res["a.md"]["content_type"] == "text/markdown" and res["a.md"]["body"] == "# A\n"
    assert res["b.html"]["content_type"] == "text/html" and res["b.html"]["ok"]


def test_versioned_snapshot(spark, tmp_path):
    root = str(tmp_path / "corpus")
    v1 = spark.createDataFrame([("c", "a.md", "1")], "collection string, path string, content_sha string")
    SK.write_snapshot(v1, root, "1")
    assert SK.current_version(spark, root) == "v=1"
    v2 = spark.createDataFrame([("c", "a.md", "2"), ("c", "b.md", "3")], "collection string, path string, "
                                                                         "content_sha string")
    SK.write_snapshot(v2, root, "2")
    assert SK.read_snapshot(spark, root).count() == 2
    assert spark.read.parquet(f"{root}/v=1").count() == 1  # the previous version is untouched


def test_review_sinks(spark, tmp_path):
    reg = RV.scan_registry(spark.createDataFrame([(0, "a|A|http://a.test/llms.txt")], "line_no int, text string"))
    res = spark.createDataFrame([], "url string, ok boolean, http_status int, status_text string, "
                                    "content_type string, content_length long, final_url string, error string, "
                                    "body string")
    reviewed = RV.review(reg, res)
    SK.write_review(reviewed, RV.report_lines(reviewed), str(tmp_path / "json"), str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    assert text.splitlines()[0] == RV.REPORT_MARKER and "| a | unsafe | n/a |" in text
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_label_locale_order(spark):
    labels = ["b", "B", "a", "Z", "é", "e"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "line_no int, label string")
    got = [r["label"] for r in df.orderBy(*RV.label_order()).collect()]
    assert got == ["a", "b", "B", "e", "é", "Z"]  # locale order, not code-unit order
    assert [r["label"] for r in df.orderBy(F.col("label")).collect()] != got


def test_manifest_keeps_json_types(spark):
    raw = spark.createDataFrame([
        ("a", '{"installs":[{"source":{"url":"u"},"managedFiles":["b",1,"a",null,["c"]],"selectedUrls":["y",2,"x"]},null,"s"]}'),
        ("b", '{"pathPrefix":null}'), ("c", '{"installs":[{'), ("d", '[1]'), ("e", None), ("f", '{"version":2}'),
        ("g", '{"source":"text","layout":3,"managedFiles":"one"}')], "collection string, text string")
    t = MF.manifest_tables(raw)
    assert sorted((r.collection, r.pos, r.source_url, r.layout, r.path_prefix) for r in t["installs"].collect()) == [
        ("a", 0, "u", None, None), ("b", 0, None, None, None), ("g", 0, None, None, None)]
    assert sorted(r.path for r in t["managed_files"].collect()) == ["a", "b"]
    assert sorted((r.pos, r.ord.line_pos, r.url) for r in t["selected_urls"].collect()) == [(0, 0, "y"), (0, 1, "x")]


def test_positions(spark):
    df = spark.createDataFrame([(i, str(i * 7 % 40)) for i in range(200)], "n int, s string")
    got = {r.n: r.position for r in PA.positions(df, [F.col("s"), F.col("n")]).collect()}
    model = sorted(range(200), key=lambda i: (str(i * 7 % 40), i))
    assert got == {n: k for k, n in enumerate(model, 1)}
    assert PA.positions(df.filter("n < 0"), [F.col("n")]).count() == 0


def test_stage_tables_are_removed(spark):
    df = materialize(spark.range(3), "table")
    assert df.count() == 3 and spark.sparkContext.applicationId in df.inputFiles()[0]
    assert remove_stages(spark) and not remove_stages(spark)


def test_scratch_tables_are_dropped(spark):
    name = session.scratch_table(spark)
    spark.range(3).write.option("path", session.scratch_folder(spark, "t")).saveAsTable(name)
    assert spark.table(name).count() == 3
    session.remove_stages(spark)
    assert not spark.catalog.tableExists(name)


def test_no_scratch_folder_on_a_cluster():
    import types

    from mdweave.session import ensure_checkpoint_dir
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None), sparkContext=context)
    try:
        ensure_checkpoint_dir(session)
    except RuntimeError:
        return
    raise AssertionError("a machine-local folder was accepted")


def test_index_files_in_byte_ranges(spark, tmp_path):
    """The line numbers of one reader, wherever the borders are: between \\r and \\n, in long and empty lines, without a last line end."""
    import re
    files = {"a": "# x\r\n\r\n- [one](./1)\r\n" * 40 + "tail\r", "b": "\n\n" + "y" * 300 + "\nlast", "c": "", "d": "only", "e": "é\r\n" * 50 + "lone\rreturn\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    expected = sorted((f"file://{tmp_path}/{n}", k, line) for n, t in files.items() for k, line in enumerate(re.split("\r?\n", t)) if line)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("17b", "64b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = LI.read_index_lines(spark, str(tmp_path))
            # (a lone \\r at the very end is no line end for the reader of whole texts)
            rows = sorted((r.source_url, r.line_pos, r.line) for r in got.collect() if r.line)
            assert [(u, k, x.rstrip("\r")) for u, k, x in expected] == rows
            if size == "17b":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
