"""Documents as files: changes only, removal and pruning, failed and broken-off runs."""

import os

import pytest
from pyspark.sql import functions as F

from mdweave.sources import tree as TR

SCHEMA = "collection string, path string, content string, deleted boolean"


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read()
            for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def folders(root):
    return sorted(os.path.relpath(d, root) for d, _, _ in os.walk(root) if d != root and TR.STAGING not in d)


def test_changes_removal_and_pruning(spark, tmp_path):
    root = str(tmp_path / "tree")
    assert TR.read_tree(spark, root) is None
    first = [("a", "x.md", "X\n", False), ("a", "deep/er/y.md", "é\n", False), ("a", "deep/z+ü %.md", "Z\n", False), ("b", "q/r/s.md", None, False)]
    TR.write_tree(spark.createDataFrame(first, SCHEMA).repartition(3), root)
    assert files(root) == {"a/x.md": "X\n", "a/deep/er/y.md": "é\n", "a/deep/z+ü %.md": "Z\n", "b/q/r/s.md": ""}
    got = TR.read_tree(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted((c, p, t) for c, p, t, _ in first if t)
    (tmp_path / "tree" / "a" / "deep" / "er" / "own.txt").write_text("by hand")
    second = [("a", "x.md", "X2\n", False), ("a", "deep/er/y.md", None, True), ("b", "q/r/s.md", None, True), ("b", "never.md", None, True), ("a", "new/n.md", "N\n", False)]
    TR.write_tree(spark.createDataFrame(second, SCHEMA).repartition(3), root)
    assert files(root) == {"a/x.md": "X2\n", "a/deep/z+ü %.md": "Z\n", "a/new/n.md": "N\n", "a/deep/er/own.txt": "by hand"}
    assert folders(root) == ["a", "a/deep", "a/deep/er", "a/new"]  # b had nothing left; other files keep their folder
    assert os.listdir(tmp_path / "tree" / TR.STAGING) == []


def test_a_failed_run_leaves_the_old_tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    TR.write_tree(spark.createDataFrame([("a", "x.md", "X\n", False)], SCHEMA), root)
    bad = spark.createDataFrame([("a", f"{k}.md", "new", False) for k in range(20)] + [("a", "../../out.md", "no", False)], SCHEMA)
    with pytest.raises(Exception, match="not a path below the tree"):
        TR.write_tree(bad.repartition(4), root)
    assert files(root) == {"a/x.md": "X\n"} and not (tmp_path / "out.md").exists()
    assert os.listdir(tmp_path / "tree" / TR.STAGING) == []
    for path in ("", "/x", "a//b", "a/./b", ".staging/x"):
        with pytest.raises(ValueError):
            TR.checked(path)


def test_a_run_that_broke_off_is_completed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    TR.write_tree(spark.createDataFrame([("a", "x/1.md", "old", False), ("a", "x/2.md", "old", False)], SCHEMA), root)
    move = TR._move_into

    def half(root, run, tasks):
        move(root, run, tasks.limit(1))
        raise RuntimeError("lost")

    monkeypatch.setattr(TR, "_move_into", half)
    later = spark.createDataFrame([("a", f"y/{k}.md", "new", False) for k in range(8)] + [("a", f"x/{k}.md", None, True) for k in (1, 2)], SCHEMA)
    with pytest.raises(RuntimeError, match="lost"):
        TR.write_tree(later.repartition(4, F.col("path")), root)
    monkeypatch.setattr(TR, "_move_into", move)
    assert TR.complete(spark, root) == 1 and TR.complete(spark, root) == 0
    assert files(root) == {f"a/y/{k}.md": "new" for k in range(8)} and folders(root) == ["a", "a/y"]


def test_many_files_are_read_in_few_tasks(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = [(f"c{k % 3}", f"{k % 7}/{k % 2}/{k}.md" if k % 5 else f"{k}.md", f"{k} é\n", False) for k in range(400)]
    TR.write_tree(spark.createDataFrame(rows, SCHEMA).repartition(4), root)
    for name in (".hidden/x.md", "c0/_own/y.md", "c0/.z.md", "c0/_z.md", "c1/none.md", "top.md"):
        path = tmp_path / "tree" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("" if "none" in name else name)
    got = TR.read_tree(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted([(c, p, t) for c, p, t, _ in rows] + [("top.md", "top.md", "top.md")])
    assert got.rdd.getNumPartitions() == 1  # binaryFile: one for 32 files
    TR.write_tree(spark.createDataFrame([(c, p, None, True) for c, p, _, _ in rows], SCHEMA), str(tmp_path / "tree"))
    assert [tuple(r) for r in TR.read_tree(spark, root).collect()] == [("top.md", "top.md", "top.md")]
    (tmp_path / "bare").mkdir()
    assert TR.read_tree(spark, str(tmp_path / "bare")).collect() == []


def test_contents_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TR, "HELD", 1000)
    monkeypatch.setattr(TR, "FILES", 20)
    monkeypatch.setattr(TR, "BYTES", 5000)
    monkeypatch.setattr(TR, "NAMES", 3)
    root = str(tmp_path / "tree")
    rows = [("a", f"{k}.md", "é" * (k * 30 + 1), False) for k in range(50)]
    TR.write_tree(spark.createDataFrame(rows, SCHEMA), root)
    got = TR.read_tree(spark, root)
    assert sorted(map(tuple, got.collect())) == sorted((c, p, t) for c, p, t, _ in rows)
    assert got.rdd.getNumPartitions() == 15  # 73,600 bytes


def test_each_task_moves_one_folder(spark, tmp_path, monkeypatch):
    seen, move = [], TR._move_into

    def spied(root, run, tasks):
        seen.extend(r["count"] for r in tasks.groupBy(F.spark_partition_id()).count().collect())
        move(root, run, tasks)

    monkeypatch.setattr(TR, "_move_into", spied)
    rows = [("a", f"{k}.md", "new", False) for k in range(64)]
    TR.write_tree(spark.createDataFrame(rows, SCHEMA).repartition(16), str(tmp_path / "tree"))
    assert seen == [1] * 16
