"""The log: changes only, newest row wins, compaction changes nothing, broken and competing writers."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from mdweave.operators import sync as SY
from mdweave.sources import log, pointers
from mdweave.sources import sinks as SK

KEY = ["collection", "path"]
SCHEMA = "collection string, path string, content_sha string, content string"


def table(spark, state):
    return spark.createDataFrame([(*k, v, f"text {v}") for k, v in state.items()], SCHEMA)


def rows(df):
    return {(r.collection, r.path): r.content_sha for r in df.collect()}


def test_runs_fold_to_the_last_state(spark, tmp_path):
    """Random runs with null keys, removals and keys that come back; compaction at any time."""
    root, rng, state, written = str(tmp_path / "log"), random.Random(4), {}, []
    keys = [(c, p) for c in ("a", None, "") for p in ("x", "y/z", None, "", "w")]
    assert log.read(spark, root, KEY) is None
    for run in range(7):
        for k in rng.sample(keys, 5):
            if k in state and rng.random() < 0.5:
                del state[k]
            else:
                state[k] = f"{run}"
        before = log.read(spark, root, KEY)
        delta = log.changes(before.drop("seq") if before is not None else None, table(spark, state), KEY)
        assert log.append(delta, root, KEY) == run + 1
        written.append(log.segments(spark, root)[1][-1]["rows"])
        got = log.read(spark, root, KEY)
        assert rows(got) == state and {r.content_sha: r.seq for r in got.collect()}.items() <= {str(k): k + 1 for k in range(7)}.items()
        if run in (2, 6):
            seqs = {(r.collection, r.path): r.seq for r in got.collect()}
            assert log.compact(spark, root, KEY, fan=2) > 0
            again = log.read(spark, root, KEY)
            assert rows(again) == state and {(r.collection, r.path): r.seq for r in again.collect()} == seqs
    assert max(written[1:]) <= 5
    assert log.expire(spark, root) > 0 and rows(log.read(spark, root, KEY)) == state
    assert log.changes(log.read(spark, root, KEY).drop("seq"), table(spark, state), KEY).count() == 0


def test_size_classes():
    segments = lambda *n: [{"rows": x} for x in n]
    assert log.to_compact(segments(1000, 10, 10, 10), 4) is None
    assert log.to_compact(segments(1000, 10, 10, 10, 10), 4) == (1, 5)
    assert log.to_compact(segments(10, 10, 10, 10, 1000), 4) == (0, 5)
    assert log.to_compact(segments(100000, 300, 300, 300, 300, 1), 4) == (1, 5)
    assert log.to_compact([], 4) is None


def test_a_small_run_writes_little(spark, tmp_path):
    root = str(tmp_path / "log")
    first = spark.range(2000).select(F.lit("c").alias("collection"), F.col("id").cast("string").alias("path"), F.lit("old").alias("content_sha"),
                                     F.repeat(F.col("id").cast("string"), 50).alias("content"))
    log.append(log.changes(None, first, KEY), root, KEY)
    second = first.withColumn("content_sha", F.when(F.col("path") == "77", "new").otherwise(F.col("content_sha"))).filter("path <> '99'")
    log.append(log.changes(log.read(spark, root, KEY).drop("seq"), second, KEY), root, KEY)
    assert [s["rows"] for s in log.segments(spark, root)[1]] == [2000, 2]
    assert log.read(spark, root, KEY).filter("seq = 2").count() == 1 and log.read(spark, root, KEY).count() == 1999


def test_broken_and_competing_writers(spark, tmp_path):
    root = str(tmp_path / "log")
    log.append(log.changes(None, table(spark, {("a", "x"): "1"}), KEY), root, KEY)
    number, _ = log.segments(spark, root)
    # a segment without a pointer, and a pointer that broke off: neither is followed, and the number is not used again
    table(spark, {("a", "x"): "lost"}).write.parquet(f"{root}/segments/lost")
    broken = tmp_path / "log" / "pointers" / f"{number + 1:012d}"
    broken.write_text('{"first":')
    assert rows(log.read(spark, root, KEY)) == {("a", "x"): "1"}
    with pytest.raises(pointers.Conflict):  # it may still be written
        pointers.publish(spark, root, ["x"], number)
    os.utime(broken, (0, 0))
    assert pointers.publish(spark, root, pointers.newest(spark, root)[1], number) == number + 2
    with pytest.raises(pointers.Conflict):  # made against an older state
        log.append(log.changes(None, table(spark, {}), KEY), root, KEY, after=number)
    assert log.expire(spark, root) == 1
    # snapshots of runs that end at once get a pointer each
    df = table(spark, {("a", "x"): "1"})
    threads = [threading.Thread(target=SK.write_snapshot, args=(df, str(tmp_path / "s"), str(v))) for v in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(p.name for p in (tmp_path / "s" / "pointers").iterdir() if p.name[0] != ".") == [f"{n:012d}" for n in range(1, 5)]
    assert SK.read_snapshot(spark, str(tmp_path / "s")).count() == 1


def test_delta_of_a_plan(spark):
    """Folding the delta gives what ``apply_plan`` gives: clashes, unchanged and removed paths, sources that are up to date."""
    corpus = spark.createDataFrame([("c", "same", "s", "S"), ("c", "edit", "old", "O"), ("c", "gone", "g", "G"), ("c", "taken", "t", "T"), ("d", "far", "f", "F")], SCHEMA)
    fields = "collection string, source_url string, url string, line_pos int, match_pos int, ok boolean, path string, content_sha string, content string"
    fetched = spark.createDataFrame([("c", "s1", "u1", 0, 0, True, "same", "s", "S"), ("c", "s1", "u2", 1, 0, True, "edit", "new", "N"),
                                     ("c", "s1", "u3", 2, 0, True, "both", "b1", "B1"), ("c", "s2", "u4", 0, 0, True, "both", "b2", "B2"),
                                     ("c", "s2", "u5", 1, 0, True, "taken", "t2", "T2"), ("c", "s3", "u6", 0, 0, True, "idle", "i", "I")], fields)
    plan = spark.createDataFrame([("c", "s1", "gone", "removed"), ("c", "s1", "taken", "removed"), ("c", "s1", "nowhere", "removed")],
                                 "collection string, source_url string, path string, change string")
    summary = spark.createDataFrame([("c", "s1", False), ("c", "s2", False), ("c", "s3", True)], "collection string, source_url string, up_to_date boolean")
    delta = SY.corpus_delta(corpus, fetched, plan, summary, fetched)
    assert sorted((r.path, r.content, r.deleted) for r in delta.collect()) == [
        ("both", "B1", False), ("edit", "N", False), ("gone", None, True), ("taken", "T2", False)]
    folded = corpus.join(delta.select(*KEY), KEY, "left_anti").unionByName(delta.filter("NOT deleted").drop("deleted"))
    full = SY.apply_plan(corpus, fetched, plan, summary, fetched)
    assert sorted(map(tuple, folded.select(*full.columns).collect())) == sorted(map(tuple, full.collect()))


def test_rows_are_compared_once(spark):
    """Who writes the changes finds the touched keys in a table: no digest is taken again."""
    old, new = table(spark, {("a", "x"): "1", ("a", "y"): "1", (None, "z"): "1"}), table(spark, {("a", "x"): "2", (None, "z"): "1", ("b", "y"): "1"})
    delta = log.changes(old, new, KEY)
    assert "sha2" not in delta._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.collection, r.path, r.content_sha, r.deleted) for r in delta.collect()) == [
        ("a", "x", "2", False), ("a", "y", None, True), ("b", "y", "1", False)]
