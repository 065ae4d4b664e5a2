"""The import of what has changed against a full import: index lines, resources, options, new and lost sources, renumbered names."""

import random

from pyspark.sql import functions as F

from mdweave.plans import incremental as IC
from mdweave.plans import ingest as IN
from mdweave.sources import log
from mdweave.sources import sinks as SK
from mdweave.session import materialize

RES = ("url string, ok boolean, http_status int, status_text string, content_type string, content_length long, "
       "final_url string, error string, body string")
SOURCES = "collection string, source_url string, layout string, path_prefix string, allow_external boolean, seq long"


def world(rng, before=None):
    """Lines by source and bodies by URL; from the one before, with a few changes."""
    urls = [f"https://s{s}.test/{d}/{p}" for s in range(6) for d in ("a", "b") for p in ("x", "x.md", "x-2", "y")]
    if before is None:
        lines = {s: rng.sample([u for u in urls if f"//s{s}." in u], 6) for s in range(5)}
        bodies = {u: f"# {u}" for u in urls if rng.random() < 0.8}
        return lines, bodies, {s: "nested" for s in range(5)}
    lines, bodies, layout = {s: list(x) for s, x in before[0].items()}, dict(before[1]), dict(before[2])
    s = rng.randrange(5)
    lines[s] = rng.sample(lines[s], len(lines[s]) - 1) if rng.random() < 0.7 else lines[s][::-1]
    for u in rng.sample(urls, 4):
        if u in bodies and rng.random() < 0.5:
            del bodies[u]
        else:
            bodies[u] = f"# {u} {rng.random()}"
    if rng.random() < 0.5:
        layout[rng.randrange(5)] = "flat"
    if 5 not in lines:  # a source that is new
        lines[5], layout[5] = [u for u in urls if "//s5." in u][:4], "nested"
    return lines, bodies, layout


def tables(spark, w):
    lines = [(f"https://s{s}.test/llms.txt", n, f"- [T{n}]({u})") for s, x in w[0].items() for n, u in enumerate(x)]
    sources = [(f"c{s % 2}", f"https://s{s}.test/llms.txt", w[2][s], f"p{s}" if s < 4 else None, False, s) for s in w[0]]
    bodies = [(u, True, 200, "OK", "text/markdown", len(b), u, None, b) for u, b in w[1].items()]
    return (spark.createDataFrame(lines, "source_url string, line_pos long, line string"), spark.createDataFrame(sources, SOURCES),
            spark.createDataFrame(bodies, RES))


def rows(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


def test_changes_give_what_a_full_import_gives(spark, tmp_path):
    rng = random.Random(11)
    w = world(rng)
    lines, sources, resources = tables(spark, w)
    first = IN.ingest(lines, sources, resources)
    root, key = str(tmp_path / "log"), ["collection", "path"]
    log.append(first["snapshot"].withColumn("deleted", F.lit(False)), root, key)
    manifest = {k: materialize(first[k]) for k in SK.MANIFEST_TABLES}
    previous = {"sources": sources, "outcomes": first["outcomes"], "results": first["results"]}
    for _ in range(2):
        w = world(rng, w)
        new_lines, sources, new_resources = tables(spark, w)
        corpus = log.read(spark, root, key).drop("seq")
        full = IN.ingest(new_lines, sources, new_resources, **manifest, corpus=corpus)
        out = IC.ingest_changes(previous, new_lines, sources, new_resources, IC.changed_sources(lines, new_lines),
                                IC.changed_urls(resources, new_resources), **manifest, corpus=corpus)
        columns = "collection", "source_url", "url", "ok", "path", "content_sha", "reason"
        assert rows(out["results"], *columns) == rows(full["results"], *columns)
        for name in SK.MANIFEST_TABLES:
            assert rows(out[name], *sorted(out[name].columns)) == rows(full[name], *sorted(full[name].columns)), name
        expected = rows(full["snapshot"], "collection", "path", "content_sha", "content")
        entries = sum(len(x) for x in w[0].values())
        assert 0 < out["refetched"].count() < entries and out["affected"].count() < len(w[0])
        log.append(out["delta"], root, key)
        assert rows(log.read(spark, root, key), "collection", "path", "content_sha", "content") == expected
        manifest = {k: materialize(out[k]) for k in SK.MANIFEST_TABLES}
        previous, lines, resources = out, new_lines, new_resources
    assert log.since(spark, root, 2, key).count() == log.segments(spark, root)[1][-1]["rows"] and log.since(spark, root, 3, key) is None


def test_nothing_changed(spark):
    lines, sources, resources = tables(spark, world(random.Random(2)))
    first = IN.ingest(lines, sources, resources)
    state = [materialize(first[k]) for k in SK.MANIFEST_TABLES] + [materialize(first["snapshot"])]
    out = IC.ingest_changes({**first, "sources": sources}, lines, sources, resources, IC.changed_sources(lines, lines),
                            IC.changed_urls(resources, resources), *state)
    assert out["refetched"].count() == 0 and out["delta"].count() == 0
    assert rows(out["results"], "url", "path") == rows(first["results"], "url", "path")
