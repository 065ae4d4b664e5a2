"""The manifest as a JSON file: byte for byte what ``JSON.stringify(value, null, 2)`` gives, and read back by the scan."""

import json

from mdweave.operators import sync as SY
from mdweave.sources import manifest as MF
from mdweave.sources import manifest_file as W

TIME = "2030-01-02T03:04:05.678Z"


def test_files_are_those_of_json(spark, tmp_path):
    odd = 'tab\t quote" back\\ line\n bell\x07 é 漢 \U0001F600 /'
    sources = [{"label": "A", "url": "https://a/"}, {}, {"kept": 7, "label": odd, "url": "u"}]
    installs = [("c", 0, "https://a/", "A", "flat", "pre", json.dumps(sources[0])), ("c", 1, None, None, None, None, None),
                ("c", 4, "u", odd, "nested", odd, json.dumps(sources[2], ensure_ascii=False)), ("d", 0, "u", "D", "nested", "", "{}")]
    managed = [("c", 0, "https://a/", f"{k:04d}.md") for k in range(500)] + [("c", 4, "u", odd), ("c", 4, "u", "b.md"), ("c", 4, "u", "b.md")]
    urls = [("c", 0, "https://a/", f"https://a/{k}", (1000 - k // 2, k % 2)) for k in range(300)]
    tables = {"installs": spark.createDataFrame(installs, "collection string, pos int, source_url string, source_label string, layout string, path_prefix string, source string"),
              "managed_files": spark.createDataFrame(managed, "collection string, pos int, source_url string, path string").repartition(5),
              "selected_urls": spark.createDataFrame(urls, f"collection string, pos int, source_url string, url string, ord {SY.ORD}").repartition(5)}
    collections = spark.createDataFrame([("c",), ("d",), ("empty",)], "collection string")
    assert W.write_manifest_files(tables, collections, str(tmp_path / "out"), "manifest.json", TIME) == 3
    ordered = [u for _, _, _, u, _ in sorted(urls, key=lambda r: r[4])]
    expected = {"c": [
        {"layout": "flat", "managedFiles": sorted(p for _, n, _, p in managed if n == 0), "pathPrefix": "pre", "selectedUrls": ordered, "source": sources[0]},
        {"layout": "nested", "managedFiles": [], "pathPrefix": "", "selectedUrls": [], "source": {}},
        {"layout": "nested", "managedFiles": sorted({odd, "b.md"}), "pathPrefix": odd, "selectedUrls": [], "source": sources[2]}],
        "d": [{"layout": "nested", "managedFiles": [], "pathPrefix": "", "selectedUrls": [], "source": {}}], "empty": []}
    texts = {}
    for name, value in expected.items():
        texts[name] = (tmp_path / "out" / name / "manifest.json").read_text(encoding="utf-8")
        assert texts[name] == json.dumps({"generatedAt": TIME, "installs": value, "version": 2}, indent=2, ensure_ascii=False) + "\n"
        assert sorted(p.name for p in (tmp_path / "out" / name).iterdir()) == ["manifest.json"]
    back = MF.manifest_tables(spark.createDataFrame(list(texts.items()), "collection string, text string"))
    assert back["managed_files"].count() == 502 and back["selected_urls"].count() == 300 and back["installs"].count() == 4
    got = {r.url: tuple(r.ord) for r in back["selected_urls"].collect()}
    assert sorted(got, key=got.get) == ordered
