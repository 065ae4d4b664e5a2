"""The pipeline and the classifier against plain Python on a small corpus: expected rows stage by stage,
scores from raw zstandard sizes, and the whole output of ``run``."""

import math
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import re
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from mdweave.llm import quality, secret_crf

from .test_operators import fingerprint, smallest, tags_of

CODE = "77bbad26ca7ed0a1736a7470461894fd3b9ac859"


def corpus():
    """(doc_id, text, lang, source, n_chars) and (doc_id, quality, toxic): prose, junk, copies, secrets, long and missing texts."""
    random = np.random.default_rng(21)
    parts = ["tion", "er", "the", "an", "re", "on", "is", "at", "ly", "ing", "ou", "nd"]

    def prose(n):
        words = ["".join(random.choice(parts, int(random.integers(1, 4)))) for _ in range(n)]
        return " ".join(w.capitalize() + "." if k % 11 == 10 else w for k, w in enumerate(words))

    texts = {}
    for i in range(220):
        t = prose(int(random.integers(30, 400)))
        if i % 5 == 0:
            t = t.upper().replace(" ", "!! ") + " $$$"
        texts[i] = t
    for i in range(30):  # exact copies, but for white space
        texts[300 + i] = texts[i * 7 % 220].replace(" ", "  ", i % 4) + "\n" * (i % 3)
    for i in range(30):  # near copies of long texts
        words = prose(900).split(" ")
        texts[400 + i] = " ".join(words)
        texts[500 + i] = " ".join(words[:450] + ["changed"] + words[451:])
    for i in range(20):
        texts[600 + i] = f"{prose(60)} token = \"{CODE[i:] + CODE[:i]}\" {prose(40)} password: abc{i}def, auth = \"{'QwErTyUiOpAsDfGhJkLz'[i % 5:]}\" {prose(20)}"
    texts |= {700: None, 701: "", 702: " \n ", 703: prose(9000), 704: texts[500], 705: "é ß 漢字 \U0001F600 " + prose(100)}
    docs = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in texts.items()]
    return docs, [(i, int(i % 5 != 0), 0) for i in range(220)] + [(i, 1, 0) for i in range(400, 460)]


def compressed(data, dictionary):
    d = zstandard.ZstdCompressionDict(dictionary)
    c = zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    return sum(len(c.compress(data[k:k + 1024])) for k in range(0, len(data), 1024))


def score(text, model):
    data = (text or "").encode()
    z = model.slope * (compressed(data, model.bad) - compressed(data, model.good)) / max(1, len(data)) + model.offset
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: t for i, t, *_ in docs}


def test_scores_are_those_of_raw_sizes(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].score == pytest.approx(score(t, model), abs=1e-9) and got[i].predicted == (got[i].score >= 0.7)
    assert 0 < sum(r.predicted for r in got.values()) < len(texts)


def masked(text, spans):
    out, at = "", 0
    for a, b in sorted(spans):
        if b > at:
            out += "" if a < at else text[at:a] + "[SECRET]"
            at = b
    return out + text[at:]


def test_run(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = {i: t for i, t in texts.items() if score(t, model) >= 0.7}
    assert sum(i < 220 and i % 5 != 0 for i in left) > 150 and not any(i % 5 == 0 for i in left if i < 220)

    groups = defaultdict(list)
    for i, t in left.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((len(t or ""), -i))
    left = {-i: left[-i] for _, i in (max(g) for g in groups.values())}
    assert len(left) < sum(map(len, groups.values()))

    ids = sorted(left)
    component = smallest([fingerprint(left[i]) for i in ids], lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i, c in zip(ids, component):
        first.setdefault(c, i)
    assert 10 < len(ids) - len(first)
    left = {i: left[i] for i in first.values()}

    field = secret_crf.fit(spark.createDataFrame(list(left.items()), "doc_id long, text string"))
    clean = {}
    for i, t in left.items():
        if t is not None:
            base = [(a, b) for a, _, b in secret_crf.base_spans(t)]
            more = [(a - len(t[:a]) + len(t[:a].rstrip(".-")), b) for a, b in tags_of(t, field)]
            t = masked(t, base + [(a, b) for a, b in more if not any(a < y and x < b for x, y in base)])
        clean[i] = t
    assert not any(CODE[:24] in (t or "") for t in clean.values()) and sum("[SECRET]" in (t or "") for t in clean.values()) >= 20

    library, expected = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for i, t in clean.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        start, length = 0, (len(ids) - 1) % 2048 + 1  # all pieces but the first are full
        for piece in range(-(-len(ids) // 2048)):
            expected.append((i, piece, start, length, tuple(ids[start:start + length])))
            start, length = start + length, 2048
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, tuple(r.ids)) for r in got) == sorted(expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= 1.1 * sum(r.length for r in got) / 2048 + 4
