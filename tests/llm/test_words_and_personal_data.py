"""Spelling variants, personal data and the divergence audit against brute force on small tables with
awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mdweave.llm import divergence, pii, spelling
from mdweave.llm.common import stage

SCHEMA = "doc_id long, text string, lang string, source string, word string, term string, part int, n long"
WORDS = "standard standart standerd standards standrd organize organise organiser kartoffel kartofel kartoffeln Übergrößen übergrößen".split()


def tables(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, "x", "y", 1, 2) for i, t, lang, source in rows], SCHEMA).repartition(3)


def rows_of_words():
    random = np.random.default_rng(3)
    rows = [(None, "standard alone", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, "x" * 3000 + " " + "x" * 2999 + "y", "en", "a"),
            (3, "x" * 3000 + " " + "x" * 2999 + "y", "en", "a"), (4, "ÀÈÌÒÙÝÞ àèìòùýþ ÷×÷×÷×÷ naïveté naïvete 漢字漢字漢字漢字 standard1standard", "fr", "b"),
            (4, "\U0001F600standard\U0001F600 STANDARD", "fr", "b"), (5, "aaaaaaa aaaaaaaa aaaaaaaaa " * 3, "fr", "c")]
    frequent = [0.4, 0.02, 0.02, 0.1, 0.01, 0.2, 0.02, 0.01, 0.15, 0.01, 0.02, 0.02, 0.02]
    rows += [(10 + k, " ".join(random.choice(WORDS, 30, p=frequent)), ["en", "de", None][k % 3], f"s{k % 4}") for k in range(60)]
    return [*rows, rows[-1]]


def expected_variants(rows, least=7, times=10, one_in=31):
    n = Counter()
    for i, t, *_ in rows:
        for r in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % one_in == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= least:
                n[r] += 1
    n = {w: c for w, c in n.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))

    beside = {w: [u for u in n if near(w, u)] for w in n}
    form = {w: min(b, key=lambda u: (-n[u], u)) if b else None for w, b in beside.items()}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w
    return [(w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n]


def same(got, expected):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


def test_variants(spark):
    rows = rows_of_words()
    docs = tables(spark, rows)
    expected = expected_variants(rows)
    assert sum(r[1] is not None for r in expected) >= 5 and any(r[4] > 2 for r in expected)
    same(spelling.variants(docs).collect(), expected)
    # every checksum deletes; small filters and broadcasts: several shards of a length, several rounds
    same(spelling.variants(docs, one_in=1, times=2, shard_words=2, most_bytes=300).collect(), expected_variants(rows, one_in=1, times=2))
    assert spelling.variants(docs.where("doc_id > 1000")).count() == 0


def test_roots_follow_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)] + [("a", "w3"), ("b", "a")], "word string, form string")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w20"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc\xe9", min_size=2, max_size=6), min_size=1, max_size=30, unique=True))
def test_edits_are_complete(words):
    """Every pair at one edit is found from one of its words, once."""
    known = [w.encode("latin-1") for w in words]
    keys = spelling.keys_of(known)
    found = Counter()
    of = {}
    for length in {len(w) for w in known}:
        own = np.array([k for w, k in zip(known, keys) if len(w) == length], np.uint64)
        bits = np.zeros(64, np.uint64)
        np.bitwise_or.at(bits, spelling.block_of(own, 64).astype(int), spelling.mask_of(own))
        of[length] = (1, 64, np.array([0]), bits)
    filters = spelling.Filters([])
    filters.of = of
    name = {int(k): w for w, k in zip(words, keys)}
    for length, at in spelling.by_length(known).items():
        table, p = spelling.table_of([known[k] for k in at], length), spelling.powers(length)
        for find in (spelling.deletions, spelling.replacements):
            for a, b in find(table, p, filters, keys[at]):
                found.update((name[int(x)], name[int(y)]) for x, y in zip(a, b) if int(y) in name)
    near = {frozenset((a, b)) for a in words for b in words if a != b and (
        len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or len(a) == len(b) + 1 and any(b == a[:k] + a[k + 1:] for k in range(len(a))))}
    assert {frozenset(x) for x in found} == near and set(found.values()) <= {1}


def expected_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", ["".join(c.lower() if c.isascii() else c for c in m) for m in
                                         re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for _, t, lang, source in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in df.items()}
    for lang, source, terms in docs:
        for key in ((lang, source), lang):
            count[key].update(t for t in terms if t in kept[lang])

    def p(key, lang):
        c, total = count[key], sum(count[key].values()) + len(kept[lang])
        return {t: 1 + floor(Fraction(10**9 * (c[t] + 1), total)) for t in kept[lang]}

    f = lambda x, y: (x - y) ** 2 // y
    groups, out = {(lang, source) for lang, source, _ in docs}, []
    for lang, source in groups:
        own, whole = p((lang, source), lang), p(lang, lang)
        pairs = [(sum(f(own[t], other[t]) for t in own), b) for a, b in groups if a == lang and b != source for other in [p((a, b), lang)]]
        terms = [(f(own[t], whole[t]), t) for t in own if count[lang, source][t] and own[t] > whole[t]]
        for part, every in (("pair", pairs), ("term", terms)):
            ranked = sorted(every, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return out


def test_audit(spark):
    rows = rows_of_words() + [(90, "rare words", "xx", "p"), (91, "no more", "xx", "q"), (92, "123 456", "xx", "q"), (93, "lone", "yy", "z")]
    docs = tables(spark, rows)
    columns = "lang", "source", "part", "item", "value", "rank"
    for top, more in ((200, {}), (2, {"shard_terms": 3, "most_bytes": 400, "tile": 1, "fan": 2})):
        got = divergence.audit(docs, top=top, **more)
        assert tuple(got.columns) == columns and dict(got.dtypes)["rank"] == "int"
        same(got.collect(), expected_audit(rows, top=top))
    assert divergence.audit(docs.where("doc_id > 1000")).count() == 0


def test_sums_of_many_tasks(spark):
    """The counts of a group are added up a few tasks at a time."""
    row = lambda task, gaps, counts: ("en", "s", 0, task, 9, "|u1 |u1", bytes(gaps), bytes(counts))
    partial = spark.createDataFrame([row(k, [k % 5, 1], [k + 1, 2]) for k in range(20)], divergence.PARTIAL_SQL)
    for fan in (4, 5):
        partial = stage(divergence.added_up(partial, fan))
    r, = partial.collect()
    counts = np.zeros(9, np.int64)
    divergence.add(counts, r.kind, bytes(r.gaps), bytes(r.counts))
    expected = np.zeros(9, np.int64)
    for k in range(20):
        expected[[k % 5, k % 5 + 1]] += [k + 1, 2]
    assert counts.tolist() == expected.tolist()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).filter(lambda b: b"\n" not in b), max_size=200), st.integers(0, 3))
def test_perfect_hash(keys, same_hash):
    terms = sorted(keys)
    table = divergence.PerfectHash.load(divergence.PerfectHash.build(terms).image())
    hashes = np.array([divergence.hash_of(t) for t in terms], np.uint64)
    assert sorted(table.slots(terms, hashes).tolist()) == list(range(len(terms)))
    assert [table.keys[s] for s in table.slots(terms, hashes)] == terms
    # a term that isn't there, with the hash of one that is
    others = [t + b"!other" for t in terms]
    assert set(table.slots(others, hashes).tolist()) <= {-1}


def test_perfect_hash_of_equal_hashes(monkeypatch):
    monkeypatch.setattr(divergence, "hash_of", lambda t: 7)
    table = divergence.PerfectHash.load(divergence.PerfectHash.build([b"a", b"b", b"c"]).image())
    assert sorted(table.slots([b"a", b"b", b"c", b"d"], np.full(4, 7, np.uint64)).tolist()) == [-1, 0, 1, 2]


@pytest.mark.parametrize("total", [1, 7, 10**9, 10**15])
def test_exact_probabilities(total):
    counts = np.array(sorted({c for c in (0, 1, 5, total // 3, total - 1) if 0 <= c < total}))
    assert divergence.probabilities(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


PII = ["mail a.b@example.com or x@y@z.org, a@b.", "10.0.0.1 and 1.2.3.4.5 and 300.1.1.1 and 0001.2.3.255 and 1.2.3.4.5.6.7.8",
       "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111111", "+1 (377) 555-0271, +12345 and + 1234567890 +4420 7946 0958.",
       "+1 555 555 5555 4111111111111111", None, "", "é" * 10, "@@ a@b.c d@e.f_g@h.i", "12-34 56", "a" * 2000 + "@" + "b" * 2000 + ".com", "1" * 5000,
       "+1" + " " * 500 + "2", "\U0001F600 a@b.de \U0001F600 4111111111111111"]


def plain_base(text):
    """The contract's patterns as they stand."""
    out = []
    def luhn(s):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    for kind, (pattern, good) in enumerate((
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in s.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15))):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if good(m[0])]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text("ab@.+-_ 0123456789()%\né", max_size=60))
def test_base_patterns(text):
    assert sorted(pii.base_spans(text)) == plain_base(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_scan(spark, field):
    docs = spark.createDataFrame([(k if k % 5 else None, t, "x", 1) for k, t in enumerate(PII + PII[:2])], "doc_id long, text string, spans string, n_ip int")
    got = pii.scan(docs.repartition(3), field).collect()
    expected = []
    for k, t in enumerate(PII + PII[:2]):
        base = plain_base(t or "")
        sha = hashlib.sha256(",".join(f"{pii.KINDS[x]}:{a}:{b}" for x, a, b in base).encode()).hexdigest()
        expected.append((k if k % 5 else None, *(sum(x == kind for x, _, _ in base) for kind in range(4)), sha))
    same([r[:6] for r in got], expected)
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1]))) == spans
        assert hashlib.sha256(",".join(":".join(s) for s in spans if s[0] != "crf").encode()).hexdigest() == r.base_sha256
    assert pii.scan(docs.limit(0), field).count() == 0 and pii.scan(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_field_finds_other_notations(spark, field):
    """Held out: other documents, other values.  Most notations are found, other numbers and clean texts stay."""
    tagger, random = pii.Tagger(field), np.random.default_rng(77)
    texts = [r.text[:300] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(700).select("text").collect()][200:]
    texts = [t for t in texts if t.strip() and not pii.base_spans(t)]
    hits, false = [], []
    for k, t in enumerate(texts):
        some = pii.notations(random)
        more, a, b = pii.put_in(t, some[k % len(some)], random)
        hits.append(any(x == a and y == b for _, x, y in tagger([more])[0]))
        some = pii.numbers(random)
        more, a, b = pii.put_in(t, some[k % len(some)], random)
        false.append(any(x == 4 for x, _, _ in tagger([more])[0]))
    clean = [any(x == 4 for x, _, _ in s) for s in tagger(texts)]
    assert np.mean(hits) > 0.9 and np.mean(false) < 0.1 and np.mean(clean) < 0.01


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB1 .@-()+\n:/é漢", max_size=40), min_size=1, max_size=6), st.integers(0, 10**6))
def test_tagging_is_viterbi(texts, seed):
    """Tables by shape, batches and what they skip give the same spans as the field by itself, text by text."""
    random = np.random.default_rng(seed)
    names = sorted({f for t in texts for token in pii.features_of(pii.Tokens(t)) for f in token})
    weights = {f: random.normal(size=3).round(2).tolist() for f in names}
    field = pii.Field(weights, [[0.3, -0.2, pii.FORBIDDEN], [0.1, 0.2, 0.5], [0.2, -0.3, 0.4]])
    tagger = pii.Tagger(field)
    every = tagger.tagged("\n".join(texts))
    at, expected = 0, []
    for t in texts:
        for features, places in chains_of(t):
            tags = field.best(features)
            k = 0
            while k < len(tags):
                end = k
                if tags[k] == pii.B:
                    while end + 1 < len(tags) and tags[end + 1] == pii.I:
                        end += 1
                    expected.append((at + places[k][0], at + places[end][1]))
                k = end + 1
        at += len(t) + 1
    assert every == expected


def chains_of(text):
    tokens = pii.Tokens(text)
    features = pii.features_of(tokens)
    for c in sorted(set(tokens.chain.tolist())):
        at = np.flatnonzero(tokens.chain == c)
        yield [features[k] for k in at], [(int(tokens.start[k]), int(tokens.end[k])) for k in at]


def test_long_texts_in_parts(field):
    tagger = pii.Tagger(field)
    tagger.CHARS = 200
    text = "\n".join(f"word {k} call (377) 555-{k:04d} now" for k in range(60))
    assert tagger([text, "x", text[:150]]) == pii.Tagger(field)([text, "x", text[:150]])
    assert sum(k == 4 for k, _, _ in tagger([text])[0]) >= 50
