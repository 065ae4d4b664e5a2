"""Secret scan: fixed patterns, and a linear-chain conditional random field.

The patterns (``assign``, ``access``, ``hex``) always count.  The field tags every token
of a text as begin (B), inside (I) or outside (O) of a secret, from its shape (digits, letters
and length are features), the words and characters beside it and features of the file, and
Viterbi finds the best tags; its spans that touch no pattern's span are added as ``crf``.

A token is a run of ``A-Za-z0-9+/_`` with ``.`` and ``-`` inside, or a run of other letters;
a chain is the tokens of a line or a sentence, however many.  What a token adds to the score of a tag is
kept by distinct token; a chain in which no token can be worth a tag but O, whatever stands
beside it, needs no Viterbi (``Tagger``).  The field is trained here, with the patterns' spans as
labels, on a bounded sample of distinct chains of all rows, in the order of a hash: up to half of ``most_chains`` from
every chain that touches a pattern's span, and as many others, one half of them with a digit: of each
text the chain after a place and that of the first digit from there.  Of a longer chain, training
sees a part of ``most_tokens`` tokens: around each secret, or the first; of a secret with more tokens, what
is left behind the part is skipped.  The patterns' matches are all alike, so each of the others is also seen with
a secret that no pattern has put in (``invented``: other alphabets, several tokens, other key words or none),
and with ordinary text beside such words (``ordinary``).

Defined results: null text is empty (no spans, the hash of an empty string); null ids and
repeated rows are scanned as they come; without a secret in the sample, the field adds
nothing; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, slices, stage, texts_of

KINDS = ("assign", "access", "hex", "crf")
TAGS = O, B, I = 0, 1, 2
# fixed values: the patterns
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "key", "auth", "bearer", "credential", "pwd", "pass", "login")
TOKEN = re.compile(r"([A-Za-z0-9+/_]+(?:[.-]+[A-Za-z0-9+/_]+)*|[^\W\x00-\x7f]+)")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SHAPE = str.maketrans({c: k for k, cs in (("l", "abcdefghijklmnopqrstuvwxyz"), ("u", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("d", "0123456789"),
                                          ("s", "+/_"), ("p", ".-")) for c in cs})
BREAK = re.compile(r"[\n\r]|[.!?][\"')\]]*\s|[。！？]")
FORBIDDEN = -1e9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(out)


def split(text: str, begin: int = 0, end: int | None = None) -> tuple[list[str | None], list[str]]:
    """What stands before, between and after the tokens, and the tokens (None: an end of the text)."""
    found = TOKEN.split(text[begin:end] if begin or end is not None else text)
    between = found[::2]
    if not begin:
        between[0] = between[0] or None
    if end is None or end == len(text):
        between[-1] = between[-1] or None
    return between, found[1::2]


def bucket(x: float, *cuts: float) -> int:
    return bisect_right(cuts, x)


def file_features(text: str) -> list[str]:
    digits = sum(map(text.count, "0123456789"))
    low = text.lower()
    return [f"file digits {bucket(digits / max(1, len(text)), 0.002, 0.01, 0.05)}",
            f"file word {any(k in low for k in KEYWORDS[:5])}", f"file size {bucket(len(text), 500, 5000, 50000)}"]


def token_features(t: str) -> list[str]:
    """Shape of a token."""
    shape = t.translate(SHAPE) if t.isascii() else "o" * len(t)
    digits, runs = shape.count("d"), len(re.findall("d+", shape)) if "d" in shape else 0
    kinds = "".join(k for k in "ludspo" if k in shape)
    changes = 2 * runs - shape.startswith("d") - shape.endswith("d")  # from a digit to another character or back
    cases = shape.count("lu")
    return [f"kinds {kinds}", f"length {bucket(len(t), 4, 8, 12, 16, 20, 24, 32, 40, 64)}",
            f"digits {bucket(digits / len(t), 1e-9, .2, .4, .6, .8, 1)}",
            f"distinct {bucket(len(set(t)) / len(t), .2, .35, .5, .7, .9)}", f"changes {bucket(changes / len(t), .05, .15, .3, .45)}",
            f"cases {bucket(cases / len(t), 1e-9, .1, .2)}", f"hex {not t.lower().strip('0123456789abcdef')}",
            f"number {not t.strip('0123456789.-+/')}", f"capital start {t[:4].isupper() and t[:4].isalpha()}"]


def key_of(t: str) -> str | None:
    """The key word that the last word of a token ends with, or none; None if it has no letter."""
    if not t.isascii():
        return "none"
    end = len(t)
    while end and t[end - 1] not in LETTERS:
        end -= 1
    begin = end
    while begin and t[begin - 1] in LETTERS:
        begin -= 1
    word = t[begin:end].lower()
    return next((k for k in KEYWORDS if word.endswith(k)), "none") if word else None


def side(c: str | None) -> str:
    """Kind of the character beside a token (None: an end of the text)."""
    return "end" if c is None else "quote" if c and c in "\"'`" else "space" if c.isspace() else c if c and c in "=:@()+,;<>#$%&" else "x"


def assigns(between: str | None) -> bool:
    return between is not None and (":" in between or "=" in between)


def ends(between: str | None) -> bool:
    """Whether a line or a sentence ends there."""
    return between is not None and BREAK.search(between) is not None


def key_features(key: str, assigned: bool) -> list[str]:
    """The word before a token, and whether an equals sign or a colon stands between."""
    return [f"word {key}", f"assigned {assigned}", f"key word {key != 'none'}", f"key assigned {key != 'none' and assigned}"]


def chains(between: list[str | None], found: list[str]) -> list[tuple[int, int]]:
    """(first, last) of the tokens of each line or sentence."""
    starts = [k for k in range(len(found)) if not k or ends(between[k])]
    return list(zip(starts, [*starts[1:], len(found)]))


def chain_features(between: list[str | None], found: list[str], key: str, of_file: list[str]) -> list[list[str]]:
    """Features of the tokens of a chain, with the shape of both neighbours; ``between`` has
    one entry more than ``found``, ``key`` is that of the last word before the chain."""
    own, out = [token_features(t) for t in found], []
    for k, f in enumerate(own):
        left = own[k - 1][0] if k else "none"
        right = own[k + 1][0] if k + 1 < len(own) else "none"
        before, after = between[k], between[k + 1]
        out.append(["bias", *f, f"before {side(before and before[-1:])}", f"after {side(after and after[:1])}",
                    *key_features(key, assigns(before)), f"left {left}", f"right {right}", *of_file])
        key = key_of(found[k]) or key
    return out


class Field:
    """Weights by feature and tag, and between tags."""

    def __init__(self, weights: dict[str, list[float]], between: list[list[float]]):
        self.weights, self.between = weights, between

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        zero = [0.0, 0.0, 0.0]
        e = np.array([np.sum([self.weights.get(f, zero) for f in fs], axis=0) for fs in features])
        e[0, I] += FORBIDDEN  # nothing to be inside of
        return e

    def best(self, features: list[list[str]]) -> list[int]:
        """The best tags, by Viterbi."""
        return self.best_of(self.emissions(features))

    def best_of(self, e: np.ndarray) -> list[int]:
        between = np.array(self.between)
        score, back = e[0], []
        for row in e[1:]:
            every = score[:, None] + between
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + row
        tags = [int(score.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def sure(self) -> float:
        """By how much O must lead at every token of a chain for O to be best at all of them.

        A stretch of other tags gains at most ``enter`` and ``leave`` at its ends and ``stay``
        between two of its tokens; a lead over both at each token outweighs that."""
        b = self.between
        enter, leave = b[O][B] - b[O][O], max(b[B][O], b[I][O]) - b[O][O]
        stay = max(b[x][y] for x in (B, I) for y in (B, I)) - b[O][O]
        return max(stay, max(enter, 0) + max(leave, 0), 0) + 1e-6


def train(samples: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, shrink: float = 1e-3,
          at_once: int = 16) -> Field:
    """Maximum likelihood by adaptive gradient steps over (features, tags) of chains, ``at_once`` a step."""
    names = sorted({f for fs, _ in samples for token in fs for f in token})
    number = {f: k for k, f in enumerate(names)}
    # the last row stands for what fills up the shorter chains of a step
    w, between = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    between[O, I] = FORBIDDEN
    sum_w, sum_b = np.full(w.shape, 1e-6), np.full(between.shape, 1e-6)
    coded = sorted(((np.array([[number[f] for f in token] for token in fs]), np.array(tags)) for fs, tags in samples),
                   key=lambda x: len(x[1]))
    random = np.random.default_rng(7)

    def soft(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    steps = []
    for k in range(0, len(coded), at_once):  # chains of about one length
        part = coded[k:k + at_once]
        size, longest = np.array([len(t) for _, t in part]), len(part[-1][1])
        fs = np.full((len(part), longest, part[0][0].shape[1]), len(names))
        tags = np.zeros((len(part), longest), int)
        for i, (f, t) in enumerate(part):
            fs[i, :len(t)], tags[i, :len(t)] = f, t
        steps.append((fs, tags, size, np.arange(longest)[None] < size[:, None]))
    for _ in range(rounds):
        for k in random.permutation(len(steps)):
            fs, tags, size, there = steps[k]
            e = w[fs].sum(axis=2)
            e[:, 0, I] += FORBIDDEN
            forward, backward = e.copy(), np.zeros(e.shape)
            for i in range(1, e.shape[1]):
                forward[:, i] += soft(forward[:, i - 1, :, None] + between, 1)
            for i in range(e.shape[1] - 2, -1, -1):
                step = soft(between + (e[:, i + 1] + backward[:, i + 1])[:, None], 2)
                backward[:, i] = np.where(there[:, i + 1, None], step, 0)
            total = soft(forward[np.arange(len(size)), size - 1], 1)[:, None, None]
            g = (np.eye(3)[tags] - np.exp(np.minimum(forward + backward - total, 0))) * there[..., None]
            flat, each = fs.reshape(-1), np.repeat(g.reshape(-1, 3), fs.shape[2], axis=0)
            g = np.stack([np.bincount(flat, each[:, t], len(w)) for t in range(3)], axis=1)
            g -= shrink * w * np.bincount(flat, minlength=len(w))[:, None]
            g[-1] = 0
            sum_w += g * g
            w += rate * g / np.sqrt(sum_w)
            if e.shape[1] > 1:
                both = np.exp(np.minimum(forward[:, :-1, :, None] + between + (e[:, 1:] + backward[:, 1:])[:, :, None]
                                         - total[..., None], 0))
                g = -(both * there[:, 1:, None, None]).sum(axis=(0, 1))
                np.add.at(g, (tags[:, :-1][there[:, 1:]], tags[:, 1:][there[:, 1:]]), 1)
                sum_b += g * g
                between += rate * g / np.sqrt(sum_b)
                between[O, I] = FORBIDDEN
    return Field({f: w[k].tolist() for f, k in number.items()}, between.tolist())


def labels(between: list[str | None], found: list[str], known: list[tuple[int, int]]) -> list[int]:
    """Tags of the tokens of a text from the spans of its secrets (without their key words)."""
    spans: list[list[int]] = []
    for a, b in sorted(known):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    tags, at, k, last = [], 0, 0, -1
    for gap, t in zip(between, found):
        at += len(gap or "")
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if k < len(spans) and spans[k][0] < at + len(t):
            tags.append(I if last == k and tags[-1] != O else B)
            last = k
        else:
            tags.append(O)
        at += len(t)
    return tags


def values(text: str) -> list[tuple[int, int]]:
    """The spans of the patterns' matches, of assignments the value only."""
    out = []
    for a, kind, b in base_spans(text):
        out.append((re.compile(ASSIGN, re.I | re.A).match(text, a, b).start(2) if kind == 0 else a, b))
    return out


def widened(text: str, begin: int, end: int) -> tuple[int, int]:
    """Both ends moved, over what stands between tokens, to the next token or the end of the text."""
    while begin and not TOKEN.match(text[begin - 1]):
        begin -= 1
    following = TOKEN.search(text, end)
    return begin, following.start() if following else len(text)


def key_before(text: str, at: int) -> str:
    """The key word before a place that no token goes over."""
    size = 100
    while True:
        begin = max(0, at - size)
        found = TOKEN.findall(text[begin:at])
        for t in reversed(found[bool(begin):]):  # the first one may be cut
            if key := key_of(t):
                return key
        if not begin:
            return "none"
        size *= 4


def chains_between(text: str, begin: int):
    """(begin, end) of the lines and sentences of a text from ``begin``, where one starts."""
    for m in BREAK.finditer(text, begin):
        yield begin, m.start()
        begin = m.end()
    yield begin, len(text)


SECRET, DIGIT, OTHER = range(3)
LEAST_OTHERS = 200  # chains of either other kind, if there are so many, however few have a secret


def candidates(text: str, most_tokens: int) -> list[tuple[int, str]]:
    """(kind, what to train with as JSON) of the chains of a text that may be in the sample."""
    known, of_file, places = values(text), file_features(text), set()
    if known:
        ahead = sorted(known)
        for begin, end in chains_between(text, 0):
            while ahead and ahead[0][1] <= begin:
                ahead.pop(0)
            if not ahead:
                break
            if ahead[0][0] < end:
                places.add((begin, end))
    # a place that the text gives; the chain after it, and that of the first digit from there
    m = BREAK.search(text, zlib.crc32(text.encode()) % max(1, len(text)))
    after = m.end() if m else 0
    places.add(next(chains_between(text, after)))
    if digit := re.compile("[0-9]").search(text, after):
        places.add(next(c for c in chains_between(text, after) if c[1] > digit.start()))
    out = []
    for place in sorted(places):
        begin, end = widened(text, *place)
        between, found = split(text, begin, end)
        tags = labels(between, found, [(a - begin, b - begin) for a, b in known])
        key, at, seen = key_before(text, begin), 0, 0
        while at < len(found):
            # the part around the next secret, which starts with no token inside of one; without any, the first
            first = next((k for k in range(at, len(tags)) if tags[k]), None)
            if first is None and at:
                break
            first = max(at, first - most_tokens // 2) if first is not None else 0
            while first < len(tags) and tags[first] == I:  # the rest of a secret that was too long for the part before
                first += 1
            if first == len(tags):
                break
            at = min(len(found), first + most_tokens)
            for t in found[seen:first]:
                key = key_of(t) or key
            seen = first
            kind = SECRET if any(tags[first:at]) else DIGIT if any(re.search("[0-9]", t) for t in found[first:at]) else OTHER
            out.append((kind, json.dumps([between[first:at + 1], found[first:at], key, of_file, tags[first:at]])))
    return out


def invented(random: np.random.Generator) -> tuple[str, str, str]:
    """What stands before a secret, a secret that no pattern has, and what stands behind it."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    letters = lower + lower.upper()

    def some(alphabet, least, most):
        return "".join(random.choice(list(alphabet), random.integers(least, most)))

    strong = [some(letters + digits, 16, 41), some(lower + digits, 16, 41), some(lower.upper() + digits, 16, 33), some(digits + "abcdef", 16, 24),
              some(letters + digits, 12, 30) + some("+/", 1, 3) + some(letters + digits, 8, 20) + "==",
              "-".join(some(letters + digits, 5, 9) for _ in range(4)), " ".join(some(digits + "abcdef", 4, 5) for _ in range(6)),
              ":".join(some(digits + "ABCDEF", 4, 5) for _ in range(6)), " ".join(some(lower.upper() + digits, 5, 6) for _ in range(5))]
    weak = [some(letters, 16, 33), some(lower, 18, 33), some(lower.upper(), 16, 33)]
    word = str(random.choice(["auth", "Auth", "pwd", "PWD", "pass", "key", "access key", "private_key", "bearer", "Bearer", "user pass", "AUTH"]))
    quote = str(random.choice(["", "", '"', '"', "'", "`"]))
    if random.random() < 0.2:  # by itself
        return quote, str(random.choice(strong)), quote
    value = str(random.choice(strong if random.random() < 0.6 else weak))
    mark = " " if word.lower() == "bearer" else str(random.choice([" = ", ": ", "=", ":", " := "]))
    if random.random() < 0.3:  # a word of the patterns, with what they don't expect behind it
        word, mark = str(random.choice(["token", "secret", "password", "passwd", "api key"])), str(random.choice([" is ", " -> ", ' ("', "; "]))
    return word + mark + quote, value, quote


def ordinary(random: np.random.Generator) -> str:
    """Key words, marks and quotes with no secret."""
    n = lambda a, b: int(random.integers(a, b))
    word = str(random.choice(["key", "pass", "auth", "login", "bearer", "credential", "pwd", "password", "secret", "token"]))
    plain = str(random.choice(["something", "Something", "standard", "the first one", "on", "none", "international", "responsibilities", "see below"]))
    return str(random.choice([f"the {word} of", f"{word} {plain}", f'title = "{plain}"', f"name: {plain}", f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}",
                              f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"no. {n(1, 10**8)}", f"+1 ({n(100, 1000)}) 555-{n(1000, 10000)}", f"{n(10**15, 10**16)}",
                              f"https://example{n(1, 10)}.org/{plain.replace(' ', '-')}/{n(1, 1000)}", f"v{n(1, 10)}.{n(0, 10)}.{n(0, 10)}", f"'{plain}'",
                              f"{n(1, 256)}.{n(1, 256)}.{n(1, 256)}.{n(1, 256)}", f"user{n(1, 100)}@mail.example.com", f"{plain} = {n(1, 1000)}",
                              f"color: #{n(0, 2**24):06x}", f"{word}: {plain}" if len(plain) < 6 else f"{word}s"]))


def put_in(between: list[str | None], found: list[str], key: str, of_file: list[str], before: str, what: str, after: str,
           secret: bool, random: np.random.Generator) -> tuple[list[list[str]], list[int]]:
    """(features, tags) of a chain without secrets with ``what`` between two of its tokens."""
    at = int(random.integers(0, len(found) + 1))
    left = "".join((g or "") + t for g, t in zip(between[:at], found[:at]))
    left += (between[at] or " ") if at else ""
    right = "".join(t + (g or "") for t, g in zip(found[at:], between[at + 1:]))
    start = len(left) + len(before)
    gaps, tokens = split(f"{left}{before}{what}{after}{' ' if right else ''}{right}")
    tags = labels(gaps, tokens, [(start, start + len(what))] if secret else [])
    return chain_features(gaps, tokens, key, of_file), tags


def with_more(others: list[tuple], seed: int = 11) -> list[tuple[list[list[str]], list[int]]]:
    """Chains without secrets, each also with a secret and with ordinary text put in."""
    random, out = np.random.default_rng(seed), []
    for between, found, key, of_file, tags in others:
        out.append((chain_features(between, found, key, of_file), tags))
        if not any(tags):
            out.append(put_in(between, found, key, of_file, *invented(random), True, random))
            out.append(put_in(between, found, key, of_file, "", ordinary(random), "", False, random))
    return out


def fit(docs: DataFrame, most_chains: int = 3000, most_tokens: int = 64) -> Field | None:
    """Train the field on a bounded sample of ``docs(doc_id, text)``; None if no text has a secret."""
    most = {SECRET: most_chains // 2, DIGIT: most_chains // 4 + 1, OTHER: most_chains // 4 + 1}

    def run(batches):
        # the first of each kind that this task has met, by hash
        kept: dict[int, dict[str, int]] = {kind: {} for kind in most}

        def cut(kind):
            kept[kind] = dict(sorted(kept[kind].items(), key=lambda x: x[::-1])[:most[kind]])

        for batch in parts_of(batches):
            for text in texts_of(batch):
                for kind, sample in candidates(text, most_tokens):
                    kept[kind][sample] = int.from_bytes(hashlib.blake2b(sample.encode(), digest_size=7).digest())
                    if len(kept[kind]) > 2 * most[kind]:
                        cut(kind)
        for kind in most:
            cut(kind)
        rows = [(kind, order, sample) for kind in most for sample, order in kept[kind].items()]
        for k in range(0, len(rows), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 512]), (pa.int32(), pa.int64(), pa.string()))],
                                             ["kind", "order", "sample"])

    found = stage(docs.select(F.col("text").alias("text")).mapInArrow(run, "kind int, order long, sample string").distinct())
    def first(kind, n):
        return [json.loads(r.sample) for r in found.where(F.col("kind") == kind).orderBy("order", "sample").limit(n).collect()]

    secret = first(SECRET, most[SECRET])
    if not secret:
        return None
    others = max(LEAST_OTHERS, (len(secret) + 1) // 2)
    return train([(chain_features(*x), tags) for *x, tags in secret] + with_more(first(DIGIT, others) + first(OTHER, others)))


class Rows(dict):
    """Numbers of distinct strings, and a table with a row of figures of each."""

    def __init__(self, row, width: int):
        super().__init__()
        self.row, self.width, self.table, self.chars = row, width, np.zeros((1024, width)), 0

    def __missing__(self, what: str | None) -> int:
        n = self[what] = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros(self.table.shape)])
        self.table[n] = self.row(what)
        self.chars += len(what or "")
        return n

    def figures(self, every: list) -> np.ndarray:
        if len(self) > 300_000 or self.chars > 20_000_000:  # what is kept is bounded
            self.clear()
            self.table, self.chars = np.zeros((1024, self.width)), 0
        numbers = np.fromiter(map(self.__getitem__, every), np.int64, len(every))
        return self.table[numbers]


class Tagger:
    """Tags of the tokens of whole texts.  A feature belongs to a token, to what stands between two, to the
    word before or to the file, so that their weights are added up once for each distinct one."""

    CHARS = 1 << 20

    def __init__(self, field: Field):
        self.field, self.sure = field, field.sure()
        self.keys = [*KEYWORDS, "none"]
        self.by_key = np.array([[self.weight(key_features(k, a)) for a in (False, True)] for k in self.keys])
        self.alone = np.array([self.weight(["left none"]), self.weight(["right none"])])
        self.shapes: dict[tuple, list[float]] = {}  # there are few: their features are counts of buckets
        # own weights, those as left and as right neighbour, key word (-1: no letter), length
        self.tokens = Rows(self.token_row, 11)
        # weights before and after a token, whether it assigns, whether a chain ends, length
        self.gaps = Rows(self.gap_row, 9)

    def weight(self, features: list[str]) -> np.ndarray:
        return np.sum([self.field.weights.get(f, (0.0, 0.0, 0.0)) for f in features], axis=0)

    def token_row(self, t: str) -> list[float]:
        own, key = tuple(token_features(t)), key_of(t)
        if own not in self.shapes:
            self.shapes[own] = [*self.weight(["bias", *own]), *self.weight([f"left {own[0]}"]), *self.weight([f"right {own[0]}"])]
        return [*self.shapes[own], -1 if key is None else self.keys.index(key), len(t)]

    def gap_row(self, gap: str | None) -> list[float]:
        return [*self.weight([f"before {side(gap and gap[-1:])}"]), *self.weight([f"after {side(gap and gap[:1])}"]),
                assigns(gap), ends(gap), len(gap or "")]

    def cuts(self, text: str) -> list[tuple[int, int]]:
        """Parts of a long text that end with a chain; what stands between two is in both."""
        out, begin = [], 0
        while m := BREAK.search(text, begin + self.CHARS):
            last, following = widened(text, m.start(), m.end())
            if following == len(text):
                break
            out.append((begin, following))
            begin = last
        return [*out, (begin, len(text))]

    def tagged(self, parts: list[tuple[str, int, int]], of_files: list[list[str]], key: int) -> tuple[list[list[tuple[int, int]]], int]:
        """Spans (from the start of the text) in each part (text, begin, end), and the key word after the last;
        ``key`` is the one before each."""
        gaps, found, sizes = [], [], []
        for text, begin, end in parts:
            g, f = split(text, begin, end)
            gaps += g
            found += f
            sizes.append(len(f))
        n, spans = len(found), [[] for _ in parts]
        if not n:
            return spans, key
        sizes = np.array(sizes)
        of = np.repeat(np.arange(len(parts)), sizes)
        first = (np.cumsum(sizes) - sizes)[of]
        at, token, gap = np.arange(n), self.tokens.figures(found), self.gaps.figures(gaps)
        before, after = gap[at + of], gap[at + of + 1]
        start = (at == first) | (before[:, 7] > 0)
        # the last token with a letter before this one
        seen = np.maximum.accumulate(np.where(token[:, 9] >= 0, at, -1))
        last = np.concatenate([[-1], seen[:-1]])
        word = np.where(last >= first, token[last, 9], key).astype(int)
        e = token[:, :3] + before[:, :3] + after[:, 3:6] + self.by_key[word, before[:, 6].astype(int)]
        e += np.array([self.weight(f) for f in of_files])[of]
        left = np.concatenate([self.alone[:1], token[:-1, 3:6]])
        right = np.concatenate([token[1:, 6:9], self.alone[1:]])
        left[start] = self.alone[0]
        right[:-1][start[1:]] = self.alone[1]
        e += left + right
        e[start, I] += FORBIDDEN
        unsure = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.sure)
        starts = np.flatnonzero(start)
        for c in np.unique(np.searchsorted(starts, unsure, "right") - 1):
            a, b = int(starts[c]), int(starts[c + 1]) if c + 1 < len(starts) else n
            tags = self.field.best_of(e[a:b])
            if any(tags):
                p = int(of[a])
                text, begin, _ = parts[p]
                k0 = int(first[a])
                # where the tokens of the chain begin and end
                lead = begin + int(gap[k0 + p:a + p, 8].sum() + token[k0:a, 10].sum())
                own, size = token[a:b, 10].astype(int), before[a:b, 8].astype(int)
                stop = lead + np.cumsum(own + size)
                k = 0
                while k < len(tags):
                    end = k
                    if tags[k] == B:
                        while end + 1 < len(tags) and tags[end + 1] == I:
                            end += 1
                        x = int(stop[k] - own[k])
                        while x and text[x - 1] in ".-":
                            x -= 1
                        spans[p].append((x, int(stop[end])))
                    k = end + 1
        final = int(seen[-1])
        return spans, int(token[final, 9]) if final >= first[-1] else key

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The spans of the field in every text, in order."""
        out, none = [], len(self.keys) - 1
        for i, j in slices(texts, self.CHARS):
            if j - i == 1 and len(texts[i]) > self.CHARS:
                of_file, key, every = file_features(texts[i]), none, []
                for begin, end in self.cuts(texts[i]):
                    got, key = self.tagged([(texts[i], begin, end)], [of_file], key)
                    every += got[0]
                out.append(every)
            else:
                out += self.tagged([(t, 0, len(t)) for t in texts[i:j]], [file_features(t) for t in texts[i:j]], none)[0]
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) of the patterns' spans and of those that the field adds."""
        out = []
        for t, more in zip(texts, self.spans(texts)):
            found = base_spans(t)
            if more:
                # ends of the spans up to each one, so that the last before a place tells
                begins, reach = [a for a, _, _ in found], list(np.maximum.accumulate([0, *(b for _, _, b in found)]))
                found = sorted(found + [(a, 3, b) for a, b in more if reach[bisect_right(begins, b - 1)] <= a])
            out.append(found)
        return out


def spans_in(texts: list[str], tagger: Tagger | None) -> list[list[tuple[int, int, int]]]:
    return [base_spans(t) for t in texts] if tagger is None else tagger(texts)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every text."""

    def run(batches):
        tagger = field and Tagger(field)
        for batch in parts_of(batches):
            every = spans_in(texts_of(batch), tagger)
            counts = [pa.array([sum(k == kind for _, k, _ in s) for s in every], pa.int64()) for kind in range(3)]
            sha = [hashlib.sha256(joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in every]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(sha, pa.string()),
                                              pa.array([joined(s) for s in every], pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """The text with every span replaced (overlapping spans by one mark)."""
    out, at = [], 0
    for a, _, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], by]
            at = b
    return "".join(out) + text[at:]


def masked(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (and ``n_chars`` counted again where a text changed)."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = field and Tagger(field)
        for texts in batches:
            every = texts.tolist()
            spans = spans_in([t or "" for t in every], tagger)
            yield pd.Series([None if t is None else mask(t, s) for t, s in zip(every, spans)], dtype=object)

    clean = F.pandas_udf(clean, "string")
    out = docs.withColumn("__clean", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__clean").eqNullSafe(F.col("text")), F.col("n_chars"))
                             .otherwise(F.char_length("__clean").cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.col("__clean")).select(*docs.columns)
