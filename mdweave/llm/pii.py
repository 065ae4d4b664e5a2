"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (``email``, ``ip``, ``card``, ``phone``) always count.  The field tags every token of a text as
begin (B), inside (I) or outside (O) of personal data and finds what is written in other ways (a phone number without
its plus, an address with ``(at)``, a card number in groups by dots); its spans that touch no pattern's span are added as ``crf``.

A token is a run of letters, a run of digits or any other single character but white space; a chain is the tokens of a
line or a sentence, however many.  A token's shape is its kind, case and length (of digits also whether they are at most 255
or pass the Luhn test) and whether white space stands before it; features are the shapes of the token and of up to three on
both sides, and of pairs.  So a batch of texts is tagged with array operations: scores come from tables by shape, and Viterbi runs over
all chains of a batch at once, but for chains in which no token can be anything but O (``Field.sure``).

The labelled table is small (``labelled``): up to ``most_chains`` pieces of at most ``most_chars`` code points from all
documents, in the order of a hash, those with a pattern's match or a digit first, labelled by the patterns; and copies of
them with a notation put in that no pattern knows (``notations``, labelled) or with other numbers (``numbers``, not labelled).

Defined results: null text is empty (no spans, the hash of an empty string); null ids and repeated rows are scanned
as they come; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_of, slices, stage, texts_of, worker_cache
from .pretokens import LETTER, SPACE, class_table
from .secret_crf import FORBIDDEN, B, Field, I, O, train

KINDS = ("email", "ip", "card", "phone", "crf")
# fixed values: the patterns, written so that no text takes more than linear time
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and place."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


# kinds of code points: white space, letters by case, digits, every other ASCII character, others
BLANK, LOWER, UPPER, UNCASED, DIGIT, MARK = range(6)
MARKS = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
EDGE = 0  # shape of what is beyond a chain


def kind_table() -> np.ndarray:
    """Kind of every code point, built once in each Python worker; marks are numbered from ``MARK`` on, with one number for all others."""
    cache = worker_cache()
    if "kind_table" not in cache:
        import regex
        classes = class_table()
        table = np.full(len(classes), MARK + len(MARKS), np.uint8)
        table[classes == SPACE] = BLANK
        table[classes == LETTER] = UNCASED
        letters = np.flatnonzero(classes == LETTER)
        every = "".join(map(chr, letters.tolist()))
        for kind, pattern in ((LOWER, r"\p{Ll}+"), (UPPER, r"\p{Lu}+")):
            for m in regex.finditer(pattern, every):
                table[letters[m.start():m.end()]] = kind
        table[48:58] = DIGIT
        for k, c in enumerate(MARKS):
            table[ord(c)] = MARK + k
        cache["kind_table"] = table
    return cache["kind_table"]


LETTER_LENGTHS = np.array([0, 1, 2, 3, 4, 4, 4, 5])  # 1, 2, 3, 4 to 6, more
CASES, LENGTHS, DIGIT_SHAPES = 4, 6, 28
FIRST_DIGIT = 1 + 2 * CASES * LENGTHS
FIRST_MARK = FIRST_DIGIT + DIGIT_SHAPES
SHAPES = 2 * (FIRST_MARK + len(MARKS) + 1)


class Tokens:
    """Tokens of texts that are joined by line feeds: places, shapes and chains."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kind_table()[points]
        group = np.where(kind <= BLANK, 0, np.where(kind <= UNCASED, 1, np.where(kind == DIGIT, 2, 3)))
        cut = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (group[1:] == 3)] if len(group) else np.zeros(0, bool))
        end = np.r_[cut[1:], len(group)].astype(np.int64)
        real = group[cut] > 0
        self.start, self.end = cut[real], end[real]
        own, length = group[self.start], self.end - self.start
        upper, wide = (np.r_[0, np.cumsum(x, dtype=np.int64)] for x in (kind == UPPER, points > 127))
        ups = upper[self.end] - upper[self.start]
        first_up = kind[self.start] == UPPER
        case = np.where(ups == 0, 0, np.where(ups == length, 1, np.where(first_up & (ups == 1), 2, 3)))
        ascii_ = wide[self.end] == wide[self.start]
        size = LETTER_LENGTHS[np.minimum(length, 7)]
        shape = 1 + (case * LENGTHS + size) * 2 + ascii_
        digits = np.flatnonzero(own == 2)
        shape[digits] = FIRST_DIGIT + self.digit_shapes(text, digits, length[digits])
        marks = own == 3
        shape[marks] = FIRST_MARK + kind[self.start[marks]] - MARK
        blank = np.r_[True, kind[:-1] == BLANK][self.start] if len(self.start) else np.zeros(0, bool)
        self.shape = shape * 2 + blank
        # a chain ends with a line, or with . ! or ? right behind a token and white space behind that
        lines = np.r_[0, np.cumsum((points == 10) | (points == 13))]
        new_line = np.r_[True, lines[self.start[1:]] != lines[self.end[:-1]]] if len(self.start) else np.zeros(0, bool)
        stops = np.isin(points[self.start], [ord(c) for c in ".!?"]) & marks
        new_line[1:] |= stops[:-1] & ~blank[:-1] & blank[1:]
        self.chain = np.cumsum(new_line)

    def digit_shapes(self, text: str, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """0 to 15 by length; 16 to 19: up to three digits, over 255; 20 to 27: 13 to 20 digits that pass the Luhn test."""
        out = np.minimum(length - 1, 15)
        for k in np.flatnonzero((length == 3) | ((length >= 13) & (length <= 19))).tolist():
            digits = text[self.start[at[k]]:self.end[at[k]]]
            if len(digits) == 3:
                out[k] = 2 if int(digits) <= 255 else 16
            else:
                out[k] = 20 + len(digits) - 13 if luhn(digits) else 15
        return out

    def beside(self, offset: int) -> np.ndarray:
        """Shapes of the tokens ``offset`` further on, ``EDGE`` beyond the chain."""
        out = np.full(len(self.shape), EDGE)
        if abs(offset) < len(out) or not offset:
            here, there = (slice(0, len(out) - offset), slice(offset, None)) if offset >= 0 else (slice(-offset, None), slice(0, offset))
            out[here] = np.where(self.chain[here] == self.chain[there], self.shape[there], EDGE)
        return out


SIDES = range(-3, 4)


def features_of(tokens: Tokens) -> list[list[str]]:
    """The features of every token by name, for training."""
    by_side = {k: tokens.beside(k).tolist() for k in SIDES}
    return [["bias", *(f"{k} {by_side[k][t]}" for k in SIDES), f"left {by_side[-1][t]} {by_side[0][t]}",
             f"right {by_side[0][t]} {by_side[1][t]}"] for t in range(len(tokens.shape))]


class Tagger:
    """Spans of the field in whole texts."""

    CHARS = 1 << 20

    def __init__(self, field: Field):
        self.between, self.sure = np.array(field.between), field.sure()
        self.single = {k: np.zeros((SHAPES, 3)) for k in SIDES}
        self.pair = {k: np.zeros((SHAPES * SHAPES, 3), np.float32) for k in ("left", "right")}
        self.bias = np.zeros(3)
        for name, w in field.weights.items():
            what, *shapes = name.split()
            if what == "bias":
                self.bias += w
            elif what in self.pair:
                self.pair[what][int(shapes[0]) * SHAPES + int(shapes[1])] = w
            else:
                self.single[int(what)][int(shapes[0])] = w

    def scores(self, tokens: Tokens) -> np.ndarray:
        sides = {k: tokens.beside(k) for k in SIDES}
        e = self.bias + self.pair["left"][sides[-1] * SHAPES + sides[0]] + self.pair["right"][sides[0] * SHAPES + sides[1]]
        for k, shapes in sides.items():
            e += self.single[k][shapes]
        return e

    def best(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of chains of scores, by Viterbi over all of them at once, the longest first."""
        order = sorted(range(len(chains)), key=lambda k: -len(chains[k]))
        sizes = np.array([len(chains[k]) for k in order])
        score = np.array([chains[k][0] for k in order])
        score[:, I] += FORBIDDEN  # nothing to be inside of
        back = []
        for step in range(1, sizes[0]):
            n = int(np.searchsorted(-sizes, -step))  # chains that go on
            every = score[:n, :, None] + self.between
            back.append(every.argmax(axis=1).astype(np.uint8))
            score[:n] = every.max(axis=1) + np.array([chains[k][step] for k in order[:n]])
        tags = [np.zeros(s, np.uint8) for s in sizes]
        now = score.argmax(axis=1)
        for step in range(sizes[0] - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -step))  # chains with a token there
            for k in range(n):
                tags[k][step] = now[k]
            if step:
                now[:n] = back[step - 1][np.arange(n), now[:n]]
        out = [None] * len(chains)
        for k, t in zip(order, tags):
            out[k] = t
        return out

    def tagged(self, text: str) -> list[tuple[int, int]]:
        """Spans in texts that are joined by line feeds."""
        tokens = Tokens(text)
        if not len(tokens.shape):
            return []
        e = self.scores(tokens)
        unsure = np.unique(tokens.chain[e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.sure])
        first, last = np.searchsorted(tokens.chain, unsure), np.searchsorted(tokens.chain, unsure, "right")
        spans = []
        for k in range(0, len(unsure), 512):
            part = list(zip(first[k:k + 512].tolist(), last[k:k + 512].tolist()))
            for (a, _), tags in zip(part, self.best([e[a:b] for a, b in part])):
                begins = np.flatnonzero(tags == B)
                for t in begins.tolist():
                    end = t
                    while end + 1 < len(tags) and tags[end + 1] == I:
                        end += 1
                    spans.append((int(tokens.start[a + t]), int(tokens.end[a + end])))
        return spans

    CUT = re.compile(r"[\n\r]")

    def cuts(self, text: str) -> list[tuple[int, int]]:
        """Parts of a long text that end with a line."""
        out, begin = [], 0
        while m := self.CUT.search(text, begin + self.CHARS):
            out.append((begin, m.end()))
            begin = m.end()
        return [*out, (begin, len(text))]

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of the patterns' spans and of those that the field adds."""
        out = []
        for i, j in slices(texts, self.CHARS):
            if j - i == 1 and len(texts[i]) > self.CHARS:
                added = [[(a + begin, b + begin) for begin, end in self.cuts(texts[i]) for a, b in self.tagged(texts[i][begin:end])]]
            else:
                starts = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
                added = [[] for _ in range(i, j)]
                for a, b in self.tagged("\n".join(texts[i:j])):
                    k = int(np.searchsorted(starts, a, "right")) - 1
                    added[k].append((a - int(starts[k]), b - int(starts[k])))
            for t, more in zip(texts[i:j], added):
                found = base_spans(t)
                if more:
                    known = sorted((a, b) for _, a, b in found)
                    reach = np.maximum.accumulate([0, *(b for _, b in known)])
                    begins = np.array([a for a, _ in known])
                    found += [(4, a, b) for a, b in more if reach[np.searchsorted(begins, b)] <= a]
                out.append(found)
        return out


def notations(random: np.random.Generator) -> list[str]:
    """Personal data as no pattern writes it: one of each notation, with other values each time."""
    def digits(n):
        return "".join(map(str, random.integers(0, 10, n)))

    def word(least, most):
        return "".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(least, most)))

    number = digits(15)
    number += next(str(d) for d in range(10) if luhn(number + str(d)))
    groups = [number[k:k + 4] for k in range(0, 16, 4)]
    a, b, c = digits(3), digits(3), digits(4)
    user, host, tld = f"{word(3, 9)}.{word(3, 9)}", word(4, 10), str(random.choice(["com", "org", "net", "de", "fr", "es"]))
    six = [f"{x:x}" for x in random.integers(0x1000, 0x10000, 8)]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(2)} {a} {b} {c}", f"0{a}/{digits(7)}",
            f"{user}(at){host}.{tld}", f"{user} [at] {host} [dot] {tld}", f"{user} @ {host}.{tld}", f"{word(4, 9)}{digits(2)} (at) {host}.{tld}",
            ".".join(groups), "/".join(groups), " - ".join(groups), " . ".join(str(random.integers(1, 256)) for _ in range(4)), ":".join(six)]


def numbers(random: np.random.Generator) -> list[str]:
    """What has digits or marks and is no personal data."""
    def n(a, b):
        return int(random.integers(a, b))

    def failing(size):
        while luhn(out := str(n(10**(size - 1), 10**size))):
            pass
        return out

    return [f"{n(1900, 2100)}-{n(10, 13)}-{n(10, 32)}", f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1, 32)}/{n(1, 13)}/{n(1900, 2100)}",
            f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"{n(1, 999)},{n(100, 1000)}.{n(10, 100)}", f"{n(1, 10)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 100)}.{n(0, 10)}%",
            f"{n(10, 999)}-{n(10, 999)}", f"{n(1, 10**7)}", f"version {n(1, 10)}.{n(0, 10)}", f"978-{n(0, 10)}-{n(10, 100)}-{n(100000, 999999)}-{n(0, 10)}",
            failing(n(13, 17)), f"{n(256, 1000)}.{n(1, 256)}.{n(256, 1000)}.{n(1, 256)}", f"@{''.join(random.choice(list('abcdefgh'), 6))}",
            f"({n(1, 100)})", f"{n(1, 10)} - {n(10, 20)}", f"[{n(1, 100)}]", f"{n(1, 10**6)} / {n(1, 10**6)}", f"{n(2, 9)}x{n(2, 9)}+{n(1, 99)}",
            hashlib.sha1(str(n(0, 10**9)).encode()).hexdigest(), f"{n(10**5, 10**6)}.{n(10, 99)}", f"({n(1900, 2100)}) {n(1, 100)}-{n(100, 200)}"]


def put_in(text: str, what: str, random: np.random.Generator) -> tuple[str, int, int]:
    """``what`` between two words of a text, and its place."""
    gaps = [0, *(m.end() for m in re.finditer(r"\s+", text)), len(text)]
    at = int(gaps[random.integers(0, len(gaps))])
    before = "" if not at or text[at - 1].isspace() else " "
    after = random.choice(["", ".", ",", ";", ")"]) + " " if at < len(text) else ""
    return text[:at] + before + what + after + text[at:], at + len(before), at + len(before) + len(what)


def labelled(pieces: list[str], seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, spans of personal data) from pieces of documents: as they are, and with a notation or a number put in."""
    random, out = np.random.default_rng(seed), []
    for text in pieces:
        known = [(a, b) for _, a, b in base_spans(text)]
        out.append((text, known))
        if not known:
            for make, positive in ((notations, True), (numbers, False), (numbers, False)):
                more, a, b = put_in(text, str(random.choice(make(random))), random)
                out.append((more, [(a, b)] if positive else [(x, y) for _, x, y in base_spans(more)]))
    return out


def tagged_chains(text: str, known: list[tuple[int, int]]) -> list[tuple[list[list[str]], list[int]]]:
    """(features, tags) of each chain of a labelled text."""
    tokens, tags = Tokens(text), []
    if not len(tokens.shape):
        return []
    known, last = sorted(known), None
    for k, (a, b) in enumerate(zip(tokens.start.tolist(), tokens.end.tolist())):
        own = next((s for s in known if s[0] < b and a < s[1]), None)
        inside = own is not None and own == last and tokens.chain[k] == tokens.chain[k - 1]
        tags.append(O if own is None else I if inside else B)
        last = own
    features, cut = features_of(tokens), [*np.flatnonzero(np.diff(tokens.chain, prepend=0)).tolist(), len(tags)]
    return [(features[a:b], tags[a:b]) for a, b in zip(cut, cut[1:])]


FOUND, NUMBER, OTHER = range(3)
PIECE = re.compile(r"[^\n\r]+")


def pieces_of(text: str, most_chars: int) -> list[tuple[int, str]]:
    """(kind, piece) of lines: the first with a match, the first with a digit, and one that the text gives."""
    out, found = [], base_spans(text)
    places = [min(a for _, a, _ in found)] if found else []
    if m := re.search("[0-9]", text):
        places.append(m.start())
    places.append(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=6).digest()) % max(1, len(text)))
    for at in places:
        begin = max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1
        m = PIECE.match(text, begin)
        if not m:
            continue
        end = m.end()
        if end - begin > most_chars:  # words around the place
            begin, end = max(begin, at - most_chars // 2), min(end, at + most_chars // 2)
            while begin and not text[begin - 1].isspace() and begin < at:
                begin += 1
            while end < len(text) and not text[end].isspace() and end > at + most_chars // 4:
                end -= 1
        piece = text[begin:end]
        kind = FOUND if base_spans(piece) else NUMBER if re.search("[0-9]", piece) else OTHER
        out.append((kind, piece))
    return out


def fit(docs: DataFrame, most_chains: int = 1200, most_chars: int = 400) -> Field:
    """Train the field on a small labelled table made of ``docs(text)``; a sample without any piece gets a few numbers alone."""
    most = {FOUND: most_chains // 3, NUMBER: most_chains // 3, OTHER: most_chains // 3}

    def run(batches):
        kept: dict[int, dict[str, int]] = {kind: {} for kind in most}

        def cut(kind):
            kept[kind] = dict(sorted(kept[kind].items(), key=lambda x: x[::-1])[:most[kind]])

        for batch in parts_of(batches):
            for text in texts_of(batch):
                for kind, piece in pieces_of(text, most_chars):
                    kept[kind][piece] = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=7).digest())
                    if len(kept[kind]) > 2 * most[kind]:
                        cut(kind)
        for kind in most:
            cut(kind)
            if kept[kind]:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(kept[kind]), pa.int32()), pa.array(kept[kind].values(), pa.int64()),
                                                  pa.array(kept[kind].keys(), pa.string())], ["kind", "order", "piece"])

    found = stage(docs.select(F.col("text").alias("text")).mapInArrow(run, "kind int, order long, piece string").distinct())
    pieces = [r.piece for kind in most for r in found.where(F.col("kind") == kind).orderBy("order", "piece").limit(most[kind]).collect()]
    return train([chain for text, known in labelled(pieces or ["call me", "see there"]) for chain in tagged_chains(text, known)])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every text."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches):
        tagger = Tagger(field)
        for batch in parts_of(batches):
            every = tagger(texts_of(batch))
            counts = [pa.array([sum(k == kind for k, _, _ in s) for s in every], pa.int64()) for kind in range(4)]
            sha = [hashlib.sha256(joined([x for x in s if x[0] < 4]).encode()).hexdigest() for s in every]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(sha, pa.string()),
                                              pa.array([joined(s) for s in every], pa.string())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
