"""Hosts of special URLs as the WHATWG standard writes them, in SQL expressions.

``host_sql`` gives a host its form, or null where the standard refuses it:
percent-decoding; A-Z and other letters in lower case; full-width letters and ideographic full stops as ASCII; code
points that the mapping ignores removed; labels with non-ASCII letters in Punycode (RFC 3492); numbers as dotted IPv4
(decimal, octal, hexadecimal; one to four parts); IPv6 in its shortest form, with an IPv4 tail as two groups.

Of the mapping of international names, Unicode normalisation is left out: a host with combining marks or with compatibility
characters other than the full-width ones counts as invalid rather than getting a wrong name.
Plain ASCII names pass by all this (``CASE``), so no link pays for what it hasn't got.
"""

from __future__ import annotations

# --- fixed values (WHATWG URL standard, UTS 46, RFC 3492) --------------------------
FORBIDDEN = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
IGNORED = "­​⁠﻿"  # removed by the mapping
FULL_STOPS = "。．｡"
FULL_WIDTH = range(0xFF01, 0xFF5F)  # ASCII 0x21 to 0x7E
# letters that need no normalisation: not combining, no ligature, letterlike or compatibility form
UNSURE = (r"[\p{M}\p{C}\x{A0}\x{A8}\x{AA}\x{AF}\x{B2}-\x{B5}\x{B8}-\x{BA}\x{BC}-\x{BE}\x{132}\x{133}\x{13F}\x{140}\x{149}\x{17F}\x{1C4}-\x{1CC}"
          r"\x{1F1}-\x{1F3}\x{2B0}-\x{2B8}\x{2D8}-\x{2DD}\x{2E0}-\x{2E4}\x{1E9A}-\x{1E9E}\x{2000}-\x{20CF}\x{2100}-\x{218F}\x{2460}-\x{24FF}"
          r"\x{3000}-\x{3004}\x{3131}-\x{33FF}\x{F900}-\x{FDFF}\x{FE10}-\x{FEFF}\x{FFE0}-\x{FFFF}\x{1D400}-\x{1D7FF}\x{2F800}-\x{2FA1F}]")
BASE, LEAST, MOST, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# ------------------------------------------------------------------------------------


def _raw(pattern: str) -> str:
    assert "'" not in pattern
    return f"r'{pattern}'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _text(characters: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in characters) + "'"


def mapped_sql(host: str) -> str:
    """Lower case, ASCII for full-width characters and full stops, ignored code points gone."""
    wide = "".join(map(chr, FULL_WIDTH)) + FULL_STOPS + IGNORED
    ascii_ = "".join(chr(c - 0xFEE0) for c in FULL_WIDTH) + "..."
    return f"lower(translate({host}, {_text(wide)}, {_text(ascii_)}))"


def punycode_sql(label: str) -> str:
    """``xn--`` and the Punycode of a label with non-ASCII characters.

    The decoder's state before each of these characters, in the order of code point and place, follows from counts, so
    all steps between them come from one array; only the digits of the steps, whose bias adapts, are folded one by one."""
    pairs = f"transform(split({label}, ''), (c, i) -> named_struct('v', ascii(c), 'i', i))"
    extended = f"array_sort(filter(ps, p -> p.v >= {FIRST_CODE}))"
    items = ("transform(ext, (p, k) -> named_struct('m', p.v, 'h', size(ps) - size(ext) + k, "
             "'i', size(filter(ps, q -> q.i < p.i AND q.v <= p.v))))")
    steps = ("transform(its, (t, k) -> named_struct('h', t.h, 'd', CASE WHEN k = 0 "
             f"THEN CAST(t.m - {FIRST_CODE} AS BIGINT) * (t.h + 1) + t.i "
             "ELSE CAST(t.m - its[k - 1].m AS BIGINT) * (t.h + 1) + t.i - its[k - 1].i - 1 END))")
    threshold = f"least(greatest({BASE} * j - acc.bias, {LEAST}), {MOST})"

    def digit(n):
        return f"substr('{DIGITS}', CAST({n} AS INT) + 1, 1)"

    # a step of less than 2^53 has at most 11 digits
    number = ("aggregate(sequence(1, 12), named_struct('q', x.d, 'o', '', 'on', true), (s, j) -> CASE WHEN NOT s.on THEN s "
              + "ELSE " + _let("t", threshold, f"CASE WHEN s.q < t THEN named_struct('q', s.q, 'o', concat(s.o, {digit('s.q')}), 'on', false) "
                               f"ELSE named_struct('q', (s.q - t) div ({BASE} - t), 'o', concat(s.o, {digit(f't + (s.q - t) % ({BASE} - t)')}), 'on', true) END")
              + " END, s -> s.o)")
    least = (BASE - LEAST) * MOST // 2
    bias = _let("e", _let("f", f"CASE WHEN acc.o = '' THEN x.d div {DAMP} ELSE x.d div 2 END", "f + f div (x.h + 1)"),
                f"aggregate(sequence(1, 9), named_struct('e', e, 'k', 0), (s, j) -> CASE WHEN s.e > {least} "
                f"THEN named_struct('e', s.e div {BASE - LEAST}, 'k', s.k + {BASE}) ELSE s END, "
                f"s -> CAST(s.k + ({BASE - LEAST + 1} * s.e) div (s.e + {SKEW}) AS INT))")
    folded = (f"aggregate(sts, named_struct('o', '', 'bias', {FIRST_BIAS}), (acc, x) -> named_struct('o', concat(acc.o, {number}), "
              f"'bias', {bias}), acc -> acc.o)")
    basic = f"regexp_replace({label}, {_raw('[^\\x00-\\x7F]')}, '')"
    code = _let("ps", pairs, _let("ext", extended, _let("its", items, _let("sts", steps, folded))))
    return f"concat('xn--', CASE WHEN {basic} <> '' THEN concat({basic}, '-') ELSE '' END, {code})"


def international_sql(host: str) -> str:
    """Labels of a mapped host with non-ASCII characters in Punycode; null if one can't be written so."""
    label = f"CASE WHEN l RLIKE {_raw('[^\\x00-\\x7F]')} THEN {punycode_sql('l')} ELSE l END"
    return f"CASE WHEN {host} RLIKE {_raw(UNSURE)} THEN NULL ELSE array_join(transform(split({host}, {_raw('\\.')}), l -> {label}), '.') END"


def ipv4_sql(host: str) -> str:
    """Dotted form of a host whose last label is a number; null if it is no address."""
    def value(p):
        bare = f"regexp_replace({p}, {_raw('^(0x|0)0*')}, '')"
        return (f"CASE WHEN {p} RLIKE {_raw('^0x[0-9a-f]*$')} THEN (CASE WHEN length({bare}) > 8 THEN NULL WHEN {bare} = '' THEN 0L "
                f"ELSE CAST(conv({bare}, 16, 10) AS BIGINT) END) "
                f"WHEN {p} RLIKE {_raw('^0[0-7]*$')} THEN (CASE WHEN length({bare}) > 11 THEN NULL WHEN {bare} = '' THEN 0L "
                f"ELSE CAST(conv({bare}, 8, 10) AS BIGINT) END) "
                f"WHEN {p} RLIKE {_raw('^[1-9][0-9]{0,9}$')} THEN CAST({p} AS BIGINT) END")

    parts = f"transform(split(regexp_replace({host}, {_raw('\\.$')}, ''), {_raw('\\.')}), p -> {value('p')})"
    ok = ("size(v) <= 4 AND NOT exists(v, x -> x IS NULL) AND forall(slice(v, 1, size(v) - 1), x -> x < 256) "
          "AND element_at(v, -1) < shiftleft(1L, 8 * (5 - size(v)))")
    number = "aggregate(slice(v, 1, size(v) - 1), 0L, (a, x) -> a * 256 + x) * shiftleft(1L, 8 * (5 - size(v))) + element_at(v, -1)"
    dotted = "concat_ws('.', shiftright(n, 24), shiftright(n, 16) & 255, shiftright(n, 8) & 255, n & 255)"
    return _let("v", parts, f"CASE WHEN {ok} THEN {_let('n', number, dotted)} END")


def ipv6_sql(text: str) -> str:
    """Shortest form of an IPv6 address (without brackets, lower case); null if it is none."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    tail = _raw(rf"^(.*:){octet}\.{octet}\.{octet}\.{octet}$")

    def part(k):
        return f"CAST(regexp_extract({text}, {tail}, {k}) AS INT)"
    with_groups = (f"CASE WHEN {text} RLIKE {tail} THEN concat(regexp_extract({text}, {tail}, 1), "
                   f"lower(hex({part(2)} * 256 + {part(3)})), ':', lower(hex({part(4)} * 256 + {part(5)}))) ELSE {text} END")
    # groups before and behind ::, and zeros for what it stands for
    group = _raw("^[0-9a-f]{1,4}$")
    sides = "transform(split(t, '::'), s -> CASE WHEN s = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split(s, ':') END)"
    filled = ("CASE WHEN size(ss) = 1 AND size(ss[0]) = 8 THEN ss[0] WHEN size(ss) = 2 AND size(ss[0]) + size(ss[1]) <= 7 "
              "THEN concat(ss[0], array_repeat('0', 8 - size(ss[0]) - size(ss[1])), ss[1]) END")
    plain = (f"CASE WHEN forall(gs, g -> g RLIKE {group}) THEN "
             f"array_join(transform(gs, g -> regexp_replace(g, {_raw('^0+(?=.)')}, '')), ':') END")
    runs = " ".join(f"WHEN f RLIKE {_raw(f'(?:^|:)0(?::0){{{n - 1}}}(?::|$)')} "
                    f"THEN regexp_replace(f, {_raw(f'^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$')}, '$1::$2')" for n in range(8, 1, -1))
    return _let("t", with_groups, _let("ss", sides, _let("gs", filled, _let("f", plain, f"CASE {runs} ELSE f END"))))


def host_sql(host: str) -> str:
    """The form of a non-empty host as it stands in a special URL; null where it is invalid."""
    plain = _raw(r"^[0-9A-Za-z_~!$&()*+,;=.-]*[A-Za-z_~!$&()*+,;=-]\.?$")
    number = _raw(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
    decoded = f"CASE WHEN contains({host}, '%') THEN try_url_decode(replace({host}, '+', '%2B')) ELSE {host} END"
    ascii_ = f"CASE WHEN m RLIKE {_raw('[^\\x00-\\x7F]')} THEN {international_sql('m')} ELSE m END"
    named = (f"CASE WHEN d IS NULL OR d = '' OR d RLIKE {_raw(FORBIDDEN)} THEN NULL "
             f"WHEN d RLIKE {number} THEN {ipv4_sql('d')} ELSE d END")
    name = _let("m", mapped_sql(decoded), _let("d", ascii_, named))
    bracketed = f"concat('[', {ipv6_sql(f'lower(substring({host}, 2, length({host}) - 2))')}, ']')"
    # 0x at the end of a plain name may be a number
    return (f"CASE WHEN {host} RLIKE {plain} AND NOT lower({host}) RLIKE {number} THEN lower({host}) "
            f"WHEN startswith({host}, '[') THEN (CASE WHEN endswith({host}, ']') THEN {bracketed} END) ELSE {name} END")
