"""Text expressions (E1, E3, E4, E7, E9, E18 and the whitespace class).

Everything here returns a native Column.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's semantics) --------------------
# JavaScript's String.prototype.trim / \s whitespace: tab, LF, VT, FF, CR, space,
# NBSP, OGHAM SPACE MARK, U+2000..U+200A, LINE SEPARATOR, PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE, BOM.
# Written in a syntax both Java regex and RE2 (DuckDB) accept.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Document extensions removed from a file stem, longest first.
DOC_EXTENSIONS = r"(\.html\.md|\.md|\.markdown|\.mdx|\.html|\.htm)"
# ---------------------------------------------------------------------------

NON_ASCII = r"[^\x00-\x7F]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# the same whitespace class as a character set for the trim functions, which
# only look at the ends of a string (a regex would be tried at every position)
WS_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(col) -> Column:
    """String.prototype.trim with the JS whitespace class."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def js_trim_end(col) -> Column:
    return F.rtrim(_c(col), F.lit(WS_CHARS))


def js_trim_start(col) -> Column:
    return F.ltrim(_c(col), F.lit(WS_CHARS))


def normalize_href(col) -> Column:
    """Trim; strip ``<...>`` and trim again; ``target "title"`` keeps the target."""
    h1 = js_trim(col)
    inner = F.substring(h1, 2, 1 << 30)
    inner = F.regexp_replace(inner, ">\\z", "")
    h2 = F.when(h1.startswith("<") & h1.endswith(">") & (F.length(h1) >= 2), js_trim(inner)).otherwise(h1)
    titled = f"^([^{WS}]+)[{WS}]+[\"'][^\"']+[\"']\\z"
    return F.when(h2.rlike(titled), F.regexp_extract(h2, titled, 1)).otherwise(h2)


def strip_document_extension(col) -> Column:
    """One trailing document extension, case-insensitive."""
    return F.regexp_replace(_c(col), f"(?i){DOC_EXTENSIONS}\\z", "")


def trim_trailing_slash(col) -> Column:
    """All trailing ``/`` removed, ``/`` itself kept."""
    c = _c(col)
    return F.when(c == "/", c).otherwise(F.regexp_replace(c, "/+\\z", ""))


def ensure_trailing_newline(col) -> Column:
    """E9."""
    c = _c(col)
    return F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def escape_table(col) -> Column:
    """``|`` -> ``\\|``; a line break -> space."""
    return F.regexp_replace(F.regexp_replace(_c(col), "\\|", "\\\\|"), "\\r?\\n", " ")


@functools.lru_cache(1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Code points whose fold is one code point or none (as the two texts of ``translate``), and
    those with a longer one, by the rule itself; Hangul syllables follow from their number (``_hangul``)."""
    one, target, none, many = [], [], [], {}
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000)]):
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")
        if len(folded) > 1:
            many[c] = folded
        elif not folded:
            none.append(c)
        elif folded != c:
            one.append(c)
            target.append(folded)
    return "".join(one + none), "".join(target), many


def _class_of(characters) -> str:
    """A regular expression class of the characters, in ranges."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def fold_accents(col) -> Column:
    """NFKD of every code point followed by removal of U+0300..U+036F (the Unicode half of E3; marks
    outside that range keep their order, which no path shows).  ASCII texts pass as they are."""
    c = _c(col)
    source, target, many = _folds()
    # names and values as one constant text each, which the optimizer turns into one constant map
    names, values = ("\x01".join(x) for x in (many.keys(), many.values()))
    table = F.map_from_arrays(F.split(F.lit(names), "\x01"), F.split(F.lit(values), "\x01"))
    longer = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), _hangul(x), x)), "")
    some = c.rlike(_class_of([*many, *map(chr, range(0xAC00, 0xD7A4))]))
    return (F.when(some, F.translate(longer, source, target)).when(c.rlike(NON_ASCII), F.translate(c, source, target)).otherwise(c))


def _hangul(x: Column) -> Column:
    """The letters of a Hangul syllable; null for other characters."""
    n = F.ascii(x) - 0xAC00

    def letter(k):
        return F.decode(F.unhex(F.lpad(F.hex(k.cast("long")), 4, "0")), "UTF-16BE")
    last = F.when(n % 28 > 0, letter(n % 28 + 0x11A7)).otherwise(F.lit(""))
    return F.when(F.ascii(x).between(0xAC00, 0xD7A3), F.concat(
        letter(F.floor(n / 588) + 0x1100), letter(F.floor((n % 588) / 28) + 0x1161), last))


def with_folded(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Add ``dst`` = NFKD-folded ``src``, in expressions only."""
    return df.withColumn(dst, fold_accents(src))
