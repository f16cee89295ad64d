"""Text normalisation as Column builders.

Every function maps Column -> Column and stays inside whole-stage codegen,
except :func:`fold_ascii`, which needs Unicode decomposition the JVM functions
do not offer and therefore runs as an Arrow UDF on the non-ASCII rows only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The characters that count as white space in a text, once as a
# trim set and once as a regular-expression class understood by Java and RE2.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Licence header and footer markers of a public-domain e-book.
LICENCE_HEADER = r"(?is)^.*?\*{3}\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*{3}"
LICENCE_FOOTER = r"(?is)\*{3}\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*"

# Control characters that are deleted from a text.
CONTROL = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}]"

# Abbreviations and the place names they stand for.
SURFACE_FORMS = {
    "N.Y.": "New York",
    "N.Y": "New York",
    "NYC": "New York City",
    "N.Y.C.": "New York City",
    "L.I.": "Long Island",
    "L.I": "Long Island",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(col(c), F.lit(SPACES))


def collapse(c: Column | str) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return strip(F.regexp_replace(col(c), SPACE + "+", " "))


def fold(c: Column | str) -> Column:
    """Comparison key: lower case, collapsed white space."""
    return collapse(F.lower(col(c)))


def strip_licence(c: Column | str) -> Column:
    """Keep what lies between the licence header and footer, if present."""
    body = F.regexp_replace(col(c), LICENCE_HEADER, "")
    marked = F.contains(col(c), F.lit("***"))  # either marker holds three stars; few texts do
    return strip(F.when(marked, F.regexp_replace(body, LICENCE_FOOTER, "")).otherwise(col(c)))


def tidy(c: Column | str, ellipsis: bool = True) -> Column:
    """Line ends, control characters, blank lines and typographic punctuation."""
    out = F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, CONTROL, "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    for mark, plain in zip("’‘“”–—", ("'", "'", '"', '"', "-", "--")):  # byte searches, where translate looks up every character
        out = F.replace(out, F.lit(mark), F.lit(plain))
    if ellipsis:
        out = F.replace(out, F.lit("…"), F.lit("..."))
    return out


@F.pandas_udf(StringType())
def _decompose(values: pd.Series) -> pd.Series:
    def ascii_only(v):
        if v is None:
            return None
        return unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")
    return values.map(ascii_only)


def fold_ascii(c: Column | str) -> Column:
    """Drop accents and every character without an ASCII form."""
    plain = col(c).rlike(r"^[\x{0}-\x{7F}]*$")
    return F.coalesce(F.when(plain, col(c)), _decompose(F.when(~plain, col(c))))


def slug(c: Column | str) -> Column:
    """File-system safe identifier; an empty result becomes ``doc``."""
    joined = F.regexp_replace(F.lower(fold_ascii(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.btrim(joined, F.lit("_")), F.lit("")), F.lit("doc"))


def drop_leading_the(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "^the_", "")


def surface(c: Column | str) -> Column:
    """Collapse white space, then spell out known abbreviations."""
    tidy_name = collapse(c)
    return F.coalesce(_lookup(SURFACE_FORMS, tidy_name), tidy_name)


def title_case(c: Column | str) -> Column:
    """Capitalise each letter that does not follow a letter (input is lower case)."""
    chars = F.split(col(c), "")
    after_letter = lambda i: F.get(chars, i - 1).rlike(r"^\p{L}$")
    # a letter may have a two-letter capital form, of which only the first stays upper
    capital = lambda ch: F.concat(F.substring(F.upper(ch), 1, 1), F.lower(F.substring(F.upper(ch), 2, 9)))
    return F.array_join(
        F.transform(chars, lambda ch, i: F.when((i > 0) & after_letter(i), ch).otherwise(capital(ch))),
        "",
    )


def canonical(c: Column | str) -> Column:
    """Stable name: abbreviations spelt out, all-lower-case names title-cased."""
    trimmed = strip(c)
    named = F.coalesce(_lookup(SURFACE_FORMS, trimmed), trimmed)
    return F.when((named == F.lower(named)) & (F.length(named) > 2), title_case(named)).otherwise(named)


def _lookup(values: dict, key: Column) -> Column:
    """A fixed dictionary as one CASE expression (no join, no map allocation)."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def token_set(c: Column | str) -> Column:
    """Distinct alphanumeric tokens of the comparison key."""
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), 0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets: both empty -> 1, one empty -> 0."""
    na, nb = F.size(a), F.size(b)
    common = F.size(F.array_intersect(a, b))
    return (
        F.when((na == 0) & (nb == 0), F.lit(1.0))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(common / (na + nb - common))
    )


def snippet(text: Column, start: Column, end: Column, margin: int = 20) -> Column:
    """``...context...`` around the 0-based span [start, end)."""
    lo = F.greatest(F.lit(0), start - margin)
    hi = F.least(F.length(text), end + margin)
    return F.concat(F.lit("..."), F.substring(text, lo + 1, hi - lo), F.lit("..."))


def occurrences(text: Column, needle: Column) -> Column:
    """0-based starts of every occurrence of ``needle``, overlapping ones included.

    Splitting at a zero-width look-ahead cuts the text right before each
    occurrence, so the running length of the pieces is the list of starts; the
    scan is linear in the text. A cut at position 0 produces no empty piece.
    Most texts hold a needle once or not at all, which two plain searches tell without a pattern.
    """
    first = F.instr(text, needle)
    again = F.position(needle, text, first + 1)
    quoted = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")), -1)
    ends = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p)).alias("at"),
            F.array_append(acc["cuts"], acc["at"]).alias("cuts"),
        ),
        lambda acc: acc["cuts"],
    )
    every = F.when(F.startswith(text, needle), ends).otherwise(F.slice(ends, 2, F.size(ends)))
    return F.when(needle == "", every).when(first == 0, F.array().cast("array<int>")).when(
        (first > 0) & (again == 0), F.array(first - 1)).otherwise(every)  # a search from nowhere gives 0


def safe_tag(c: Column | str) -> Column:
    return F.translate(col(c), ":/", "__")


def safe_file(c: Column | str) -> Column:
    return F.translate(col(c), " /", "__")
