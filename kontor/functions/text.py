"""Text normalisation as JVM-side Column expressions.

Spark has no NFKC/NFKD function. Single-character mappings are applied with ``translate`` over a table
derived from Unicode data; the few multi-character cases and base+accent compositions sit behind an
``rlike`` guard, so plain text never pays for them. This covers Latin, punctuation and full-width forms. Only
values with characters of other scripts go to an Arrow kernel, a column at a time; all others reach it as NULL.
"""

from __future__ import annotations

import re

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from kontor import vocab as V

# Whitespace as the input side understands it; Java's \s misses most of these.
_WIDE_SPACES = "\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f" + _WIDE_SPACES
WS_CLASS = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_WORD_RUN = r"[^\p{L}\p{N}_]+"
_NON_ASCII = r"[^\x00-\x7F]"
# Characters outside what the native tables cover, and marks that may join others than the listed letters.
_OTHER_SCRIPT = r"[^\x00-\u024f\u0300-\u0303\u0308\u030a\u030c\u0327\u0328\u2000-\u218f\ufb00-\ufb06\uff01-\uff5e]"


@functools.lru_cache(maxsize=None)
def _compat_tables() -> tuple[str, str, tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]:
    ranges = [range(0xA0, 0x250), range(0x2000, 0x2190), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F)]
    source, target, expand = [], [], []
    for code in (c for r in ranges for c in r):
        char = chr(code)
        mapped = unicodedata.normalize("NFKC", char)
        if mapped == char:
            continue
        if len(mapped) == 1:
            source.append(char)
            target.append(mapped)
        else:
            expand.append((char, mapped))
    compose = []
    for accent in "\u0300\u0301\u0302\u0303\u0308\u030a\u030c\u0327\u0328":
        for base in "AEIOUYNCSZaeiouyncsz":
            joined = unicodedata.normalize("NFC", base + accent)
            if len(joined) == 1:
                compose.append((base + accent, joined))
    return "".join(source), "".join(target), tuple(expand), tuple(compose)


@functools.lru_cache(maxsize=None)
def _accent_table() -> tuple[str, str]:
    """Single letters whose decomposition is one base letter plus combining marks."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(char) == 1 and len(base) == 1 and base != char and char not in source:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def _replace_all(column: Column, pairs) -> Column:
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, column)


def nfkc(column: Column) -> Column:
    """Compatibility composition; ASCII values leave through the first branch.

    Multi-character cases run through one constant list of replacements instead of a chain of calls,
    which keeps the generated code small.
    """
    source, target, expand, compose = _compat_tables()
    mapped = F.translate(column, source, target)
    listed = F.split(F.lit("\n".join(f"{a}\t{b}" for a, b in (*expand, *compose))), "\n")
    replaced = F.aggregate(listed, mapped, lambda value, pair: F.replace(
        value, F.substring_index(pair, "\t", 1), F.substring_index(pair, "\t", -1)))
    special = "[\u0300-\u036f" + "".join(char for char, _ in expand) + "]"
    return F.when(~column.rlike(_NON_ASCII), column).when(column.rlike(special), replaced).otherwise(mapped)


@pandas_udf(StringType())
def _normalized(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")  # Arrow's own kernel leaves marks apart


def nfkc_any(column: Column) -> Column:
    """Compatibility composition of any script; not for use inside array functions, which take no Python kernel."""
    # the short test first: plain text never pays for the search through all the ranges
    other = column.rlike(_NON_ASCII) & column.rlike(_OTHER_SCRIPT)
    return F.coalesce(_normalized(F.when(other, column)), nfkc(column))


def once(value: Column, use) -> Column:
    """``use`` of a value that it names several times: the value is computed once a row, not once a mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(WS))


def collapse(column: Column) -> Column:
    """Whitespace runs become one blank, the ends are trimmed."""
    return F.trim(F.regexp_replace(column, WS_CLASS + "+", " "))


def as_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def clean_missing(column: Column) -> Column:
    """NULL, NaN and the words for 'missing' become '' (X1)."""
    value = strip(column.cast("string"))
    return F.when(value.isNull() | F.lower(value).isin(*V.MISSING_WORDS), "").otherwise(value)


def is_blank(column: Column) -> Column:
    """NULL, NaN of a numeric column, or only whitespace."""
    return column.isNull() | (strip(as_text(column)) == "")


def text(column: Column) -> Column:
    """NFKC, collapsed whitespace; NULL becomes '' (X2)."""
    return collapse(nfkc_any(as_text(column)))


def cell_text(column: Column) -> Column:
    """``text`` of cells written in Latin signs: phones, mailboxes, addresses of the web, postal codes."""
    return collapse(nfkc(as_text(column)))


def casefold(column: Column) -> Column:
    return F.translate(F.replace(F.lower(column), F.lit("ß"), F.lit("ss")), "ς", "σ")


def norm_name(column: Column) -> Column:
    """Comparison form of a company or place name."""
    return F.trim(F.regexp_replace(casefold(text(column)), NON_WORD_RUN, " "))


def company_key(name: Column, city: Column) -> Column:
    """Case-insensitive key of name and city; the separator is whitespace and collapses."""
    joined = F.concat(strip(as_text(name)), F.lit("\x1f"), strip(as_text(city)))
    return collapse(nfkc_any(casefold(joined)))


def normalize_status(column: Column) -> Column:
    return casefold(clean_missing(column))


def clean_label(column: Column) -> Column:
    """Legal-notice variant of X6: also strips separators at both ends."""
    return F.trim(F.regexp_replace(as_text(column), WS_CLASS + "+", " "), F.lit(" \t:;|"))


def ascii_words(column: Column) -> Column:
    """Lower-case text without accents, dots and commas as blanks."""
    source, target = _accent_table()

    def plain(folded: Column) -> Column:
        return F.when(folded.rlike(_NON_ASCII), F.regexp_replace(F.translate(folded, source, target), r"[\u0300-\u036f]", "")).otherwise(folded)

    folded = once(clean_missing(column), lambda value: casefold(nfkc(value)))
    return F.trim(F.regexp_replace(once(folded, plain), WS_CLASS[:-1] + ".,]+", " "))


def digit_runs(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(r"(\d+)"), F.lit(1))


def deletion_signatures(column: Column) -> Column:
    """The string and every variant with one character removed."""
    size = F.length(column)
    shorter = F.transform(
        F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.substring(column, F.lit(1), i - 1), F.substring(column, i + 1, size)),
    )
    return F.array_distinct(F.concat(F.array(column), shorter))


def maps_url(name: Column, street: Column, postal: Column, city: Column, country: Column) -> Column:
    """Map search link of the non-blank address parts."""
    parts = F.array(*[strip(as_text(c)) for c in (name, street, postal, city, country)])
    address = F.array_join(F.filter(parts, lambda p: p != ""), ", ")
    quoted = _replace_all(F.url_encode(address), (("+", "%20"), ("%7E", "~"), ("*", "%2A")))
    return F.when(address == "", "").otherwise(
        F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), quoted))


def display_value(column: Column, empty: str = "") -> Column:
    value = clean_missing(column)
    return F.when(value == "", F.lit(empty)).otherwise(value)


def or_null(column: Column) -> Column:
    """NULL for '' (``nullif`` would add a common-expression projection per use)."""
    return F.when(column != "", column)


def any_word(words) -> str:
    """A pattern for any of the literal words, longer ones first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"
