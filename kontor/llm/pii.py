"""Personal data in texts, also where it is disguised, with spans in the text as it stands.

Plain identifiers are found in the text itself. For disguised ones a transducer rewrites look-alike characters,
spelled digits and written-out at and dot signs, remembering for every rewritten stretch where it came from; the same
detectors run over the result, and spans that touch a rewritten stretch are mapped back to the source characters.
A span inside a plain one of its kind is not added.

Null and empty texts have no spans. Repeated rows are searched each on its own. Only named columns are read, so others
cannot clash. Texts of any length are searched whole; the detectors take time in proportion to the length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import column, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Digits written out in English, German, French and Spanish.
SPELLED = {
    "0": ("zero", "null", "zéro", "cero"), "1": ("one", "eins", "un", "uno"), "2": ("two", "zwei", "deux", "dos"),
    "3": ("three", "drei", "trois", "tres"), "4": ("four", "vier", "quatre", "cuatro"), "5": ("five", "fünf", "cinq", "cinco"),
    "6": ("six", "sechs", "seis"), "7": ("seven", "sieben", "sept", "siete"), "8": ("eight", "acht", "huit", "ocho"),
    "9": ("nine", "neun", "neuf", "nueve"), "+": ("plus", "más")}
AT_WORDS = ("at", "ät", "arroba", "arobase", "klammeraffe", "@")
DOT_WORDS = ("dot", "punkt", "point", "punto", "period", r"\.")
# Endings that an address in plain words must have.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "eu", "de", "fr", "es", "uk", "us", "ch", "at", "it", "nl")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaopvikABEZHIKMNOPTYX"))
HIDDEN = "­​‌‍⁠﻿"

_DIGIT_OF = {word: digit for digit, words in SPELLED.items() for word in words}
_NUMBER_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_at, _dot = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_PLAIN_DOT = "|".join(DOT_WORDS[:-1])
_AFTER_AT = rf"(?=[a-z0-9-]+(?:\s*{_OPEN}\s*(?:{_dot})\s*{_CLOSE}\s*|\s+(?:{_PLAIN_DOT})\s+)(?:[a-z0-9-]+(?:\s+(?:{_PLAIN_DOT})\s+|\.))*(?:{'|'.join(ENDINGS)})(?!\w))"
_REWRITE = re.compile(
    rf"(?P<at>(?<!\s)\s*{_OPEN}\s*(?:{_at})\s*{_CLOSE}\s*|(?<=[a-z0-9])\s+(?:at|arroba|arobase)\s+{_AFTER_AT})"
    rf"|(?P<dot>(?<!\s)\s*{_OPEN}\s*(?:{_dot})\s*{_CLOSE}\s*|(?<=[a-z0-9])\s+(?:{_PLAIN_DOT})\s+(?=[a-z0-9]))"
    rf"|(?P<digits>(?<!\w)(?:{_NUMBER_WORD})(?!\w)(?:[\s,-]*(?<!\w)(?:{_NUMBER_WORD}|[0-9])(?!\w))*)"
    rf"|(?P<odd>[^\x00-ɏ‐-‧]|[{HIDDEN}․])", re.IGNORECASE)
_WORDS = re.compile(rf"{_NUMBER_WORD}|[0-9]", re.IGNORECASE)
# Which texts the transducer has to read: all that _REWRITE finds something in (RE2; its \s, \w and (?i) know fewer characters).
_SPACE, _EDGE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]*", "[^0-9A-Za-z_]"
_DISGUISED = (
    rf"(?i)[\[({{<]{_SPACE}(?:{_at}|{_dot}){_SPACE}[\])}}>]|[^\pL](?:{_PLAIN_DOT})[^\pL]|[{HIDDEN}\x{{2024}}]"
    rf"|(?:^|{_EDGE})(?:{_NUMBER_WORD})(?:{_EDGE}|$)").replace("i", "[iİı]").replace("(?[iİı])", "(?i)") + r"|[^\x00-\x{24F}\x{2010}-\x{2027}]"
# letters that the patterns above also take for i and s
_FOLDED = str.maketrans({"İ": "i", "ı": "i", "ſ": "s"})

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that starts inside a run of digits would also start at its head, so only heads are tried
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at signs: the name before it reaches back to the last match at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            done = found.end()
            out.append((begin, done))
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


@lru_cache(maxsize=4096)
def plain_character(char: str) -> str:
    """The ASCII character that one of another script stands for; itself where there is none."""
    if char in HIDDEN:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    folded = unicodedata.normalize("NFKC", char)
    if len(folded) == 1 and folded.isascii():
        return folded
    digit = unicodedata.decimal(char, None)
    return char if digit is None else str(digit)


class Transduced:
    """A rewritten text; ``marks`` are (start in the new text, start in the old, end in the old, rewritten)."""

    def __init__(self, text: str):
        parts, self.marks, size, done = [], [], 0, 0
        for m in _REWRITE.finditer(text):
            if m.lastgroup == "digits":
                new = "".join(w if w.isdigit() else _DIGIT_OF[w] for w in (x.translate(_FOLDED).lower() for x in _WORDS.findall(m[0])))
            else:
                new = {"at": "@", "dot": "."}.get(m.lastgroup) or plain_character(m[0])
                if m.lastgroup == "odd" and new == m[0]:
                    continue
            begin, end = m.span()
            if begin > done:
                self.marks.append((size, done, begin, False))
                parts.append(text[done:begin])
                size += begin - done
            self.marks.append((size, begin, end, True))
            parts.append(new)
            size += len(new)
            done = end
        if self.marks:
            self.marks.append((size, done, len(text), False))
            parts.append(text[done:])
        self.text = "".join(parts)
        self.starts = [m[0] for m in self.marks]

    def source(self, start: int, end: int) -> Span | None:
        """Where a span of the new text lies in the old one; None if nothing in it was rewritten."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        if not any(m[3] for m in self.marks[first:last + 1]):
            return None
        a, b = self.marks[first], self.marks[last]
        return (a[1] if a[3] else a[1] + start - a[0]), (b[2] if b[3] else b[1] + end - b[0])


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Further spans by kind that only the rewritten text shows."""
    new, out = Transduced(text), {}
    for kind, detect in DETECTORS.items() if new.marks else ():
        spans = []
        for start, end in detect(new.text):
            at = new.source(start, end)
            if at and not any(a <= at[0] and at[1] <= b for a, b in plain.get(kind, ())):
                spans.append(at)
        if spans:
            out[kind] = spans
    return out


def listed(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by start, then kind."""
    ordered = sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in spans.get(kind, ()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in ordered)


def _maybe(texts: pa.Array) -> dict[str, np.ndarray]:
    """Which texts each detector has to read at all."""
    has = lambda rule: np.asarray(pc.match_substring_regex(texts, rule))
    return {"email": np.asarray(pc.match_substring(texts, "@")), "ip": has(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
            "card": has(r"[0-9](?:[ -]?[0-9]){11}"), "phone": has(r"\+[0-9][ ().0-9-]+[0-9]"), "": has(_DISGUISED)}


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def found_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: plain spans counted by kind and digested, and all spans, disguised ones included (``n_added`` of them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = column(batch, "text")
            maybe = _maybe(texts)
            n = len(texts)
            counts, plain_list, all_list, added = {k: np.zeros(n, np.int64) for k in KINDS}, [""] * n, [""] * n, np.zeros(n, np.int64)
            for row in np.flatnonzero(np.logical_or.reduce(list(maybe.values()))).tolist():
                whole = texts[row].as_py()
                plain = {k: DETECTORS[k](whole) for k in KINDS if maybe[k][row]}
                more = disguised(whole, plain) if maybe[""][row] else {}
                for kind, spans in plain.items():
                    counts[kind][row] = len(spans)
                plain_list[row] = listed(plain)
                added[row] = sum(map(len, more.values()))
                all_list[row] = listed({k: plain.get(k, []) + more.get(k, []) for k in KINDS}) if more else plain_list[row]
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in plain_list]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[k]) for k in KINDS], pa.array(digests, pa.string()), pa.array(all_list, pa.string()), pa.array(added)],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
