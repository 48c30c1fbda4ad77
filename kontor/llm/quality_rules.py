"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose measure lies above a cutoff. Labelled documents are the holdout. Per stratum and
rule, cutoffs are tested from the most lenient one on: a cutoff is certified when an exact binomial test refutes that
it rejects good documents at the rule's share of the risk or more, and testing stops at the first that fails, so the
sequence costs one test. The level is divided by the number of strata and rules. Among certified cutoffs the one that
rejects most bad documents, each good one counting as ``good_cost`` bad ones, is taken; where none is certified (too few
labels, an unknown stratum) the rule rejects nothing. With confidence ``1 - alpha``, no stratum loses more than ``risk``
of its good documents to these rules.

Null texts have no words and fail the base rule. A null stratum is a stratum of its own. Null or repeated labels:
rows without a label of 0 or 1 are left out, repeated ones count as often as they occur. Empty tables give empty
results. Only named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import column, ragged, slices, stored, words_of

WINDOW = 8
RULES = ("symbols", "capitals", "punctuation", "repeated_lines", "repeated_words", "stutter")
#: Cutoffs from lenient to strict, the same for every rule: shares per word, letter or line.
GRID = [round(float(x), 6) for x in np.geomspace(1.0, 0.02, 24)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES = " \t\n\x0b\x0c\r"


def _byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# two counts share one number: the low and the high 32 bits
_FIRST = _byte_class("#*$%&|<>") + (_byte_class(_UPPER) << 32)
_SECOND = _byte_class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + (_byte_class(_LOWER) << 32)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values``; 0 for an empty run."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def repeated_words(codes: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows of ``width`` words that the text has twice or more."""
    lengths = np.diff(offsets)
    many = np.maximum(lengths - width + 1, 0)
    starts = ragged(offsets[:-1], many)
    if not len(starts):
        return np.zeros(len(lengths), np.int64)
    owner = np.repeat(np.arange(len(lengths)), many)
    key = (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    for k in range(width):
        key = (key ^ mixed[starts + k]) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    twice = np.zeros(len(starts), bool)
    if len(same):
        a, b = order[same], order[same + 1]
        equal = owner[a] == owner[b]
        for k in range(width):
            equal &= codes[starts[a] + k] == codes[starts[b] + k]
        if equal.all():
            twice[a] = twice[b] = True
        else:  # two different windows with one hash: compare the windows themselves
            near = np.unique(np.concatenate([a, b]))
            rows = np.column_stack([owner[near]] + [codes[starts[near] + k] for k in range(width)])
            _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            twice[near] = count[inverse.reshape(-1)] > 1
    edge = np.zeros(int(offsets[-1]) + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + width, -1)
    return _sums((np.cumsum(edge)[:-1] > 0).astype(np.int64), offsets)


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts and rule measures of a batch of texts (no nulls)."""
    flat, offsets = words_of(texts)
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    chars = np.asarray(pc.utf8_length(coded.dictionary), dtype=np.int64)
    n_words = np.diff(offsets)
    word_chars = _sums(chars[codes] if len(codes) else codes, offsets)
    _, where, data = texts.buffers()
    edges = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    text_bytes = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    first, second = _sums(_FIRST[text_bytes], edges), _sums(_SECOND[text_bytes], edges)
    symbols, upper = first & 0xFFFFFFFF, first >> 32
    punctuation, lower = second & 0xFFFFFFFF, second >> 32
    n_lines, n_dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(_SPACES)]
            n_lines[k], n_dup[k] = len(lines), len(lines) - len(set(lines))
    again = np.zeros(len(codes), np.int64)
    if len(codes) > 1:
        again[1:] = codes[1:] == codes[:-1]
        again[offsets[:-1][n_words > 0]] = 0
    covered = repeated_words(codes, offsets)
    words = np.maximum(n_words, 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": n_dup, "n_repeat_words": covered,
        "symbols": symbols / words, "capitals": upper / np.maximum(upper + lower, 1), "punctuation": punctuation / words / 4,
        "repeated_lines": n_dup / np.maximum(n_lines, 1), "repeated_words": covered / words, "stutter": _sums(again, offsets) / words}


def measured(docs: DataFrame, stratum: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, stratum, counts, rule measures) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = measures(column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("stratum"), *[pa.array(found[c]) for c in (*COUNTS, *RULES)]],
                ["doc_id", "stratum", *COUNTS, *RULES])

    kinds = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RULES])
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"),
                       F.col(text).alias("text")).mapInArrow(run, f"doc_id long, stratum string, {kinds}")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed exactly in logarithms."""
    if n == 0:
        return 1.0
    i = np.arange(k + 1)
    choose = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()])
    logs = choose + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, n_good: int, risk: float, level: float, good_cost: float) -> int:
    """Place of the chosen cutoff, -1 for none. ``good`` and ``bad``: documents each cutoff rejects, lenient first."""
    best, gain = -1, 0.0
    for place, k in enumerate(good.tolist()):
        if k >= risk * n_good or binomial_tail(int(k), n_good, risk) > level:
            break
        if bad[place] - good_cost * k > gain:
            best, gain = place, bad[place] - good_cost * k
    return best


def fitted_cutoffs(measured_docs: DataFrame, labels: DataFrame, risk: float = 0.03, alpha: float = 0.05, good_cost: float = 10.0,
                   key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, one cutoff per rule): null where a rule is off. The labelled rows are counted into bins of the grid
    before anything is gathered: a stratum's table has rules x bins rows, however many labels it has."""
    told = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).filter("good IN (0, 1)")
    grid = F.array(*[F.lit(g) for g in GRID])

    def bin_of(rule: str) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.size(F.filter(grid, lambda cut: cut >= F.col(rule))).alias("bin"))

    bins = F.explode(F.array(*[bin_of(r) for r in RULES]))
    counts = stored(measured_docs.filter("n_words >= 20").join(told, "doc_id").select("stratum", "good", bins.alias("b")).groupBy(
        "stratum", "b.rule", "b.bin").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "label-bins")
    strata = counts.select("stratum").distinct().count()
    level = alpha / max(1, strata * len(RULES))

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": own["stratum"].iloc[0]}
        for rule in RULES:
            mine = own[own["rule"] == rule]
            # bin b: the first b cutoffs do not reject; cutoff c rejects the bins up to c
            good = np.bincount(mine["bin"], mine["good"], len(GRID) + 1).astype(np.int64)
            bad = np.bincount(mine["bin"], mine["bad"], len(GRID) + 1).astype(np.int64)
            at = choose_cutoff(np.cumsum(good)[:-1], np.cumsum(bad)[:-1], int(good.sum()), risk / len(RULES), level, good_cost)
            row[rule] = GRID[at] if at >= 0 else None
        return pd.DataFrame([row]).astype({r: "float64" for r in RULES})

    return stored(counts.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"{r} double" for r in RULES)), "cutoffs")


def judged(measured_docs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    limits = cutoffs.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__{r}") for r in RULES])
    joined = measured_docs.join(limits, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"__{rule}"), F.lit(False))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected).drop("__stratum", *[f"__{r}" for r in RULES])


def quality_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits) -> DataFrame:
    """(doc_id, stratum, counts, rule measures, base_failed, kept) of every row; texts are read once."""
    table = stored(measured(docs, stratum), "measures")
    return judged(table, fitted_cutoffs(table, labels, **limits))


def accepted(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were. Measuring twice is cheaper than moving texts."""
    cutoffs = fitted_cutoffs(stored(measured(docs, stratum, text, key), "measures"), labels, **limits)
    limits_of = cutoffs.select(F.col("stratum").alias("__stratum"), F.array(*[F.col(r) for r in RULES]).alias("__limits"))
    tagged = docs.join(limits_of, F.col(stratum).cast("string").eqNullSafe(F.col("__stratum")), "left").drop("__stratum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = measures(column(batch, text))
            keep = ~((found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"]))
            rows = batch.column("__limits").to_pylist()
            for k, rule in enumerate(RULES):
                cut = np.array([np.inf if x is None or x[k] is None else x[k] for x in rows])
                keep &= ~(found[rule] > cut)
            yield batch.filter(pa.array(keep)).drop_columns(["__limits"])

    return tagged.mapInArrow(run, docs.schema)
