"""Fill-in-the-middle examples with cuts found by a piecewise-linear rank index (operator 13).

A text consists of n units; here lines. The end of unit k is a boundary, so ranks 0 to n map to growing offsets. That map
is stored as line segments: each starts at a rank with its exact offset and a slope, chosen so that no boundary lies
more than ``BOUND`` bytes off its line, and what a boundary lies off is kept as a signed byte. A cut at rank k is the
rounded value of the segment that holds k plus the residual of k: exact, without a search in the text. A segment whose
line misses the bound is halved until every part holds it; two neighbouring boundaries always do.

The form of an example (plain, or prefix, suffix and middle in one of two orders) and its two cuts come from a digest of
seed and document id, so reruns agree.

Defined results: a null text counts as empty, which is plain; a text that contains a marker is plain; a null id is
hashed as an empty one; equal rows give equal examples; an empty table gives an empty one. Texts are never cut inside
a code point, whatever their length. The result has its own columns only, so no column of the table can clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import column, ragged, slices

#: The markers of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Largest residual; residuals are signed bytes.
BOUND = 127
SEED = 7
#: Percent of texts that are cut at all, and percent of those that start with the suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 100, 50


class RankIndex:
    """Boundaries of many texts: ``edges[t]`` to ``edges[t + 1]`` are the places of text t's boundaries."""

    def __init__(self, offsets: np.ndarray, edges: np.ndarray):
        first, last = edges[:-1], edges[1:] - 1
        self.residuals = np.zeros(len(offsets), np.int8)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(first):
            steps = last - first
            slope = (offsets[last] - offsets[first]) / np.maximum(steps, 1)
            place = ragged(first, steps + 1)
            owner = np.repeat(np.arange(len(first)), steps + 1)
            off = offsets[place] - self._line(offsets[first][owner], slope[owner], place - first[owner])
            heads = np.cumsum(steps + 1) - (steps + 1)
            good = np.maximum.reduceat(np.abs(off), heads) <= BOUND
            self.residuals[place[good[owner]]] = off[good[owner]]
            done.append((first[good], slope[good]))
            first, last = first[~good], last[~good]
            middle = (first + last) // 2
            first, last = np.concatenate([first, middle + 1]), np.concatenate([middle, last])
        self.first = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in done)])
        order = np.argsort(self.first)
        self.first = self.first[order]
        self.slope = np.concatenate([np.zeros(0), *(x for _, x in done)])[order]
        self.base = offsets[self.first]

    @staticmethod
    def _line(base: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return base + np.rint(slope * steps).astype(np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Exact offsets of boundaries: the line's prediction, corrected by the stored residual."""
        segment = np.searchsorted(self.first, places, side="right") - 1
        return self._line(self.base[segment], self.slope[segment], places - self.first[segment]) + self.residuals[places]


def line_boundaries(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, offsets of all boundaries in them (text starts included), and each text's boundary places."""
    _, where, data = texts.buffers()
    stops = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[stops[0]:stops[-1]] if data is not None else np.zeros(0, np.uint8)
    stops = stops - stops[0]
    after = np.flatnonzero(held == ord("\n")) + 1
    filled = stops[1:] > stops[:-1]
    ends = stops[1:][filled]
    units = np.union1d(after, ends)
    counts = np.searchsorted(units, stops[1:], side="right") - np.searchsorted(units, stops[:-1], side="right")
    edges = np.concatenate([[0], np.cumsum(counts + 1)])
    offsets = np.zeros(edges[-1], np.int64)
    heads = np.zeros(edges[-1], bool)
    heads[edges[:-1]] = True
    offsets[heads] = stops[:-1]
    offsets[~heads] = units
    return held, offsets, edges


def _chosen(seed: int, key: str) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and document id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def examples(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """One example per document: (key, n, form, prefix_chars, middle_chars, output)."""
    one, two, three, four = _chosen(seed, key)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), one.alias("h1"), two.alias("h2"),
                       (three % 100 >= cut_percent).alias("whole"), (four % 100 < suffix_first).alias("suffix_first"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = column(piece, "text")
            marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
            held, offsets, edges = line_boundaries(texts)
            index = RankIndex(offsets, edges)
            n = np.diff(edges) - 1
            cuts = np.stack([np.asarray(piece.column(c)) % (n + 1) for c in ("h1", "h2")])
            low, high = index.at(edges[:-1] + cuts.min(axis=0)), index.at(edges[:-1] + cuts.max(axis=0))
            start, stop = offsets[edges[:-1]], offsets[edges[1:] - 1]
            plain = np.asarray(piece.column("whole")) | np.asarray(marked) | (n == 0)
            chars = np.concatenate([[0], np.cumsum(held & 0xC0 != 0x80)])  # a code point starts at every other byte
            order = np.where(plain, "plain", np.where(np.asarray(piece.column("suffix_first")), "spm", "psm"))
            data, out = held.tobytes(), []
            p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
            for form, a, b, c, d in zip(order, start, low, high, stop):
                if form == "plain":
                    out.append(data[a:d])
                elif form == "psm":
                    out.append(b"".join((p, data[a:b], s, data[c:d], m, data[b:c])))
                else:
                    out.append(b"".join((s, data[c:d], p, data[a:b], m, data[b:c])))
            yield pa.RecordBatch.from_arrays([
                piece.column("key"), pa.array(n, pa.int64()), pa.array(order, pa.string()),
                pa.array(chars[low] - chars[start], pa.int64(), mask=plain), pa.array(chars[high] - chars[low], pa.int64(), mask=plain),
                pa.array(out, pa.binary()).cast(pa.string())], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(tasks, schema).withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text an example was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    first, second, middle = (F.try_element_at(part, F.lit(k)) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
