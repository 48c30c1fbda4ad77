"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of tokens, cut into quanta. In every round a source earns credit in proportion to its target
share and is served one quantum whenever its credit reaches one. Quantum ``i`` of a source with share ``p`` is thus
served at moment ``(i - 1/2) / p``; how many quanta of any other source come before that moment is a formula, so the
place of a quantum in the training stream is known wherever its document lies, and deficits carry over windows and
partitions without a sequential pass. A source that runs out leaves its share to the others. The stream is cut into
windows without gaps; what is left after the last full window is cut into powers of two, so nothing is padded.

Null texts count as empty and hold the end id only. Null sources are a source of their own. Repeated rows are packed
as often as they occur. An empty table gives an empty result. Only named columns are read, so others cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor.llm.common import column, ragged, slices, stored
from kontor.llm.tokens import TOKEN_STEP, encoder

PIECES = ("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")
#: A mixture has few sources; the schedule needs their totals in every task.
MAX_SOURCES = 10_000


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id",
              source: str = "source") -> DataFrame:
    """(doc_id, source, doc_tokens, ids, part, before): ids with the end id, and the tokens of the same source before
    the document in its part. Must be stored before use, so that parts keep their rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, seen = encoder(tokenizer), {}
        part = TaskContext.get().partitionId()
        for batch in slices(batches, step=TOKEN_STEP):
            flat, offsets = coder.ids(column(batch, "text"))
            ids = np.insert(flat, offsets[1:], end_id).astype("<u4")
            ends = (offsets + np.arange(len(offsets)))[1:]
            counts = np.diff(offsets) + 1
            before = []
            for name, n in zip(batch.column("source").to_pylist(), counts.tolist()):
                before.append(seen.get(name, 0))
                seen[name] = before[-1] + n
            narrow = ids.astype("<u2") if coder.vocabulary <= 1 << 16 and end_id < 1 << 16 else ids
            width, data = narrow.itemsize, narrow.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("source"), pa.array(counts),
                pa.array([data[(e - n) * width:e * width] for e, n in zip(ends.tolist(), counts.tolist())], pa.binary()),
                pa.array([part] * len(counts), pa.int64()), pa.array(before, pa.int64())],
                ["doc_id", "source", "doc_tokens", "ids", "part", "before"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, source string, doc_tokens long, ids binary, part long, before long")


class Schedule:
    """When each quantum is served. ``totals``: tokens of each source; ``shares``: positive target weights."""

    def __init__(self, totals: list[int], shares: list[float], window: int, quantum: int):
        self.window, self.quantum = window, quantum
        self.quanta = -(-np.array(totals, np.int64) // quantum)
        self.shares = np.array(shares, np.float64)
        last = [int(self.rank(np.array([k]), np.array([n]))[0]) for k, n in enumerate(self.quanta)]
        short = self.quanta * quantum - np.array(totals, np.int64)
        order = np.argsort(last)
        self.short_at = np.array(last, np.int64)[order]
        self.short_by = np.concatenate([[0], np.cumsum(short[order])])
        total = int(sum(totals))
        full = total // window
        ends, at = [], full * window
        for bit in reversed(range(window.bit_length())):
            if (total - full * window) >> bit & 1:
                at += 1 << bit
                ends.append(at)
        self.full, self.tail = full, np.array(ends, np.int64)

    def moment(self, source: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (number - 0.5) / self.shares[source]

    def rank(self, source: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Quanta served before quantum ``number`` (from 1) of ``source``; ties go by source."""
        at = self.moment(source, number)
        before = number - 1
        for other in range(len(self.shares)):
            n, share = self.quanta[other], self.shares[other]
            if not n:
                continue
            count = np.clip(np.floor(at * share + 0.5), 0, n).astype(np.int64)
            for _ in range(2):  # rounding may be one off on either side
                mine = (count - 0.5) / share
                count -= (count > 0) & ((mine > at) | ((mine == at) & (other >= source)))
            for _ in range(2):
                mine = (count + 0.5) / share
                count += (count < n) & ((mine < at) | ((mine == at) & (other < source)))
            before = before + np.where(other == source, 0, count)
        return before

    def place(self, source: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Stream position of a quantum's first token: last quanta that are not full leave no gap."""
        rank = self.rank(source, number)
        return rank * self.quantum - self.short_by[np.searchsorted(self.short_at, rank, side="left")]

    def cut(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence of a stream position, its offset there, and the position where the sequence ends."""
        number = position // self.window
        begin, end = number * self.window, (number + 1) * self.window
        late = number >= self.full
        if late.any():
            at = np.searchsorted(self.tail, position[late], side="right")
            edges = np.concatenate([[self.full * self.window], self.tail])
            number[late], begin[late], end[late] = self.full + at, edges[at], edges[at + 1]
        return number, position - begin, end


def document_pieces(schedule: Schedule, source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (row, start, length, sequence, offset) of documents that lie at ``begin`` in their source's queue."""
    q = schedule.quantum
    first, last = begin // q, (begin + size - 1) // q
    many = last - first + 1
    row = np.repeat(np.arange(len(begin)), many)
    number = ragged(first, many)
    low = np.maximum(number * q, begin[row])
    high = np.minimum((number + 1) * q, (begin + size)[row])
    at = schedule.place(source[row], number + 1) + low - number * q
    # quanta of one document that follow each other in the stream become one run again
    join = np.zeros(len(row), bool)
    join[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + (high - low)[:-1])
    head = np.flatnonzero(~join)
    row, start, at = row[head], (low - begin[row])[head], at[head]
    length = np.add.reduceat(high - low, head)
    done = []
    while len(row):
        sequence, offset, end = schedule.cut(at)
        here = np.minimum(length, end - at)
        done.append((row, start, here, sequence, offset))
        rest = length > here
        row, start, at, length = row[rest], (start + here)[rest], (at + here)[rest], (length - here)[rest]
    return tuple(np.concatenate(x) for x in zip(*done))


def mixture_packed(docs: DataFrame, tokenizer: str, weights: Mapping[str | None, float] | None = None, window: int = 4096,
                   quantum: int = 256, end_id: int = 2, text: str = "text", key: str = "doc_id",
                   source: str = "source") -> DataFrame:
    """One row per piece of a document: its place in the packed sequences (see ``PIECES``).

    ``weights`` are target token proportions of the sources; without them, the corpus's own, so that every window has
    the mixture of the whole. A source without a weight gets the smallest one given. ``window`` must be a power of two.
    """
    if window & (window - 1) or quantum > window:
        raise ValueError("window must be a power of two, quantum at most a window")
    table = stored(tokenized(docs, tokenizer, end_id, text, key, source), "token-ids")
    parts = table.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n"))
    order = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(parts.select("source", "part", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier")), "offsets")
    sums = offsets.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"More than {MAX_SOURCES} sources: mix over a coarser column.")
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    names, totals = [r.source for r in sums], [r.n for r in sums]
    if weights is None:
        shares = [float(n) for n in totals]
    else:
        least = min(weights.values())
        shares = [float(weights.get(name, least)) for name in names]
    schedule = Schedule(totals, [s / sum(shares) for s in shares], window, quantum)
    codes = {name: k for k, name in enumerate(names)}
    bits = "<u2" if encoder(tokenizer).vocabulary <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            take = lambda name: np.asarray(batch.column(name), dtype=np.int64)
            code = np.array([codes[x] for x in batch.column("source").to_pylist()], np.int64)
            row, start, length, sequence, offset = document_pieces(
                schedule, code, take("before") + take("earlier"), take("doc_tokens"))
            ids = [np.frombuffer(x, bits).astype("<u4") for x in batch.column("ids").to_pylist()]
            crc = [zlib.crc32(ids[r][s:s + n]) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist())]
            of_row = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(of_row), batch.column("source").take(of_row), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64()), batch.column("doc_tokens").take(of_row), pa.array(sequence), pa.array(offset)],
                ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = table.join(offsets.select(F.col("source").alias("__source"), F.col("part").alias("__part"), "earlier"),
                        F.col("source").eqNullSafe(F.col("__source")) & (F.col("part") == F.col("__part")))
    return placed.select("doc_id", "source", "doc_tokens", "ids", "before", "earlier").mapInArrow(run, PIECES)
