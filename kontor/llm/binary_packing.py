"""Packed id matrices: best-fit-decreasing packing of token sequences, overlong documents split without loss.

Each task packs the documents of its own input split, block by block, so no ids are shuffled and memory is bounded by
a block and the longest single text. A task that is run again reads the same split and gives the same rows. Null texts
count as empty and hold the end id only; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import column, slices
from kontor.llm.tokens import TOKEN_STEP, encoder

BLOCK_TOKENS = 4 << 20
SCHEMA = ("sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<long>, starts array<long>")


class CapacityTree:
    """Segment tree over free capacities 0..top: which is the smallest one that fits a length."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, change: int) -> None:
        node = self.size + capacity
        while node:
            self.open[node] += change
            node >>= 1

    def best(self, length: int) -> int:
        """Smallest capacity >= length that an open bin has, or -1."""
        node = self.size + length
        if self.open[node]:
            return length
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Bins of piece numbers; every length is 1..window."""
    tree, waiting, bins = CapacityTree(window), {}, []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        capacity = tree.best(length)
        if capacity < 0:
            number, capacity = len(bins), window
            bins.append([])
        else:
            number = waiting[capacity].pop()
            tree.add(capacity, -1)
        bins[number].append(piece)
        if capacity > length:
            waiting.setdefault(capacity - length, []).append(number)
            tree.add(capacity - length, 1)
    return bins


def packed_matrices(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, pad_id: int = 0,
                    text: str = "text", key: str = "doc_id", block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed sequence.

    ``ids`` are ``window`` little-endian numbers (two bytes each where the vocabulary allows, else four), padded with
    ``pad_id`` after ``n_tokens``. ``cu_seqlens`` are the cumulative segment lengths from 0 to ``n_tokens``;
    ``position_resets`` the places where position numbers start again at 0; ``doc_ids`` and ``starts`` say which
    document, and which of its ids, a segment begins with.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        kind = np.dtype("<u2") if max(coder.vocabulary, end_id + 1, pad_id + 1) <= 1 << 16 else np.dtype("<u4")
        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # ids, piece lengths, doc ids, starts
        waiting = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting
            ids, lengths, owners, starts = (np.concatenate(x) for x in zip(*held))
            begins = np.cumsum(lengths) - lengths
            bins = best_fit_decreasing(lengths, window)
            held.clear()
            waiting = 0
            for at in range(0, len(bins), 512):
                some = bins[at:at + 512]
                order = np.array([x for b in some for x in b])
                sizes = np.array([len(b) for b in some])
                first = np.cumsum(sizes) - sizes
                matrix = np.full((len(some), window), pad_id, kind)
                cumulative, resets = [], []
                for row, bin_ in enumerate(some):
                    stop = 0
                    cuts = [0]
                    for piece in bin_:
                        n = int(lengths[piece])
                        matrix[row, stop:stop + n] = ids[begins[piece]:begins[piece] + n]
                        stop += n
                        cuts.append(stop)
                    cumulative.extend(cuts)
                    resets.extend(cuts[:-1])
                used = np.add.reduceat(lengths[order], first)
                list_of = lambda flat, lens, t: pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat, t))
                yield pa.RecordBatch.from_arrays([
                    pa.array(base + made + np.arange(len(some))), pa.array(used, pa.int32()),
                    pa.array([x.tobytes() for x in matrix], pa.binary()), list_of(cumulative, sizes + 1, pa.int32()),
                    list_of(resets, sizes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(
                        owners[order, 0], pa.int64(), mask=owners[order, 1] == 1)),
                    list_of(starts[order], sizes, pa.int64())],
                    ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts"])
                made += len(some)

        for batch in slices(batches, step=TOKEN_STEP):
            flat, offsets = coder.ids(column(batch, "text"))
            names = batch.column("doc_id").cast(pa.int64())
            owner = np.stack([np.asarray(names.fill_null(0)), np.asarray(names.is_null()).astype(np.int64)], 1)
            counts = np.diff(offsets) + 1
            ids = np.insert(flat, offsets[1:], end_id).astype(kind)
            pieces = -(-counts // window)
            lengths = np.full(int(pieces.sum()), window, np.int64)
            last = np.cumsum(pieces) - 1
            lengths[last] = counts - (pieces - 1) * window
            starts = (np.arange(len(lengths)) - np.repeat(last - pieces + 1, pieces)) * window
            held.append((ids, lengths, np.repeat(owner, pieces, axis=0), starts))
            waiting += len(ids)
            if waiting >= block:
                yield from emit()
        if held:
            yield from emit()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
