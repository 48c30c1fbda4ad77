"""Byte-level BPE by a rank queue over a hierarchical bitmap: whole texts to token ids and back (operator 12).

A text is cut by the vocabulary's pattern; every piece is encoded alone. A piece that is a token is that token. Any
other piece is a linked list of byte tokens. Each neighbouring pair whose joint bytes are a token waits in the bucket of
that token's rank; bitmaps of 64-bit words, each level telling which words of the level below hold something, give the
next rank by finding the first set bit on every level. The bucket's places are merged from left to right. A place whose
pair has changed since it was put in is stale and skipped. A merge puts at most two new places into buckets, so a piece
of n bytes takes O(n) queue steps, and a piece of many megabytes costs no more for each byte than a short one.

Each worker remembers the ids of about ``MEMORY`` pieces; those it has not met share one list, with gaps between them.

Defined results: a null text counts as empty and gives no ids; repeated rows and null ids of documents stay rows of
their own; ties between equal ranks go to the leftmost place; strings of special tokens are ordinary text; an empty
table gives an empty table; all columns of the input other than the text stay as they are, unless they bear the names
``ids`` or ``n_tokens`` of the result, which then replace them.
"""

from __future__ import annotations

import base64
import functools
import itertools
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kontor.llm.common import column, ragged, slices

MEMORY = 400_000
#: Pieces looked up at once; those not met before share one list and one queue.
BLOCK = 500_000
#: Buckets with fewer places are merged place by place.
FEW = 12


class RankQueue:
    """Buckets of places by rank; the least rank in use is found by first set bits, level by level."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, array] = {}
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * max(ranks, 1))

    def bucket(self, rank: int) -> array:
        """The bucket of a rank, opened and marked on every level if need be."""
        found = self.buckets.get(rank)
        if found is not None:
            return found
        self.buckets[rank] = found = array("i")
        for words in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            empty = not words[word]
            words[word] |= bit
            if not empty:
                break
            rank = word
        return found

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Put places into the buckets of their ranks."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order].astype(np.int32)
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, start, stop in zip(ranks[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(ranks)]):
            self.bucket(rank).frombytes(places[start:stop].tobytes())

    def least(self) -> int:
        """The least rank with a bucket, -1 if there is none."""
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            if not word:
                return -1
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank

    def take(self, rank: int) -> array:
        """Remove the bucket of a rank and give its places."""
        taken = self.buckets.pop(rank)
        for words in self.levels:
            word = rank >> 6
            words[word] &= ~(1 << (rank & 63))
            if words[word]:
                break
            rank = word
        return taken


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def _newer_characters(pattern: str) -> dict[str, list[str]]:
    """Letters and numbers of the pattern library's Unicode version that the encoding library's version lacks.

    Only characters unassigned in an older, third version can differ; the encoding library is asked for each of them by
    a small vocabulary that joins it to a letter or a digit.
    """
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    found = {}
    for name, head in (("L", b"a"), ("N", b"1")):
        ranks = {bytes([b]): b for b in range(256)} | {head + bytes([b]): 256 + b for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        recent = (c for c in regex.findall(rf"\p{{{name}}}", every) if unicodedata.category(c) == "Cn")
        found[name] = [c for c in recent if probe.encode_ordinary(head.decode() + c)[0] < 256]
    return found


def _ranges(chars: list[str], form: str) -> str:
    """Characters as the ranges of a pattern's class."""
    codes = np.array([ord(c) for c in chars], np.int64)
    heads = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    lasts = np.append(heads[1:], len(codes)) - 1
    return "".join(f"{form.format(a)}-{form.format(b)}" for a, b in zip(codes[heads], codes[lasts]))


class Splitter:
    """Cuts texts into the pieces of a pattern as the encoding library would."""

    def __init__(self, pattern: str):
        self.usual = self.careful = regex.compile(pattern)
        newer = {name: chars for name, chars in _newer_characters(pattern).items() if chars}
        self.newer = "[" + "".join(_ranges(chars, r"\x{{{:x}}}") for chars in newer.values()) + "]" if newer else None
        for name, chars in newer.items():
            pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{_ranges(chars, chr(92) + 'U{:08x}')}]]")
        self.careful = regex.compile(pattern, regex.V1)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
        """The number of a text and its next pieces, in order."""
        careful = pc.match_substring_regex(texts, self.newer).to_pylist() if self.newer else [False] * len(texts)
        for number, (text, special) in enumerate(zip(texts, careful)):
            text = text.as_py()
            cut = self.careful if special else self.usual
            if len(text) <= BLOCK:
                yield number, cut.findall(text)
            else:
                pieces = (match.group() for match in cut.finditer(text))
                while block := list(itertools.islice(pieces, BLOCK)):
                    yield number, block


class RankVocabulary:
    """Tokens by rank, the ranks of joined pairs, and the pieces this worker has met."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        size = max(self.ranks.values()) + 1
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        #: ranks of tokens that join with a neighbour to a token of lower rank: those merge one by one
        self.delicate: set[int] = set()
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
                    self.delicate.update(x for x in (left, right) if x > rank)
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[x] for x in self.pair_keys.tolist()], np.int32)
        self.queue = RankQueue(size)
        self.splitter = Splitter(pattern)
        self.lengths = np.zeros(size, np.int64)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.forget()

    def _joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring tokens' joint bytes, -1 where they are no token."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has: one list with gaps between the pieces, one queue.

        Least rank first, equal ranks from the left. A large bucket is merged at once: its places touch only where
        equal pairs overlap, and of those every second one is taken.
        """
        n, queue = sum(map(len, pieces)), self.queue
        edges = np.cumsum([0, *map(len, pieces)])
        rows = [array("i", bytes(4 * (n + 1))) for _ in range(4)]
        ids_of, after_of, before_of, joint_of = rows
        ids, after, before, joint = (np.frombuffer(x, np.int32) for x in rows)  # place n stands for "none"
        ids[:n] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ids[n] = -1
        after[:n], before[:n] = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[edges[1:] - 1], before[edges[:-1]] = n, n
        joint[n] = -1
        joint[:n] = self._joint(ids[:n], ids[after[:n]])
        waiting = np.flatnonzero(joint[:n] >= 0)
        queue.push(joint[waiting], waiting)
        while (rank := queue.least()) >= 0:
            bucket = queue.take(rank)
            if len(bucket) < FEW or rank in self.delicate:
                self._one_by_one(rank, bucket, *rows)
                continue
            places = np.sort(np.frombuffer(bucket, np.int32))
            places = places[(joint[places] == rank) & (np.diff(places, prepend=-1) > 0)]  # the others are stale
            if not len(places):
                continue
            number = np.arange(len(places))
            free = np.concatenate([[True], after[places[:-1]] != places[1:]])
            places = places[(number - np.maximum.accumulate(np.where(free, number, 0))) % 2 == 0]
            gone = after[places]
            ends = after[gone]
            ids[places], ids[gone], joint[gone] = rank, -1, -1
            after[places], before[ends] = ends, places
            left = before[places]
            touched = np.concatenate([places, left[left < n]])
            ranks = self._joint(ids[touched], ids[after[touched]])
            joint[touched] = ranks
            open_pairs = ranks >= 0
            queue.push(ranks[open_pairs], touched[open_pairs])
        live = ids[:n] >= 0
        return ids[:n][live].astype(np.uint32), np.diff(np.concatenate([[0], np.cumsum(live)])[edges])

    def _one_by_one(self, rank: int, bucket: array, ids: array, after: array, before: array, joint: array) -> None:
        """Merge a bucket from the left; when a smaller rank comes up, the rest of the bucket waits."""
        n, queue, pairs = len(ids) - 1, self.queue, self.pairs
        places = iter(sorted(bucket))
        for at in places:
            if joint[at] != rank:
                continue  # stale
            gone = after[at]
            end = after[gone]
            ids[at], after[at], ids[gone], joint[gone], lower = rank, end, -1, -1, False
            joined = -1
            if end < n:
                before[end] = at
                joined = pairs.get(rank << 32 | ids[end], -1)
                if joined >= 0:
                    queue.bucket(joined).append(at)
                    lower = joined < rank
            joint[at] = joined
            left = before[at]
            if left < n:
                joined = pairs.get(ids[left] << 32 | rank, -1)
                joint[left] = joined
                if joined >= 0:
                    queue.bucket(joined).append(left)
                    lower = lower or joined < rank
            if lower:
                if rest := list(places):
                    queue.bucket(rank).extend(rest)
                return

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.edges = np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        coded = [piece.encode() for piece in pieces]
        whole = [self.ranks.get(x, -1) for x in coded]
        ids, sizes = self.merged([x for x, rank in zip(coded, whole) if rank < 0])
        tokens = np.array(whole, np.int64)
        lengths = np.ones(len(pieces), np.int64)
        lengths[tokens < 0] = sizes
        ends = np.cumsum(lengths)
        more = np.zeros(ends[-1], np.uint32)
        more[ends[tokens >= 0] - 1] = tokens[tokens >= 0]
        more[np.repeat(tokens < 0, lengths)] = ids
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.pool = np.concatenate([self.pool, more])
        self.edges = np.concatenate([self.edges, self.edges[-1] + ends])

    def _look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        distinct = dict.fromkeys(pieces)
        new = [x for x in distinct if x not in self.known]
        if new and (len(self.known) > MEMORY or len(self.pool) > 8 * MEMORY):
            self.forget()
            new = list(distinct)
        if new:
            self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        starts, sizes = self.edges[places], self.edges[places + 1] - self.edges[places]
        return self.pool[ragged(starts, sizes)], sizes

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's offsets."""
        counts = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        owners: list[tuple[int, int]] = []
        flat: list[np.ndarray] = []

        def look_up() -> None:
            ids, sizes = self._look_up(waiting)
            flat.append(ids)
            ends = np.cumsum([held for _, held in owners])
            before = np.concatenate([[0], np.cumsum(sizes)])
            np.add.at(counts, [number for number, _ in owners], np.diff(before[ends], prepend=0))
            waiting.clear()
            owners.clear()

        for number, pieces in self.splitter.blocks(texts):
            waiting.extend(pieces)
            owners.append((number, len(pieces)))
            if len(waiting) >= BLOCK:
                look_up()
        if owners:
            look_up()
        return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([[0], np.cumsum(counts)])

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> RankVocabulary:
    """One vocabulary per worker process."""
    return RankVocabulary(path, pattern)


def encoded(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns of ``docs`` without the text, with ``ids`` (unsigned 32-bit numbers, little endian) and ``n_tokens``."""
    kept = docs.drop("ids", "n_tokens") if text not in ("ids", "n_tokens") else docs
    rest = [c for c in kept.columns if c != text]
    schema = StructType([*(kept.schema[c] for c in rest), StructField("ids", BinaryType()), StructField("n_tokens", LongType())])

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path, pattern)
        for piece in slices(batches, text):
            ids, edges = coder.encoded(column(piece, text))
            binary = pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(4 * edges), pa.py_buffer(ids.astype("<u4"))])
            counts = pa.array(np.diff(edges), pa.int64())
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), binary.cast(pa.binary()), counts], [*rest, "ids", "n_tokens"])

    return kept.mapInArrow(tasks, schema)


def decoded(tokens: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``tokens`` with ``bytes``: the joined bytes of the tokens in ``ids`` (null ids: no bytes)."""
    kept = tokens.drop("bytes")
    schema = StructType([*kept.schema.fields, StructField("bytes", BinaryType())])

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path, pattern)
        for piece in slices(batches, "ids"):
            texts = [coder.decoded(np.frombuffer(x.as_py() or b"", "<u4")).tobytes() for x in piece.column("ids")]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.binary())], [*piece.schema.names, "bytes"])

    return kept.mapInArrow(tasks, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Token counts and digests of ids and of decoded bytes of every document."""
    done = decoded(encoded(docs.select("doc_id", text), path, text), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
