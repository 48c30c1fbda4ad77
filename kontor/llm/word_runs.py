"""Periodic runs of words, found on a Re-Pair grammar of each text (operator 11).

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol, again and again, until no pair of a
text occurs twice. Here this goes in rounds over all texts of a batch: pairs are counted per text, places are given to
the more frequent of overlapping pairs, and only the surroundings of new symbols are counted again. What is left of a
text, its start rule, is paired up evenly until one symbol remains.

A run lies across the boundary between the two halves of the smallest symbol of the derivation that holds it whole. So
every symbol is looked at once, at its first place: periods that agree with the words next to the boundary are extended
to both sides inside the symbol by comparing prefix hashes. What was found is copied to all places of the symbol, and
intervals of one period that share a period's length are merged to maximal ones. The merged runs are compared word by
word at the end, so a hash collision cannot pass.

A run is a stretch of consecutive words with least period q and at least ``max(LEAST_LENGTH, LEAST_EXPONENT * q)``
words that no neighbouring word extends.

Defined results: a null text has no words; texts with fewer than ``LEAST_LENGTH`` words have no runs; equal rows give
equal results; runs with one start are ordered by period; an empty table gives an empty one; texts are read whole, one
text at a time when it is long. The result has its own columns only, so no column of the table can clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import column, ragged, slices, words_of

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Periods tried at once.
STEP_PERIODS = 1 << 21
#: Moduli and bases of the prefix hashes; the second pair of bases is used if the word-by-word check fails.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = ((1_103_515_245, 1_220_703_125), (1_664_525_013, 1_597_334_677))


class Nodes(NamedTuple):
    """Symbols of the derivation by one of their places: words ``start`` to ``end``, halves meeting at ``middle``."""

    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray


class Grammar(NamedTuple):
    rules: Nodes  # every new symbol at its first place
    places: np.ndarray  # start of every place of every new symbol, symbol after symbol
    counts: np.ndarray  # places of each new symbol
    top: Nodes  # the symbols above the start rules, one place each


def _alternating(places: np.ndarray, after: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Marks every second place of chains of overlapping equal pairs (aaaa)."""
    number = np.arange(len(places))
    linked = np.concatenate([[False], same & (after[places[:-1]] == places[1:])]) if len(places) else np.zeros(0, bool)
    return (number - np.maximum.accumulate(np.where(linked, 0, number))) % 2 == 0


def re_pair(words: np.ndarray, edges: np.ndarray) -> Grammar:
    """Grammars of all texts; ``words`` are word numbers, text t has words ``edges[t]`` to ``edges[t + 1]``."""
    n = len(words)
    symbol = np.concatenate([words, [-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    before[0] = n
    filled = edges[1:] > edges[:-1]
    after[edges[1:][filled] - 1], before[edges[:-1][filled]] = n, n  # n stands for "none"
    size = np.ones(n + 1, np.int64)
    score = np.full(n + 1, -1, np.int64)
    most = int(symbol.max(initial=0)) + 1 + n
    fresh = most - n
    live = np.ones(n, bool)
    starts, halves, ends, places, counts = ([np.zeros(0, np.int64)] for _ in range(5))
    open_places = np.flatnonzero(after[:n] < n)
    while len(open_places):
        key = (owner[open_places] * most + symbol[open_places]) * most + symbol[after[open_places]]
        order = np.argsort(key, kind="stable")
        key, open_places = key[order], open_places[order]
        taken = _alternating(open_places, after, key[1:] == key[:-1])
        key, open_places = key[taken], open_places[taken]
        group = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        uses = np.bincount(group)[group] if len(group) else group
        repeated = uses > 1
        open_places, group, uses = open_places[repeated], group[repeated], uses[repeated]
        if not len(open_places):
            break
        # more frequent pairs first; the order among equals is scattered, so that winners are found in few steps
        score[open_places] = uses << 32 | group * 2_654_435_761 & 0xFFFFFFFF
        waiting, chosen = open_places, np.zeros(n + 1, bool)
        while len(waiting):
            mine = score[waiting]
            won = waiting[(mine > score[before[waiting]]) & (mine > score[after[waiting]])]
            chosen[won] = True
            score[won] = score[before[won]] = score[after[won]] = -1
            waiting = waiting[score[waiting] >= 0]
        picked = chosen[open_places]
        at, group = open_places[picked], group[picked]
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        each = np.diff(np.append(heads, len(at)))
        gone = after[at]
        tail = after[gone]
        first = at[heads]
        starts.append(first)
        halves.append(first + size[first])
        size[at] += size[gone]
        ends.append(first + size[first])
        places.append(at)
        counts.append(each)
        symbol[at] = np.repeat(np.arange(fresh, fresh + len(heads)), each)
        fresh += len(heads)
        live[gone] = False
        after[at], before[tail] = tail, at
        around = np.unique(np.concatenate([at, before[at]]))
        open_places = around[around < n]
        open_places = open_places[after[open_places] < n]
    rules = Nodes(np.concatenate(starts), np.concatenate(halves), np.concatenate(ends))
    rest = np.flatnonzero(live)
    return Grammar(rules, np.concatenate(places), np.concatenate(counts), _paired_up(rest, rest + size[rest], owner[rest]))


def _paired_up(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> Nodes:
    """Inner nodes of an even binary tree over each text's remaining symbols."""
    levels = [Nodes(*(np.zeros(0, np.int64) for _ in range(3)))]
    while True:
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        number = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner))))
        left = np.flatnonzero(number % 2 == 0)
        partner = np.minimum(left + 1, len(owner) - 1)
        paired = (partner > left) & (owner[partner] == owner[left])
        if not paired.any():
            return Nodes(*map(np.concatenate, zip(*levels)))
        levels.append(Nodes(start[left[paired]], start[partner[paired]], end[partner[paired]]))
        start, end, owner = start[left], np.where(paired, end[partner], end[left]), owner[left]


class PrefixHashes:
    """Sums of words times powers of a base, for two moduli; stretches are compared by their hashes."""

    def __init__(self, words: np.ndarray, bases: tuple[int, int]):
        self.tables = []
        for modulus, base in zip(MODULI, bases):
            power = np.ones(len(words) + 1, np.int64)
            done, step = 1, base
            while done < len(power):  # powers by doubling
                more = min(done, len(power) - done)
                power[done:done + more] = power[:more] * step % modulus
                step, done = step * step % modulus, done + more
            sums = np.concatenate([[0], np.cumsum((words + 1) * power[:-1] % modulus)]) % modulus
            self.tables.append((modulus, power, sums))

    def equal(self, one: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``one`` equal the words from ``one + apart``."""
        result = np.ones(len(one), bool)
        for modulus, power, sums in self.tables:
            near = (sums[one + length] - sums[one]) % modulus * power[apart] % modulus
            result &= near == (sums[one + apart + length] - sums[one + apart]) % modulus
        return result

    def agreement(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, ahead: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``apart`` further on, at most ``most``."""
        found = np.zeros(len(at), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            tried = np.flatnonzero(found + step <= most)
            begin = at[tried] + found[tried] if ahead else at[tried] - found[tried] - step
            tried = tried[self.equal(begin, apart[tried], np.full(len(tried), step))]
            found[tried] += step
            step >>= 1
        return found


def _crossing(words: np.ndarray, hashes: PrefixHashes, nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs inside nodes that cross their middles: (node, start, end, period), least periods only."""
    found = [np.zeros((4, 0), np.int64)]
    for side in (-1, 1):  # two periods of a run lie before the middle, or behind it
        room = (nodes.middle - nodes.start if side < 0 else nodes.end - nodes.middle) // 2
        periods = np.minimum(room, (nodes.end - nodes.start) // LEAST_EXPONENT)
        periods[nodes.end - nodes.start < LEAST_LENGTH] = 0
        chunk = np.cumsum(periods) // STEP_PERIODS
        for part in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(chunk)) + 1) if len(periods) else []:
            part = part[periods[part] > 0]
            node = np.repeat(part, periods[part])
            period = ragged(np.ones(len(part), np.int64), periods[part])
            for near in (-1, 0):  # the words next to the middle recur a period away
                at = nodes.middle[node] + near
                same = words[at] == words[at + side * period]
                node, period = node[same], period[same]
            middle = nodes.middle[node]
            at = middle - period if side < 0 else middle
            ahead = hashes.agreement(at, period, nodes.end[node] - period - at, True)
            behind = hashes.agreement(at, period, at - nodes.start[node], False)
            length = ahead + behind + period
            good = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
            found.append(np.stack([node, at - behind, at + ahead + period, period])[:, good])
    node, start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start, node))
    node, start, end, period = (x[order] for x in (node, start, end, period))
    new = (np.diff(node, prepend=-1) != 0) | (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)
    return node[new], start[new], end[new], period[new]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals: those of one period that share at least a period's length are one."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    shift = (np.cumsum(np.diff(period, prepend=period[0]) != 0)) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], reach[:-1] - (start + shift)[1:] < period[1:]])
    heads = np.flatnonzero(new)
    return start[heads], np.maximum.reduceat(end, heads), period[heads]


def periodic_runs(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of all texts as (start, end, period) by start, then period; starts count over all words."""
    grammar = re_pair(words, edges)
    first_place = np.cumsum(grammar.counts) - grammar.counts
    for bases in BASES:
        hashes = PrefixHashes(words, bases)
        rule, start, end, period = _crossing(words, hashes, grammar.rules)
        copies = grammar.counts[rule]
        moved = grammar.places[ragged(first_place[rule], copies)] - np.repeat(grammar.rules.start[rule], copies)
        _, top_start, top_end, top_period = _crossing(words, hashes, grammar.top)
        start, end, period = _merged(
            np.concatenate([np.repeat(start, copies) + moved, top_start]), np.concatenate([np.repeat(end, copies) + moved, top_end]),
            np.concatenate([np.repeat(period, copies), top_period]))
        if _holds(words, start, end, period):
            order = np.lexsort((period, start))
            return start[order], end[order], period[order]
    raise ArithmeticError("prefix hashes collided for every pair of bases")


def _holds(words: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Compares the runs word by word, a bounded number of words at once."""
    lengths = end - start - period
    chunk = np.cumsum(lengths) // STEP_PERIODS
    for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(chunk)) + 1) if len(start) else []:
        at = ragged(start[part], lengths[part])
        if (words[at] != words[at + np.repeat(period[part], lengths[part])]).any():
            return False
    return True


def word_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed): runs by start, then period, and the words left when repeats of periods go.

    ``runs`` holds start (word number), length and period. ``collapsed`` is the text without the words that lie in a run
    behind its first period, its words joined by one space.
    """
    schema = (f"key {docs.schema[key].dataType.simpleString()}, n_words long, "
              "runs array<struct<start: long, length: long, period: long>>, collapsed string")

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            flat, edges = words_of(column(piece, "text"))
            numbers = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
            counts = np.diff(edges)
            long_enough = np.repeat(counts >= LEAST_LENGTH, counts)
            where = np.flatnonzero(long_enough)
            start, end, period = periodic_runs(numbers[where], np.concatenate([[0], np.cumsum(counts[counts >= LEAST_LENGTH])]))
            if len(start):
                start, end = where[start], where[end - 1] + 1
            owner = np.searchsorted(edges, start, side="right") - 1
            depth = np.zeros(len(flat) + 1, np.int64)
            np.add.at(depth, start + period, 1)
            np.add.at(depth, end, -1)
            kept = np.cumsum(depth[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[edges]
            words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)).cast(pa.string()))
            runs = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start - edges[owner], end - start, period)], ["start", "length", "period"])
            held = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=piece.num_rows))])
            yield pa.RecordBatch.from_arrays([
                piece.column("key"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(held, pa.int32()), runs),
                pc.binary_join(words, " ")], ["key", "n_words", "runs", "collapsed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tasks, schema).withColumnRenamed("key", key)
