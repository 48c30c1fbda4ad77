"""Name similarity: ratio (X17), exact similarity join (J11), near-typo edges (J12), components."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from kontor import vocab as V
from kontor.functions import text as T
from kontor.operators.common import ROW_NO
from kontor.session import written


#: Names of one block; two blocks are compared at a time.
SHARD_ROWS = 1 << 15
#: Blocks of names that are not many; strips of many names, unless one had more blocks than the last number.
_LEAST_BLOCKS, _STRIPS, _STRIP_BLOCKS = 24, 48, 8
#: Names up to this length lie in tries; no distance between two of them comes near _FAR, and letters added to it stay within a byte.
_WORD, _FAR = 64, 150
#: Pairs of nodes or names compared at a time.
_PAIRS_AT_ONCE = 1 << 15


@pandas_udf(DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """200 * LCS / (|a| + |b|), longest common subsequence by bit-parallel rows."""
    return pd.Series([_score(a, b) for a, b in zip(left, right)], dtype="float64")


def _score(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & places.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _bound(total_length: Column, threshold: int) -> Column:
    """Most insertions and deletions two names of this joint length may differ by."""
    return F.floor(total_length * F.lit(100 - threshold) / F.lit(100)).cast("int")


def _edit_distance_within(a: str, b: str, bound: Column) -> Column:
    """Banded edit distance: stops as soon as the bound is passed, -1 means farther apart."""
    return F.call_function("levenshtein", F.col(a), F.col(b), bound) >= 0


def _reach(total_length: np.ndarray, threshold: int) -> np.ndarray:
    """Most insertions and deletions within the threshold, of the parity of the joint length."""
    bound = total_length * (100 - threshold) // 100
    return bound - (bound + total_length) % 2


class _Trie:
    """Names of one length in the order of their letters, by level: the first name of every node, and where its children begin."""

    def __init__(self, names: list[str], first: int):
        count, self.length, self.first = len(names), len(names[0]), first
        letters = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32).reshape(count, self.length).T
        self.letters = letters.astype(np.min_scalar_type(int(letters.max())), order="C")
        every, fresh = np.arange(count + 1), np.zeros(count, dtype=bool)
        fresh[0] = True
        self.rows, self.children = [np.zeros(1, dtype=np.int64)], []
        for letter in self.letters:
            if len(self.rows[-1]) == count:
                self.children.append(every)
                self.rows.append(every[:count])
                continue
            fresh[1:] |= letter[1:] != letter[:-1]
            number = np.cumsum(fresh)
            self.children.append(np.append(number[self.rows[-1]] - 1, number[-1]))
            self.rows.append(every[:count] if number[-1] == count else np.flatnonzero(fresh))
        self._before: dict[tuple[int, int], np.ndarray] = {}
        self._rest: dict[tuple[int, np.dtype], tuple[np.ndarray, np.ndarray]] = {}

    def before(self, depth: int, back: int) -> np.ndarray:
        """For the nodes of a level, their last letter or the one so many places before it."""
        if (depth, back) not in self._before:
            self._before[depth, back] = self.letters[depth - 1 - back][self.rows[depth]]
        return self._before[depth, back]

    def rest(self, depth: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """For the nodes of a level, whether one name is left, and its letters from there on as one word."""
        if (depth, kind) not in self._rest:
            first = self.rows[depth]
            word = np.zeros((len(first), 8 // kind.itemsize), dtype=kind)
            word[:, :self.length - depth] = self.letters[depth:, first].T
            self._rest[depth, kind] = np.diff(np.append(first, self.letters.shape[1])) == 1, word.view(np.uint64).ravel()
        return self._rest[depth, kind]


class _Block:
    """Names in the order of length and letters, last letter first; a trie for every length up to a word's, the others behind."""

    def __init__(self, rows: pa.StructArray):
        names, count = rows.flatten()
        length, turned = pc.utf8_length(names), pc.utf8_reverse(names)
        order = pc.sort_indices(pa.table([length, turned], names=["length", "turned"]), [("length", "ascending"), ("turned", "ascending")])
        self.names, self.count, self.lengths = names.take(order), *(c.take(order).to_numpy(zero_copy_only=False).astype(np.int64) for c in (count, length))
        lengths, first = np.unique(self.lengths, return_index=True)
        self._beside: tuple = (None, None)
        self.long = int(np.searchsorted(self.lengths, _WORD, side="right"))
        self.tries = [_Trie(turned.take(order[at:end]).to_pylist(), at)
                      for n, at, end in zip(lengths, first.tolist(), [*first[1:].tolist(), len(order)]) if n <= _WORD]

    @functools.cached_property
    def marks(self) -> np.ndarray:
        """How often each of sixteen groups of letters occurs, up to four times, as marks in 64 bits.

        One insertion or deletion changes one mark at most, so the marks two names do not share bound their distance from below.
        """
        points = np.frombuffer("".join(self.names.to_pylist()).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        group = np.repeat(np.arange(len(self.names)) * 16, self.lengths) + points % 16
        often = np.minimum(np.bincount(group, minlength=16 * len(self.names)), 4).reshape(-1, 16).astype(np.uint64)
        return np.bitwise_or.reduce(((np.uint64(1) << often) - np.uint64(1)) << np.arange(0, 64, 4, dtype=np.uint64), axis=1)

    def beside(self, other: _Block) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The names of both blocks, how often they occur, and their ranks among each other."""
        second = None if other is self else other  # a block that holds itself would outlive its task
        if self._beside[0] is not second or self._beside[1] is None:
            names = pa.concat_arrays([b.names for b in (self, second) if b])
            rank = np.empty(len(names), dtype=np.int64)
            rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
            self._beside = second, (names, np.concatenate([b.count for b in (self, second) if b]), rank)
        return self._beside[1]


#: Nodes of two tries, by their numbers on a level each, and the distances of the band around them.
_Nodes = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def _descend(x: _Trie, y: _Trie, same: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, place, ratio) of the similar names of two tries, the names of ``x`` being as long as those of ``y`` or longer.

    Both tries are gone down together, ``x`` as many levels ahead as its names are longer: for two nodes, the distances of
    their letters are known for all starts of either that insertions and deletions within the threshold can pair. What
    names have in common at the beginning is compared once. Two nodes are left where their own distance is too large, and
    are done with as soon as one name is left below each and the letters to come are the same.
    """
    ahead, total, depth = x.length - y.length, x.length + y.length, y.length
    reach = int(_reach(np.int64(total), threshold))
    if reach < ahead:
        return
    kind, few, many = np.promote_types(x.letters.dtype, y.letters.dtype), (reach - ahead) // 2, (reach + ahead) // 2
    roots = len(x.rows[ahead])
    band = [ahead, *[_FAR] * few, *(ahead - d if d <= ahead else _FAR for d in range(1, many + 1))]
    waiting: list[list[_Nodes]] = [[] for _ in range(depth)]
    waiting[0].append((np.arange(roots), np.zeros(roots, dtype=np.int64), [np.full(roots, d, dtype=np.uint8) for d in band]))

    def found(u: np.ndarray, v: np.ndarray, distance: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = x.rows[level + ahead].take(u), y.rows[level].take(v)
        if same:
            keep = np.flatnonzero(left < right)
            left, right, distance = left.take(keep), right.take(keep), distance.take(keep)
        return left + x.first, right + y.first, 200.0 * ((total - distance.astype(np.int64)) // 2) / total

    # A level is gone down from when it fills a step; what is left of the levels above waits meanwhile, so none holds more than two steps.
    opened: list[tuple[int, Iterator[_Nodes]]] = []
    while opened or any(waiting):
        level = opened[-1][0] + 1 if opened else next(k for k in range(depth) if waiting[k])
        if not opened or level < depth and sum(len(u) for u, _, _ in waiting[level]) >= _PAIRS_AT_ONCE:
            us, vs, bands = zip(*waiting[level])
            waiting[level] = []
            opened.append((level, _children(x, y, level, ahead, same, np.concatenate(us), np.concatenate(vs), [np.concatenate(c) for c in zip(*bands)])))
        level, nodes = opened[-1]
        if (step := next(nodes, None)) is None:
            opened.pop()
            continue
        u, v, band = _advanced(x, y, level, ahead, few, many, reach, *step)
        below = level + 1
        if below == depth:
            yield found(u, v, band[0], below)
            continue
        if depth - below <= 8 // kind.itemsize:
            (one_x, rest_x), (one_y, rest_y) = x.rest(below + ahead, kind), y.rest(below, kind)
            done = one_x.take(u) & one_y.take(v) & (rest_x.take(u) == rest_y.take(v))
            if done.any():
                at, stay = np.flatnonzero(done), np.flatnonzero(~done)
                yield found(u.take(at), v.take(at), band[0].take(at), below)
                u, v, band = u.take(stay), v.take(stay), [c.take(stay) for c in band]
        if len(u):
            waiting[below].append((u, v, band))


def _children(x: _Trie, y: _Trie, level: int, ahead: int, same: bool, u: np.ndarray, v: np.ndarray, band: list[np.ndarray]) -> Iterator[_Nodes]:
    """Children of every two nodes, a bounded number at a time, each with the band of its parents."""
    of_x, of_y = x.children[level + ahead], y.children[level]
    first_x, first_y = of_x.take(u), of_y.take(v)
    wide = of_y.take(v + 1) - first_y
    ends = np.cumsum((of_x.take(u + 1) - first_x) * wide)
    for done in range(0, int(ends[-1]), _PAIRS_AT_ONCE):
        until = min(done + _PAIRS_AT_ONCE, int(ends[-1]))
        if int(ends[-1]) == len(u):
            pair, left, right = np.arange(done, until), first_x[done:until], first_y[done:until]
        else:
            one, two = np.searchsorted(ends, [done, until - 1], side="right")
            begins = np.r_[0, ends[:-1]][one:two + 1] if one == 0 else ends[one - 1:two]
            pair = np.repeat(np.arange(one, two + 1), np.diff(np.r_[done, np.minimum(ends[one:two + 1], until)]))
            inside = np.arange(done, until) - begins.take(pair - one)
            step = inside // wide.take(pair)
            left, right = first_x.take(pair) + step, first_y.take(pair) + inside - step * wide.take(pair)
        if same:
            keep = np.flatnonzero(left <= right)
            pair, left, right = pair.take(keep), left.take(keep), right.take(keep)
        yield left, right, [c.take(pair) for c in band]


def _advanced(x: _Trie, y: _Trie, level: int, ahead: int, few: int, many: int, reach: int, u: np.ndarray, v: np.ndarray, band: list[np.ndarray]) -> _Nodes:
    """The nodes that are near enough, with their bands: the distances after one more letter of both names.

    A band has the distance of the two nodes, then those with 1 to ``few`` letters less of ``y``, then with 1 to ``many`` less of ``x``.
    """
    last_x, last_y = x.before(level + ahead + 1, 0).take(u), y.before(level + 1, 0).take(v)
    differ = lambda a, b: np.negative((a != b).view(np.uint8))  # noqa: E731  all bits where they differ
    sides = []
    for old, most, at in ((band[:few + 1], few, level), ([band[0], *band[few + 1:]], many, level + ahead)):
        new: list[np.ndarray] = []
        for d in range(most, 0, -1):
            near = (np.minimum(old[d - 1], new[-1]) if new else old[d - 1]) + np.uint8(1)
            if d <= at:
                other = differ(last_x, y.before(level + 1, d).take(v)) if len(sides) == 0 else differ(x.before(level + ahead + 1, d).take(u), last_y)
                np.minimum(near, old[d] | other, out=near)
            new.append(near)
        sides.append(new[::-1])
    middle = band[0] | differ(last_x, last_y)
    for side in sides:
        if side:
            middle = np.minimum(middle, side[0] + np.uint8(1))
    keep = np.flatnonzero(middle <= reach)
    return u.take(keep), v.take(keep), [c.take(keep) for c in (middle, *sides[0], *sides[1])]


def _beyond(a: _Block, b: _Block, same: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, ratio) of the similar names of which one is longer than a word, one name at a time."""
    for x, y, turned in ((a, b, False), (b, a, True))[:1 if same else 2]:
        for i in range(x.long, len(x.names)):
            until = i if same else y.long if turned else len(y.names)
            reach = _reach(x.lengths[i] + y.lengths[:until], threshold)
            near = np.flatnonzero((np.abs(x.lengths[i] - y.lengths[:until]) <= reach) & (np.bitwise_count(x.marks[i] ^ y.marks[:until]) <= reach))
            name = x.names[i].as_py()
            match = np.array([_score(name, other) for other in y.names.take(pa.array(near)).to_pylist()], dtype=np.float64)
            near, match = near[match >= threshold], match[match >= threshold]
            one = np.full(len(near), i)
            yield (near, one, match) if turned else (one, near, match)


def _similar(a: _Block, b: _Block, same: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in a, place in b, ratio) of the similar names, every two once."""
    for k, x in enumerate(a.tries):
        for y in b.tries[:k + 1] if same else b.tries:
            if x.length >= y.length:
                yield from _descend(x, y, same and x is y, threshold)
            else:
                for right, left, match in _descend(y, x, False, threshold):
                    yield left, right, match
    yield from _beyond(a, b, same, threshold)


def _blocks(names: DataFrame) -> tuple[DataFrame, int]:
    """The names in blocks of at most SHARD_ROWS, near lengths and endings together: (strip, block, shortest, longest, rows).

    Neighbouring blocks form strips; their number comes with the table.
    """
    sized = written(names.filter("name <> ''").select("name", "n", F.length("name").alias("len")), "names")
    count = sized.count()
    ranges = max(1, 4 * count // (3 * SHARD_ROWS), min(_LEAST_BLOCKS, count // 1024))
    wide = min(_STRIP_BLOCKS, -(-ranges // _STRIPS))
    place = F.monotonically_increasing_id()
    part = F.shiftright(place, 33)
    dealt = sized.repartitionByRange(ranges, "len", F.reverse("name")).select(
        "name", "n", "len", F.floor(part / F.lit(wide)).alias("strip"),
        (part * F.lit(1 << 20) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(SHARD_ROWS))).alias("block"))
    return written(dealt.groupBy("strip", "block").agg(
        F.min("len").alias("shortest"), F.max("len").alias("longest"), F.collect_list(F.struct("name", "n")).alias("rows")), "blocks"), -(-ranges // wide)


def _compared(names: DataFrame, threshold: int, schema: str, columns: Callable[..., list]) -> DataFrame:
    """What ``columns`` makes of the similar names of every two blocks: (name, n) holds every name once.

    Two strips of blocks meet in one task unless their lengths keep them apart. A block goes once to every task that needs
    it, at most as often as there are strips; a worker holds the blocks of one strip, another block, and a bounded number
    of pairs, however many names are alike.
    """
    blocks, strips = _blocks(names)
    box = blocks.groupBy("strip").agg(F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    side = lambda s: box.select(*[F.col(c).alias(f"{c}_{s}") for c in box.columns]).coalesce(8)
    bound = _bound(F.col("longest_a") + F.col("longest_b"), threshold)
    meet = side("a").crossJoin(side("b")).filter(
        (F.col("strip_a") <= F.col("strip_b")) & (F.col("shortest_b") - F.col("longest_a") <= bound) & (F.col("shortest_a") - F.col("longest_b") <= bound))
    asked = meet.select("strip_a", "strip_b", F.explode(F.array_distinct(F.array("strip_a", "strip_b"))).alias("strip"))
    task = F.floor(F.col("strip_b") * (F.col("strip_b") + 1) / 2 + F.col("strip_a")).cast("int")
    met = blocks.select("strip", "block", "rows").join(asked, "strip").repartitionById(strips * (strips + 1) // 2, task).sortWithinPartitions(
        "strip_a", "strip_b", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for one, two, strip, rows in zip(*(batch.column(c).to_pylist() for c in ("strip_a", "strip_b", "strip")), batch.column("rows")):
                if at != (one, two):
                    at, held = (one, two), []
                block = _Block(rows.values)
                if strip == one:
                    held.append(block)
                for other in held if strip == two else ():
                    for left, right, match in _similar(other, block, other is block, threshold):
                        if len(left):
                            yield pa.RecordBatch.from_arrays(columns(other, block, left, right, match), names=header)

    header = [field.split()[0] for field in schema.split(", ")]
    return met.select("strip_a", "strip_b", "strip", "rows").mapInArrow(compare, schema)


def _listed(a: _Block, b: _Block, left: np.ndarray, right: np.ndarray, match: np.ndarray) -> list[pa.Array]:
    """Both names, the smaller one first, how often they occur, and the ratio."""
    names, count, rank = a.beside(b)
    right = right if a is b else right + len(a.names)
    turned = rank.take(left) > rank.take(right)
    one, two = np.where(turned, right, left), np.where(turned, left, right)
    n_one, n_two = count.take(one), count.take(two)
    return [names.take(pa.array(one)), names.take(pa.array(two)), pa.array(n_one), pa.array(n_two), pa.array(match), pa.array(n_one * n_two)]


def _summed(a: _Block, b: _Block, left: np.ndarray, right: np.ndarray, match: np.ndarray) -> list[pa.Array]:
    return [pa.array([int(np.sum(a.count[left] * b.count[right]))])]


def _different(counts: DataFrame, threshold: int) -> DataFrame:
    """Pairs of similar names that differ, the smaller one first."""
    return _compared(counts, threshold, "name_a string, name_b string, n_a bigint, n_b bigint, match double, row_pairs bigint", _listed)


def similar_names(names: DataFrame, threshold: int = V.SIMILARITY_THRESHOLD) -> DataFrame:
    """All pairs of distinct names with ratio >= threshold: (name_a, name_b, match).

    ``names`` holds one column ``name`` without repeats. Names are dealt into blocks of near lengths and letters, and the
    names of two blocks are compared by length, by how often letters occur, and by their longest common subsequence.
    """
    return _different(names.select("name", F.lit(1).cast("bigint").alias("n")), threshold).select("name_a", "name_b", "match")


def _name_counts(df: DataFrame) -> DataFrame:
    return written(df.groupBy(T.as_text(F.col(V.NAME)).alias("name")).agg(F.count(F.lit(1)).alias("n")), "name-counts")


def _equal_pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2).cast("bigint")


def similar_pairs(df: DataFrame, threshold: int = V.SIMILARITY_THRESHOLD) -> DataFrame:
    """Similar customer names with their multiplicity.

    One row per pair of distinct names, plus one row per name that occurs more than once; ``row_pairs``
    is the number of row pairs it stands for. Equal names are not expanded into row pairs here, because
    one frequent name alone would give a quadratic result; see ``expand_pairs``.
    """
    counts = _name_counts(df)
    equal = counts.filter("n > 1").select(
        F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.col("n").alias("n_a"),
        F.col("n").alias("n_b"), F.lit(100.0).alias("match"), _equal_pairs(F.col("n")).alias("row_pairs"))
    return _different(counts, threshold).unionByName(equal)


def expand_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Row-level view of similar pairs: (row_no_a, row_no_b, MATCH) with row_no_a < row_no_b.

    Quadratic in equal names by definition; meant for looking at chosen pairs.
    """
    rows = df.select(F.col(ROW_NO), T.as_text(F.col(V.NAME)).alias("name"))
    a = rows.select(F.col(ROW_NO).alias("ra"), F.col("name").alias("name_a"))
    b = rows.select(F.col(ROW_NO).alias("rb"), F.col("name").alias("name_b"))
    joined = pairs.select("name_a", "name_b", "match").join(a, "name_a").join(b, "name_b").filter(
        (F.col("name_a") != F.col("name_b")) | (F.col("ra") < F.col("rb")))
    return joined.select(F.least("ra", "rb").alias("row_no_a"), F.greatest("ra", "rb").alias("row_no_b"),
                         F.col("match").alias("MATCH"))


def duplicate_statistics(df: DataFrame, threshold: int = V.SIMILARITY_THRESHOLD) -> DataFrame:
    """Rows, rows in exact duplicates and rows of the similar-pair listing, two per pair."""
    from kontor.operators.common import one_row

    keys = [c for c in (V.NAME, V.CITY) if c in df.columns]
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    exact = by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("exact_duplicates"))
    counts = _name_counts(df)
    similar = _compared(counts, threshold, "row_pairs bigint", _summed).unionByName(
        counts.select(_equal_pairs(F.col("n")).alias("row_pairs"))).agg(
        (F.coalesce(F.sum("row_pairs"), F.lit(0)) * 2).alias("similar_duplicates"))
    return one_row(exact, similar)


def blocked_similar(rows: DataFrame, threshold: int = V.SIMILARITY_THRESHOLD) -> DataFrame:
    """Edges between near-typos of a name within one city (J12): (row_a, row_b).

    ``rows`` has row_no, n_name and n_city; names do not repeat. Two names meet only when they share the
    space-free form or one of its single-deletion variants, so a meeting point holds few names.
    """
    compact = F.replace("n_name", F.lit(" "), F.lit(""))
    signed = rows.select(ROW_NO, "n_city", "n_name").withColumn(
        "signature", F.explode(T.deletion_signatures(compact)))
    a = signed.select("n_city", "signature", F.col(ROW_NO).alias("row_a"), F.col("n_name").alias("name_a"))
    b = signed.select("n_city", "signature", F.col(ROW_NO).alias("row_b"), F.col("n_name").alias("name_b"))
    bound = _bound(F.length("name_a") + F.length("name_b"), threshold)
    near = a.join(b, ["n_city", "signature"]).filter(
        (F.col("row_a") < F.col("row_b"))
        & (T.digit_runs(F.col("name_a")) == T.digit_runs(F.col("name_b")))
        & (_edit_distance_within("name_a", "name_b", bound)))
    pairs = near.select("row_a", "row_b", "name_a", "name_b").dropDuplicates(["row_a", "row_b"])
    return pairs.filter(ratio("name_a", "name_b") >= threshold).select("row_a", "row_b")


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest member of every vertex's component: (vertex, component).

    Labels spread along edges and through label-of-label jumps; each round is written and read again. The number
    of rounds grows with the logarithm of the longest chain, and only counters reach the driver. A checkpoint would
    hand its estimated size on: joined round after round, that number alone grows until it fills the driver.
    """
    links = written(edges.select(F.col("row_a").alias("v"), F.col("row_b").alias("u")).unionByName(
        edges.select(F.col("row_b").alias("v"), F.col("row_a").alias("u"))), "links")
    labels = written(links.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")), "labels")
    while True:
        heard = links.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy("v").agg(
            F.min("cu").alias("best"))
        spread = labels.join(heard, "v").select(
            "v", F.col("c").alias("before"), F.least("c", "best").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("next"))
        renewed = written(spread.join(jump, "c", "left").select(
            "v", "before", F.least(F.col("c"), F.coalesce("next", "c")).alias("c")), "labels")
        if renewed.filter("c <> before").isEmpty():
            return renewed.select(F.col("v").alias("vertex"), F.col("c").alias("component"))
        labels = renewed.select("v", "c")
