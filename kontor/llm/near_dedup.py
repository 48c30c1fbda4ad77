"""Near duplicates by a chosen-path set similarity join (CPSJoin; Christiani, Pagh and Sivertsen).

A document is the set of its word shingles. Equal sets are one class. Classes hold minwise tokens (one per hash
function); in each of ``TREES`` independent trees a node passes its members on to children by one chosen token, so two
sets of similarity s stay together with probability s per level. Nodes of at most ``SMALL`` members are compared
exhaustively; larger ones branch again, on a token that depends on the path. At similarity 0.8, sixteen trees miss a
pair that parts ways at depth 1, 2, 3 or 4 with probability 7e-12, 8e-8, 2e-5 and 2e-4.

What stays together to the last level is a family of near copies. Its centre, the member closest to the typical token
values, is compared with all others. For members ``a`` that are not connected to the centre ``c`` then, the whole
family is searched exactly: ``a`` and ``b`` are similar only if their differences from ``c`` overlap, because
``|a ^ b| = |a ^ c| + |b ^ c| - 2 |(a ^ c) & (b ^ c)|``. So the rarest elements of these differences are joined (a
prefix filter), and no cap loses a link.

Small nodes compare all pairs but those of one family, which the family's own search covers. A comparison asks for agreement of tokens (five standard deviations below the expected one) and for
the sizes, and is decided by the full shingle sets of the texts.

Null and empty texts, and texts without a word, have an empty set and are linked with nothing. With fewer words than a
shingle, the whole sequence is the one shingle. Rows with one id are one vertex; a null id stands for its class. An
empty table gives an empty result. Only named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor.llm.common import attach, column, ragged, slices, stored

TOKENS, TREES, LEVELS, SMALL = 64, 16, 4, 16
#: Token places that say what is typical of a large node.
TYPICAL = 16

_MASKS = np.array([int.from_bytes(hashlib.sha256(b"mask%d" % k).digest()[:8], "little") for k in range(TOKENS)], np.uint64)
_FACTORS = np.array([int.from_bytes(hashlib.sha256(b"factor%d" % k).digest()[:8], "little") | 1 for k in range(TOKENS)], np.uint64)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(1 << 16, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Factors of a byte by its place in the word, low and high 16 bits of the place apart.
_PLACE, _FAR_PLACE = _powers(0x9E3779B97F4A7C15), _powers(0xC2B2AE3D27D4EB4F)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the offsets of each text's words."""
    _, where, data = texts.buffers()
    edges = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    if not len(held):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    solid = ~_BLANK[held]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    first = edges[:-1][edges[:-1] < len(held)]
    head[first] = solid[first]
    starts = np.flatnonzero(head)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    terms = np.where(solid, _LOW[held], 0).astype(np.uint64)
    terms[solid] += np.uint64(1)
    spans = np.diff(np.append(starts, len(held)))
    place = np.arange(len(held)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, spans)])
    terms *= _PLACE[place & 0xFFFF]
    if len(held) > 1 << 16:
        terms *= _FAR_PLACE[(place >> 16) & 0xFFFF]
    sums = np.add.reduceat(terms, starts)
    sizes = np.add.reduceat(solid, starts, dtype=np.int64).astype(np.uint64)
    return _mix(sums + sizes * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, edges)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats), and the offsets of each text's shingles."""
    words, offsets = word_hashes(texts)
    lengths = np.diff(offsets)
    count = np.where(lengths > 0, np.maximum(lengths - width + 1, 1), 0)
    starts, room = ragged(offsets[:-1], count), np.repeat(np.minimum(lengths, width), count)
    out = np.repeat(np.minimum(lengths, width), count).astype(np.uint64)
    for k in range(width):
        inside = room > k
        if inside.all():
            out = _mix(out * np.uint64(0xA0761D6478BD642F) + words[starts + k])
        else:
            out[inside] = _mix(out[inside] * np.uint64(0xA0761D6478BD642F) + words[starts[inside] + k])
    return out, np.concatenate([[0], np.cumsum(count)])


def sketches(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, digest, tokens) of every row; digest and tokens are null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, offsets = shingle_sets(column(batch, "text"), width)
            full = np.flatnonzero(np.diff(offsets))
            tokens = np.zeros((len(full), TOKENS), np.uint32)
            for k in range(TOKENS if len(full) else 0):
                tokens[:, k] = np.minimum.reduceat((hashes ^ _MASKS[k]) * _FACTORS[k], offsets[:-1][full]) >> np.uint64(32)
            sizes, digests = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row in full.tolist():
                own = np.unique(hashes[offsets[row]:offsets[row + 1]])
                sizes[row], digests[row] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            lists = np.full(batch.num_rows, 0, np.int64)
            lists[full] = TOKENS
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), pa.array(tokens.view(np.int32).reshape(-1)))],
                ["doc_id", "n_shingles", "digest", "tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, tokens array<int>")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """(v, set): sorted shingle hashes of the documents whose id is wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, offsets = shingle_sets(column(batch, "text"), width)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(sets, pa.binary())], ["v", "set"])

    rows = docs.select(F.col(key).cast("long").alias("v"), F.col(text).alias("text")).join(wanted, "v", "left_semi")
    return rows.mapInArrow(run, "v long, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (row_a, row_b) whose full sets have 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["row_a", "row_b"]).filter(pa.array(keep, pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("v").alias("row_a"), F.col("set").alias("set_a")), "row_a").join(
        sets.select(F.col("v").alias("row_b"), F.col("set").alias("set_b")), "row_b")
    return with_sets.select("row_a", "row_b", "set_a", "set_b").mapInArrow(run, "row_a long, row_b long").distinct()


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose tokens do not speak against it."""
    share = percent / 100
    least = math.ceil(TOKENS * share - 5 * math.sqrt(TOKENS * share * (1 - share)))
    side = lambda x: classes.select(F.col("v").alias(f"row_{x}"), F.col("n_shingles").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    agree = F.size(F.filter(F.zip_with("t_a", "t_b", lambda a, b: a == b), lambda same: same))
    return pairs.join(side("a"), "row_a").join(side("b"), "row_b").filter(
        (100 * small >= percent * large) & (agree >= least)).select("row_a", "row_b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("row_a"), F.greatest(a, b).alias("row_b")]


def _sized(rows: DataFrame, name: str) -> DataFrame:
    """Nodes of two members and more, with their size."""
    size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return stored(attach(rows, size, "node", "inner"), name)


def _trees(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Member lists of all small nodes (the same members count once), and the rows (node, v) of nodes that are large at
    the last level."""
    top = classes.select("v", F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token"))
    rows = _sized(top.select("v", F.xxhash64("tree", "token").alias("node")), "nodes")
    small = rows.filter(F.col("size") <= SMALL)
    for level in range(1, LEVELS):
        large = rows.filter(F.col("size") > SMALL).select("node", "v")
        if large.isEmpty():
            break
        place = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(TOKENS - TREES)) + TREES + 1
        joined = attach(large, classes.select("v", "tokens"), "v", "inner")
        rows = _sized(joined.select("v", F.xxhash64("node", F.element_at("tokens", place.cast("int"))).alias("node")), "nodes")
        small = small.unionByName(rows.filter(F.col("size") <= SMALL))
    lists = small.groupBy("node").agg(F.sort_array(F.collect_set("v")).alias("members")).select("members").distinct()
    return lists.filter(F.size("members") > 1), rows.filter(F.col("size") > SMALL).select("node", "v")


def _components(links: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable over the links (row_a, row_b).

    Labels spread along links and jump to the label of their label, so that rounds grow with the logarithm of the
    longest chain. Every round is written to the shared folder: that cuts lineage, and a table of known size is joined
    without a shuffle while it is small.
    """
    both = stored(links.unionByName(links.select(F.col("row_b").alias("row_a"), F.col("row_a").alias("row_b"))).select(
        F.col("row_a").alias("v"), F.col("row_b").alias("u")), "both-ways")
    labels = stored(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("c"), F.lit(True).alias("moved")), "labels")
    while True:
        heard = both.join(labels.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy("v").agg(F.min("cu").alias("best"))
        spread = labels.join(heard, "v").select("v", F.col("c").alias("old"), F.least("c", "best").alias("near"))
        jump = labels.select(F.col("v").alias("near"), F.col("c").alias("far"))
        lower = F.least("near", F.coalesce("far", "near"))
        labels = stored(spread.join(jump, "near", "left").select("v", lower.alias("c"), (lower < F.col("old")).alias("moved")), "labels")
        if labels.filter("moved").isEmpty():
            return labels.select(F.col("v").alias("vertex"), F.col("c").alias("component"))


def _list_pairs(lists: DataFrame, family: DataFrame) -> DataFrame:
    """All pairs of a list but those inside one family."""
    of_vertex = family.select("centre", F.explode(F.array("v", "centre")).alias("v")).groupBy("v").agg(F.collect_set("centre").alias("families"))
    owned = lists.select(F.xxhash64("members").alias("list"), F.explode("members").alias("v")).join(of_vertex, "v", "left")
    no_family = F.array().cast("array<bigint>")
    again = owned.groupBy("list").agg(F.sort_array(F.collect_set(F.struct("v", F.coalesce("families", no_family).alias("families")))).alias("members"))
    first = again.select("members", F.posexplode("members").alias("at", "a"))
    later = F.slice("members", F.col("at") + 2, F.lit(SMALL))
    apart = F.filter(later, lambda b: ~F.arrays_overlap(F.col("a.families"), b["families"]))
    return first.select(F.col("a.v").alias("row_a"), F.explode(F.transform(apart, lambda b: b["v"])).alias("row_b")).distinct()


def _central(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, centre): the member that agrees most with the most frequent token values of its node."""
    tokens = attach(rows, classes.select("v", "tokens"), "v", "inner")
    places = tokens.select("node", "v", F.posexplode(F.slice("tokens", 1, TYPICAL)).alias("place", "token"))
    counts = places.groupBy("node", "place", "token").agg(F.count(F.lit(1)).alias("n"))
    typical = counts.groupBy("node", "place").agg(F.max(F.struct("n", "token")).alias("top")).groupBy("node").agg(
        F.map_from_entries(F.collect_list(F.struct("place", F.col("top.token").alias("token")))).alias("typical"))
    agree = F.size(F.filter(F.transform(F.slice("tokens", 1, TYPICAL), lambda t, i: t == F.col("typical")[i]), lambda same: same))
    judged = attach(tokens, typical, "node", "inner").select("node", "v", agree.alias("agree"))
    return judged.groupBy("node").agg(F.max(F.struct("agree", (-F.col("v")).alias("less"))).alias("best")).select(
        "node", (-F.col("best.less")).alias("centre"))


def _differences(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(centre, v, element): the elements of each member's symmetric difference from its centre, with their number
    ``apart``, the member's size ``n`` and the number ``prefix`` of rarest elements of which two similar members share one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, centre = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int64) for c in ("set", "centre_set"))
                elements = np.setxor1d(own, centre, assume_unique=True)
                share = percent / 100
                prefix = int((1 - share) / (1 + share) * len(own) * (1 + 1 / share) + 1e-9) + 1
                n = len(elements)
                same = lambda x: pa.array(np.full(n, x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [same(batch.column("centre")[k].as_py()), same(batch.column("v")[k].as_py()), pa.array(elements), same(n), same(len(own)),
                     same(prefix)], ["centre", "v", "element", "apart", "n", "prefix"])

    with_sets = family.join(sets, "v").join(sets.select(F.col("v").alias("centre"), F.col("set").alias("centre_set")), "centre")
    return with_sets.select("centre", "v", "set", "centre_set").mapInArrow(
        run, "centre long, v long, element long, apart long, n long, prefix long")


def _family_pairs(family: DataFrame, components: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a family that may be similar, at least one of them not connected to the centre."""
    owner = components.select(F.col("vertex").alias("v"), "component")
    owned = family.join(owner, "v", "left").withColumn("component", F.coalesce("component", "v"))
    main = components.select(F.col("vertex").alias("centre"), F.col("component").alias("main"))
    placed = stored(owned.join(main, "centre", "left").select(
        "centre", "v", "component", (F.col("component") != F.coalesce("main", "centre")).alias("loose")), "families")
    if placed.filter("loose").isEmpty():
        return family.select(F.col("v").alias("row_a"), F.col("v").alias("row_b")).filter(F.lit(False))
    apart = stored(_differences(family, sets, percent).withColumn("bucket", F.xxhash64("centre", "element")), "differences")
    uses = apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    # elements that nobody shares stay in the order, ahead of all others, but need no partner
    ranked = attach(apart, uses, "bucket").withColumn(
        "place", F.row_number().over(W.partitionBy("centre", "v").orderBy(F.coalesce("uses", F.lit(1)), "element")))
    prefixes = stored(ranked.filter("place <= prefix AND uses > 1").select(
        "bucket", "centre", "v", "n", "apart", "place").join(placed, ["centre", "v"]), "prefixes")
    probe = prefixes.filter("loose").select("bucket", *[F.col(c).alias(f"{c}_w") for c in ("v", "component", "n", "apart", "place")])
    # what the two can still share from this element on must make up the overlap that the similarity asks for
    left = 1 + F.least(F.col("apart") - F.col("place"), F.col("apart_w") - F.col("place_w"))
    enough = F.lit(2 * (100 + percent)) * left >= F.lit(100 + percent) * (F.col("apart") + F.col("apart_w")) - F.lit(100 - percent) * (F.col("n") + F.col("n_w"))
    sizes = 100 * F.least("n", "n_w") >= percent * F.greatest("n", "n_w")
    met = probe.join(prefixes.drop("centre", "loose"), "bucket").filter((F.col("component_w") != F.col("component")) & enough & sizes)
    return met.select(*_ordered("v", "v_w")).distinct()


def class_components(docs: DataFrame, classes: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """(vertex, component) of all classes that are linked with another one. ``classes``: v, n_shingles, tokens."""
    lists, large = _trees(classes)
    lists, large = stored(lists, "small-nodes"), stored(large, "large-nodes")
    centres = stored(_central(large, classes), "centres")
    # nodes of several trees with one centre are one family
    family = stored(attach(large, centres, "node", "inner").filter("v <> centre").select("centre", "v").distinct(), "families")
    stars = family.select(*_ordered("v", "centre")).distinct()
    likely = stored(_likely(_list_pairs(lists, family).unionByName(stars), classes, percent), "likely-pairs")
    wanted = likely.select(F.explode(F.array("row_a", "row_b")).alias("v")).unionByName(family.select(F.explode(F.array("v", "centre")).alias("v")))
    sets = stored(_full_sets(docs, stored(wanted.distinct(), "set-ids"), width, text, key), "shingle-sets")
    links = stored(_confirmed(likely, sets, percent), "links")
    components = _components(links)
    more = stored(_confirmed(_likely(_family_pairs(family, components, sets, percent), classes, percent), sets, percent), "links")
    return components if more.isEmpty() else _components(links.unionByName(more))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: the smallest id reachable over links, itself included."""
    return _owned(docs, width, percent, text, key).drop("digest")


def _owned(docs: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    """``near_duplicates`` with the digest of the shingle set."""
    table = stored(sketches(docs, width, text, key), "sketches")
    filled = table.filter(F.col("digest").isNotNull())
    classes = stored(filled.groupBy("digest").agg(
        F.min("doc_id").alias("v"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens")), "classes")
    components = class_components(docs, classes.filter(F.col("v").isNotNull()).select("v", "n_shingles", "tokens"), width, percent, text, key)
    owned = classes.select("digest", "v").join(components, F.col("v") == F.col("vertex"), "left").select(
        "digest", F.coalesce("component", "v").alias("owner"))
    # two rows of one id may be in two classes: the vertex is both
    out = attach(table.select("doc_id", "n_shingles", "digest"), owned, "digest").withColumn("component_id", F.coalesce("owner", "doc_id"))
    return out.select("doc_id", "n_shingles", "digest", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stand for their component, all columns as they were."""
    lost = _owned(docs, width, percent, text, key).filter("NOT kept")
    # rows without an id are told apart by their shingle sets
    gone = stored(lost.select(F.col("doc_id").alias("__gone"), F.when(F.col("doc_id").isNull(), F.col("digest")).alias("digest")).distinct(), "gone")
    number = F.col(key).cast("long")
    left = docs.join(gone.filter("__gone IS NOT NULL").select("__gone"), number == F.col("__gone"), "left_anti")
    unnamed = gone.filter("__gone IS NULL").select("digest")
    if unnamed.isEmpty():
        return left
    texts = docs.filter(number.isNull()).select(F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    copies = stored(sketches(texts, width, "text", "hash").join(unnamed, "digest", "left_semi").select(F.col("doc_id").alias("__gone")).distinct(), "gone-texts")
    return left.join(copies, number.isNull() & (F.xxhash64(text) == F.col("__gone")), "left_anti")
