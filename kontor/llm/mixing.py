"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

A source's demand is the integral of its weight schedule over training time 0..1, scaled to its target. Its documents
form a queue in the order of a digest of their ids and texts, gone through up to ``repeats`` times. Inverting the cumulative
demand gives every copy of a document its training position, and the range sort by position is the training order.

Word counts are sizes. Null texts have size 0 and are taken 0 times. Null sources are a source of their own, last in
order. Null and equal ids spread over the queue by
their texts; rows alike in both are interchangeable. An empty table gives
an empty result. Only named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor.llm.common import SPACE, WORD, stored, text_of

#: Hexadecimal digits of the queue digest that name a slice: a hot source's queue is summed in 4096 slices.
SLICE_DIGITS = 3
#: Weight at the start and at the end of training, as multiples of the mean, dealt to sources in turn.
CURRICULUM = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def word_count(text: Column) -> Column:
    """Number of words without building them: each word and the space around it becomes one letter."""
    marked = F.regexp_replace(text, f"{SPACE}*{WORD}{SPACE}*", "x")
    return F.when(F.rlike(text, F.lit(WORD)), F.length(marked)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: int = 3,
                   curriculum: Sequence[tuple[float, float]] = CURRICULUM) -> DataFrame:
    """(source, source_size, target, w0, w1) from one row per (source, size).

    Weights repeat over the sources in code point order, null last. A target stops at ``repeats`` times its source's
    size; with the sources ordered by that cap per weight, the capped ones come first, and the rest share what is left.
    One row per source goes through a window: a mixture has few sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("number") % len(values) + 1).cast("int"))
    weighed = totals.withColumn("number", number).withColumns({
        "weight": pick(weights), "w0": pick([c[0] for c in curriculum]), "w1": pick([c[1] for c in curriculum])})
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "number")
    before, onward = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    capped = weighed.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = capped.withColumn("level", level)
    # the first source whose cap lies above its share ends the capping; its level holds for all after it
    free = F.first(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(W.unboundedPreceding, W.currentRow))
    return levelled.withColumn("free", free).select(
        "source", "source_size", F.coalesce(F.least("cap", F.col("free") * F.col("weight")), "cap").alias("target"), "w0", "w1")


def training_time(share: Column, w0: Column, w1: Column) -> Column:
    """Time at which the linear schedule w0..w1 has met ``share`` of its demand: the inverse of its integral."""
    a = (w1 - w0) / (w0 + w1)
    b = F.lit(2.0) * w0 / (w0 + w1)
    root = F.sqrt(F.greatest(b * b + F.lit(4.0) * a * share, F.lit(0.0)))
    return F.least(F.coalesce(F.try_divide(F.lit(2.0) * share, b + root), F.lit(0.0)), F.lit(1.0))


def _queued(docs: DataFrame, text: str, key: str, source: str) -> DataFrame:
    """The rows with their size and their place in the source's queue, original columns in the struct ``row``."""
    digest = F.md5(text_of(text).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), digest).cast("binary")).alias("place"), digest.alias("digest"), word_count(text_of(text)).alias("size")).withColumn(
        "slice", F.substring("place", 1, SLICE_DIGITS))


def _with_copies(queued: DataFrame, sizes: DataFrame, weights: Sequence[float], repeats: int) -> DataFrame:
    """Adds source_size, target, copies and taken. ``sizes`` has source, slice and size of the same rows."""
    slices = stored(sizes.groupBy("source", "slice").agg(F.sum("size").alias("size")), "slice-sizes")
    targets = source_targets(slices, weights, repeats)
    earlier = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select("source", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    known = stored(offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("__source"), F.col("slice").alias("__slice"), "offset", "source_size", "target", "w0", "w1"), "slice-offsets")
    inside = W.partitionBy("source", "slice").orderBy("place", "digest").rowsBetween(W.unboundedPreceding, -1)
    placed = queued.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(known, F.col("source").eqNullSafe(F.col("__source")) & (F.col("slice") == F.col("__slice")))
    wanted = F.round("target").cast("long")

    def copy(turn: int) -> Column:
        begin = F.col("offset") + F.col("inside") + F.lit(turn) * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), wanted - begin), F.lit(0).cast("long"))
        return F.struct(words.alias("words"), training_time(
            begin.cast("double") / F.greatest("target", F.lit(1.0)), F.col("w0"), F.col("w1")).alias("position"))

    copies = F.filter(F.array(*[copy(t) for t in range(repeats)]), lambda c: c["words"] > 0)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    return joined.withColumn("copies", copies).withColumn("taken", taken)


def mixing_plan(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: int = 3, text: str = "text",
                key: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row, those taken first in training order.

    ``copies`` are (words, position) of every time that the mix takes the document, in order; the last copy of a source
    may be taken in part, so that its taken words are its target, rounded.
    """
    queued = stored(_queued(docs.select(key, source, text), text, key, source).drop("row"), "sizes")
    planned = _with_copies(queued, queued, weights, repeats)
    first = F.try_element_at("copies", F.lit(1))["position"]
    return planned.orderBy(first.asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixture(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), repeats: int = 3, text: str = "text",
            key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixed corpus: a row of ``docs`` for every copy taken, in training order; a copy taken in part is cut to its
    leading words. Documents without words are not taken. The texts move twice: to their queue and to their position."""
    queued = _queued(docs, text, key, source)
    planned = _with_copies(queued.select("row", "doc_id", "source", "place", "digest", "size", "slice"),
                           queued.select("source", "slice", "size"), weights, repeats)
    taken = planned.select("row", "doc_id", "size", F.explode("copies").alias("copy"))
    whole = F.col("row").getField(text)
    leading = F.slice(F.regexp_extract_all(whole, F.lit(f"({SPACE}*{WORD})"), F.lit(1)), F.lit(1), F.col("copy.words").cast("int"))
    cut = F.when(F.col("copy.words") < F.col("size"), F.array_join(leading, "")).otherwise(whole)
    ordered = taken.orderBy("copy.position", "doc_id")
    return ordered.select(*[cut.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
