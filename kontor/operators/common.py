"""Patterns shared by the operators: skew-safe statistics joins, keep-first, ranks, one-row results."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontor.functions import text as T

ROW_NO = "row_no"
RANK_BUCKET = 1_000_000


def first_column(df: DataFrame, aliases: Sequence[str]) -> Column:
    """First alias that exists as a column, even when its cells are blank."""
    for name in aliases:
        if name in df.columns:
            return F.col(f"`{name}`")
    return F.lit("")


def data_columns(df: DataFrame) -> list[str]:
    """The columns of the open customer frame, without the technical row number."""
    return [name for name in df.columns if name != ROW_NO]


def present(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """The column, or a blank stand-in when the frame does not have it."""
    return F.col(f"`{name}`") if name in df.columns else (F.lit("") if default is None else default)


def spread(df: DataFrame, key: str = ROW_NO) -> DataFrame:
    """Deal rows out over all tasks: a table's file may be small enough for one or two, however long its rows take."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, key) if key in df.columns else df.repartition(tasks)


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key statistics (one row per key) back to the rows they were computed from.

    The extra equi-key makes both sides arrive through a shuffle of the join's own. Only then may adaptive
    execution split a partition that one hot key fills; joining on the aggregation's partitioning would
    pin all rows of that key to one task.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(1 << 20))
    left, right = rows.withColumn("__spread", spread), stats.withColumn("__spread", spread)
    return left.join(right, [*keys, "__spread"], how).drop("__spread")


def keep_first(df: DataFrame, keys: Sequence[str] | None = None, order: str = ROW_NO) -> DataFrame:
    """Drop later rows with equal keys (W3); every task keeps one row per key before the shuffle."""
    wanted = [k for k in (keys if keys is not None else data_columns(df)) if k in df.columns] or data_columns(df)
    window = W.partitionBy(*[F.col(f"`{k}`") for k in wanted]).orderBy(order)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def nth_of_key(df: DataFrame, keys: Sequence[str], order: str = ROW_NO, out: str = "nth") -> DataFrame:
    """Running number within the key in ``order``, without one task per hot key.

    Rows are numbered inside slices of the order column; the slice counts per key give the offset.
    """
    sliced = df.withColumn("__slice", F.floor(F.col(order) / F.lit(RANK_BUCKET)))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__rows"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    inside = W.partitionBy(*keys, "__slice").orderBy(order)
    numbered = sliced.withColumn("__in", F.row_number().over(inside))
    joined = numbered.join(offsets, [*keys, "__slice"])
    return joined.withColumn(out, F.col("__in") + F.col("__offset")).drop("__slice", "__in", "__offset")


def with_row_no(df: DataFrame, start: int = 0) -> DataFrame:
    """Number the rows of a source in its reading order, once, at ingest.

    Only the row counts per partition are gathered, never the rows. The frame is read twice, so its partitions
    must be fixed: a file scan or a checkpoint. Behind a shuffle the two runs may be planned differently; a row
    whose partition was not counted raises an error instead of getting lost.
    """
    local = F.monotonically_increasing_id()
    tagged = df.withColumn("__part", F.shiftright(local, 33).cast("int")).withColumn(
        "__pos", local.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    # one row per input partition: bounded by the number of tasks, not by the data
    joined = tagged.join(F.broadcast(offsets), "__part", "left")
    sound = F.coalesce(F.col("__pos") < F.col("__n"), F.lit(False))
    number = F.when(sound, F.col("__pos") + F.col("__offset") + F.lit(start)).otherwise(
        F.raise_error(F.lit("Row numbering needs a frame with fixed partitions.")).cast("bigint"))
    return joined.withColumn(ROW_NO, number).drop("__part", "__pos", "__n", "__offset")


def one_per_key(df: DataFrame, keys: Sequence[str | Column], first_by: str = "id") -> DataFrame:
    """The row with the smallest ``first_by`` of each key: the side of a lookup must be unique."""
    window = W.partitionBy(*[F.col(k) if isinstance(k, str) else k for k in keys]).orderBy(first_by)
    return df.withColumn("__rank", F.row_number().over(window)).filter("__rank = 1").drop("__rank")


def one_row(*frames: DataFrame) -> DataFrame:
    """Lay several one-row results side by side."""
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in stacked.columns])


def non_blank(column: Column) -> Column:
    """The value, or NULL when it is blank."""
    return F.when(T.is_blank(column), F.lit(None)).otherwise(column)


def total(condition: Column) -> Column:
    """Number of rows meeting a condition; 0 over no rows."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows by a staged result (a validated phone or URL) without moving the test below the stages.

    A plain filter would be pushed through the staged projections and repeat the whole validation.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.when(condition, F.array(row))))
