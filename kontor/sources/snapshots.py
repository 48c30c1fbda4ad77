"""Keyed tables in buckets: a change rewrites the buckets it touches and no others (SK6, SK7, SK12 on large tables).

A table is a folder of immutable parquet files, ``data/version=v/bucket=b``, and one small manifest per version that says
which version each bucket is read from, how many rows it has and its greatest id. A new version writes the touched buckets
and then its manifest, one file, which makes it visible; readers of an older manifest are not disturbed, and what a failed
attempt left behind is overwritten by the next one. What reaches the driver is the manifest: a row per bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kontor.session import written
from kontor.sources import tables

BUCKETS = 64
_MANIFEST = "bucket int, version long, rows long, top_id long"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a row by the digest of its key columns, blanks and NULL alike."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _write(df: DataFrame, folder: str, keys: Sequence[str], buckets: int, version: int) -> DataFrame:
    """Write rows as their buckets of a version and describe them."""
    target = f"{folder}/data/version={version}"
    dealt = df.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
    stored = df.sparkSession.read.schema(dealt.schema).parquet(target)
    top = F.max("id").cast("long") if "id" in df.columns else F.lit(None).cast("long")
    return stored.groupBy("bucket").agg(F.lit(version).cast("long").alias("version"), F.count(F.lit(1)).alias("rows"), top.alias("top_id"))


def _publish(manifest: DataFrame, folder: str, version: int) -> None:
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/published={version}")


def create(df: DataFrame, folder: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Store a table as version 0, with its columns and its number of buckets beside it."""
    layout = json.dumps({"buckets": buckets, "columns": df.schema.jsonValue()})
    df.sparkSession.createDataFrame([(layout,)], "layout string").coalesce(1).write.mode("overwrite").text(f"{folder}/layout")
    _publish(_write(df, folder, keys, buckets, 0), folder, 0)


def _layout(spark: SparkSession, folder: str) -> tuple[StructType, int]:
    layout = json.loads(spark.read.text(f"{folder}/layout").first()[0])
    return StructType.fromJson(layout["columns"]), layout["buckets"]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest manifest: (bucket, version, rows, top_id, published)."""
    every = spark.read.schema(f"{_MANIFEST}, published int").parquet(f"{folder}/manifest")
    newest = every.agg(F.max("published").alias("newest"))
    return every.join(F.broadcast(newest), F.col("published") == F.col("newest")).drop("newest")


def _read(spark: SparkSession, folder: str, entries, schema) -> DataFrame:
    paths = [f"{folder}/data/version={e.version}/bucket={e.bucket}" for e in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of a stored table."""
    return _read(spark, folder, manifest(spark, folder).collect(), _layout(spark, folder)[0])


def change(spark: SparkSession, folder: str, changes: DataFrame, keys: Sequence[str],
           apply: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], version: int | None = None) -> int:
    """Rewrite the buckets that hold keys of ``changes`` and return how many these are.

    ``apply`` gets the rows of those buckets, the changes, and one row with the table's greatest ``id``, and returns the
    new rows. With ``version``, a version that is there already is left as it is, so that a repeated batch changes nothing.
    """
    entries = manifest(spark, folder).collect()
    published = max((e.published for e in entries), default=0)
    if version is not None and version <= published:
        return 0
    schema, buckets = _layout(spark, folder)
    changes = written(changes, "changes")
    touched = {r.bucket for r in changes.select(bucket_of(keys, buckets).alias("bucket")).distinct().collect()}
    current = _read(spark, folder, [e for e in entries if e.bucket in touched], schema)
    top = spark.createDataFrame([(max((e.top_id or 0 for e in entries), default=0),)], "id long")
    following = published + 1 if version is None else version
    described = _write(apply(current, changes, top).select(*schema.names), folder, keys, buckets, following)
    untouched = spark.createDataFrame([(e.bucket, e.version, e.rows, e.top_id) for e in entries if e.bucket not in touched], _MANIFEST)
    _publish(untouched.unionByName(described), folder, following)
    return len(touched)


def upsert(spark: SparkSession, folder: str, changes: DataFrame, keys: Sequence[str], overwrite: Sequence[str], now: str,
           order: str | None = None, version: int | None = None) -> int:
    """``tables.upsert`` on a stored table."""
    return change(spark, folder, changes, keys, lambda current, new, top: tables.upsert(
        current, new, keys, overwrite, now, order, known_ids=top), version)


def save_enrichment(spark: SparkSession, folder: str, results: DataFrame, now: str) -> int:
    """``tables.save_enrichment`` on a table stored by company key."""
    keyed = results.withColumn("company_key", F.col("result.company_key"))
    return change(spark, folder, keyed, ["company_key"], lambda current, new, _: tables.save_enrichment(current, new.select("result"), now).select(
        *[F.col(f.name).cast(f.dataType) if f.name != "company_key" else F.col(f.name) for f in current.schema]))


def mark_stale(spark: SparkSession, folder: str, keys: DataFrame, now: str) -> int:
    """``tables.mark_stale`` on a table stored by company key."""
    return change(spark, folder, keys.select("company_key"), ["company_key"], lambda current, new, _: tables.mark_stale(current, new, now))
