"""Token counts from a digest cache.

Every text is reduced to the SHA-256 of its normalised content. Digest and tokenizer version are looked up in a stored
cache; only distinct digests that it lacks are encoded, and their counts are appended. Null texts count as empty.
Rows with the same id are counted each on its own. An empty table gives an empty result. Only the named columns of the
input are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import SPACE, attach, column, slices, text_of
from kontor.llm.tokens import TOKEN_STEP, encoder, tokenizer_version

CACHE_SCHEMA = "content binary, n_tokens long, tokenizer string"


def content_digest(text: Column, path: str) -> Column:
    """Digest of the text; runs of white space count as one space where the tokenizer drops white space."""
    if encoder(path).chunked:
        text = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.unhex(F.sha2(text.cast("binary"), 256))


def read_cache(spark, cache: str, version: str) -> DataFrame:
    """Counts of one tokenizer version. A repeated append of the same digest does no harm."""
    held = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return held.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, tokenizer: str, over: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, content) per row; appends new counts to ``cache``."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache)
    keyed = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).withColumn(
        "content", content_digest(F.col("text"), tokenizer))
    # equal texts are reduced to one before the shuffle
    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, version).select("content"), "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, step=TOKEN_STEP):
            counts = encoder(tokenizer).counts(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("content").cast(pa.binary()), pa.array(counts)], ["content", "n_tokens"])

    misses.mapInArrow(encode, "content binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.mode(
        "append").partitionBy("tokenizer").parquet(cache)
    slim = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return attach(slim, read_cache(spark, cache, version), "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"), "content")
