"""Helpers the corpus operators share: stored intermediate tables, bounded Arrow slices, null-safe columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one step of a Python operator looks at; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a scratch folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        known = context._jsc.sc().getCheckpointDir()
        if not known.isEmpty():
            return known.get()
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and fixes row order and partition numbers."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, stats: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join one-row-per-key statistics; the extra key gives the join its own exchange, which Spark may split when skewed."""
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20))
    return rows.withColumn("__spread", spread).join(stats.withColumn("__spread", spread), [key, "__spread"], how).drop("__spread")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch with nulls as empty texts, 64-bit offsets."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``step`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
            yield batch.slice(at, upto - at)
            at = upto
    pa.default_memory_pool().release_unused()  # the worker stays, its next task may be another step's


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the offsets of each text's words (n + 1 numbers)."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not filled.all():
        before = np.concatenate([[0], np.cumsum(filled)])
        offsets = before[offsets]
        flat = flat.filter(pa.array(filled))
    return flat, offsets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + length)``."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
