"""Streams of results, changes and activities (T-1 to T-6)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kontor.operators.common import total
from kontor.operators.research import apply_results, report_counters
from kontor.sources import snapshots


def stream_latest_by_key(stream: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Latest row per key, kept as fixed-size state (T-2); the same call works on a batch."""
    values = [c for c in stream.columns if c not in keys]
    latest = stream.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("latest"))
    return latest.select(*keys, "latest.*")


def keep_latest(stream: DataFrame, keys: Sequence[str], order: str, folder: str) -> DataStreamWriter:
    """Latest row per key in a bucketed table (T-2): a batch hands over the keys it changed and rewrites their buckets only.

    ``folder`` holds a table stored by ``snapshots.create`` under the same keys. Batch n is version n + 1, so a batch that
    is run again changes nothing.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        values = [c for c in batch.columns if c not in keys]
        snapshots.upsert(batch.sparkSession, folder, batch, keys, values, "", order=order, version=batch_id + 1)

    return stream_latest_by_key(stream, keys, order).writeStream.outputMode("update").foreachBatch(store)


def stream_report_counters(changes: DataFrame) -> DataFrame:
    """Report counters maintained per arriving change; complete mode (T-3)."""
    return changes.groupBy().agg(*report_counters())


def stream_activity_counts(activities: DataFrame, now: str, *, event_time: str = "occurred_ts",
                           watermark: str = "7 days") -> DataFrame:
    """Open and overdue follow-ups and activities per day (T-5); the day window is an addition."""
    open_ = F.coalesce(F.col("follow_up_at"), F.lit("")) != ""
    overdue = open_ & (F.col("follow_up_at").try_cast("timestamp") <= F.lit(now).cast("timestamp"))
    return activities.withWatermark(event_time, watermark).groupBy(F.window(event_time, "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("activities"), total(open_).alias("open_follow_ups"), total(overdue).alias("overdue_follow_ups")
    ).select(F.col("day.start").alias("day"), "activities", "open_follow_ups", "overdue_follow_ups")


def run_dedup(stream: DataFrame, keys: Sequence[str], event_time: str, watermark: str = "1 day") -> DataFrame:
    """First result per key of a run; the state is bounded by the watermark (T-6)."""
    return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_dashboard(counts: DataFrame, sink: Callable[[DataFrame, int], None], every: str = "350 milliseconds") -> DataStreamWriter:
    """Hand the complete counters to ``sink`` at most once per interval (T-4)."""
    return counts.writeStream.outputMode("complete").trigger(processingTime=every).foreachBatch(sink)


def stream_apply_results(results: DataFrame, read_snapshot: Callable[[], DataFrame], folder: str,
                         written: Callable[[str], None] | None = None) -> DataStreamWriter:
    """Apply every micro-batch of results to the newest customer snapshot (T-1).

    Batch n writes ``folder/batch_id=n`` and nothing else, so a repeated batch overwrites its own output.
    ``read_snapshot`` returns the table as of the batch before; ``written`` is told where the new one is.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        target = f"{folder}/batch_id={batch_id}"
        apply_results(read_snapshot(), batch).write.mode("overwrite").parquet(target)
        if written:
            written(target)

    return results.writeStream.foreachBatch(apply)
