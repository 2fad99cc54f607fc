"""Streaming forms of span questions, with state bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens import fixed_values as fv


def concurrency(spans: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """SQL starts per second, emitted once the watermark has passed the second."""
    return (
        spans.where(F.col("span_name") == fv.SQL_SPAN)
        .select("start_ts")
        .withWatermark("start_ts", delay)
        .groupBy(F.window("start_ts", "1 second"))
        .agg(F.count(F.lit(1)).alias("sql_starts"))
        .select(F.col("window.start").alias("sec"), "sql_starts")
    )


def first_spans(spans: DataFrame, delay: str = "25 hours") -> DataFrame:
    """One row per trace and day.

    The delay covers the longest trace; a key is forgotten after it, so the state does not grow with
    the stream.
    """
    return (
        spans.select("trace_id", "event_date", "end_ts")
        .withWatermark("end_ts", delay)
        .dropDuplicatesWithinWatermark(["trace_id", "event_date"])
    )


def daily_counts_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function storing each batch's counts per day.

    A batch replaces its own folder, so a repeated batch is not counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("event_date").agg(F.count(F.lit(1)).alias("turns"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def turns_per_day(spans: DataFrame, path: str, checkpoint: str, delay: str = "25 hours") -> DataFrame:
    """Distinct traces per day from a stream, up to what is available."""
    query = (
        first_spans(spans, delay)
        .writeStream.foreachBatch(daily_counts_writer(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    stored = spans.sparkSession.read.parquet(path)
    return stored.groupBy("event_date").agg(F.sum("turns").alias("turns"))


def late_match(spans: DataFrame, history: DataFrame, minutes: int = fv.HISTORY_DELAY_MINUTES, delay: str = "10 minutes") -> DataFrame:
    """SQL calls with the history row that follows within ``minutes``, or without one once that time is over.

    Both sides carry watermarks and the join a time bound, so rows leave the state when no partner can
    come any more.
    """
    calls = (
        spans.where((F.col("span_name") == fv.SQL_SPAN) & F.col("query_id").isNotNull())
        .select("trace_id", "query_id", "start_ts")
        .withWatermark("start_ts", delay)
    )
    arrived = history.select(
        F.col("query_id").alias("history_id"), "warehouse_name", "execution_time", F.col("start_time").alias("arrived")
    ).withWatermark("arrived", delay)
    bound = F.expr(f"arrived >= start_ts AND arrived <= start_ts + INTERVAL {int(minutes)} MINUTES")
    return calls.join(arrived, (F.col("query_id") == F.col("history_id")) & bound, "left_outer").drop("history_id")
