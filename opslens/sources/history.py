"""Query history and refresh history over the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.sources.tables import instant, read_table
from opslens.sources.traces import event_number

HISTORY_COLUMNS = (
    "query_id", "warehouse_name", "compilation_time", "execution_time", "bytes_scanned",
    "partitions_scanned", "partitions_total", "rows_produced",
)


def query_history(spark: SparkSession, location: str) -> DataFrame:
    """One row per executed statement; one statement in ten never arrives in the history."""
    return history_of(read_table(spark, location, "events"))


def history_of(events: DataFrame) -> DataFrame:
    """Query history of an ``events`` DataFrame, batch or streaming; rows come up to an hour after the query."""
    ran = events.where((F.col("event_type") == "click") & (F.col("event_id") % 10 != 0))
    k = event_number(F.col("props"))
    return ran.select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"),
        F.concat(F.lit("WH_"), (k % 3).cast("string")).alias("warehouse_name"),
        (k * 3 + 5).alias("compilation_time"),
        F.round(F.col("value") * 100).cast("long").alias("execution_time"),
        (k * 1000003).alias("bytes_scanned"),
        (k % 20).alias("partitions_scanned"),
        (k % 5 + 20).alias("partitions_total"),
        (k * 10).alias("rows_produced"),
        (instant(F.col("ts")) + F.make_dt_interval(mins=(k % 61).cast("int"))).alias("start_time"),
    )


def refresh_history(spark: SparkSession, location: str) -> DataFrame:
    """One row per refresh with the credits it used."""
    runs = read_table(spark, location, "events").where(F.col("event_type") == "error")
    credits = F.round(F.col("value") * 100).cast("long") / F.lit(100000.0)
    return runs.select(
        instant(F.col("ts")).alias("start_time"),
        F.concat(F.lit("spans_"), (event_number(F.col("props")) % 3).cast("string")).alias("table_name"),
        credits.cast("decimal(12,5)").alias("credits_used"),
    )
