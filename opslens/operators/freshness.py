"""How current derived tables are."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Watched:
    """A table, the column holding its data time, and the lag it may have."""

    rows: DataFrame
    time: str
    lag_seconds: int


def status(tables: Mapping[str, Watched], now: Column) -> DataFrame:
    """Last data time, target lag and seconds behind ``now``, per table."""
    found = []
    for name, table in tables.items():
        latest = F.max(F.col(table.time).cast("timestamp"))
        found.append(table.rows.agg(F.lit(name).alias("table_name"), latest.alias("latest_data"), F.lit(table.lag_seconds).alias("target_lag_s")))
    behind = F.unix_seconds(now) - F.unix_seconds("latest_data")
    return reduce(DataFrame.unionAll, found).select(
        "*", behind.alias("behind_s"), (behind > F.col("target_lag_s")).alias("late")
    )


def compare(derived: DataFrame, base: DataFrame, key: str = "trace_id") -> DataFrame:
    """Rows and distinct keys of a derived table and its base, and whether both agree."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"))

    both = counted(derived, "derived").unionAll(counted(base, "base"))
    # two rows: their agreement is an aggregate over them, joined back by being the same for both
    same = both.agg((F.count_distinct("n", "keys") == 1).alias("equal"))
    return both.select("source", "n", "keys", same.scalar().alias("equal"))


def missing_days(base: DataFrame, derived: DataFrame, day: str = "event_date") -> DataFrame:
    """Days of the base that the derived table lacks, with the rows they hold."""
    days = base.groupBy(day).agg(F.count(F.lit(1)).alias("base_rows"))
    return days.join(derived.select(day).distinct(), day, "left_anti").orderBy(day)


def cost_by_day(history: DataFrame, table_name: str | None = None) -> DataFrame:
    """Refresh credits per day and table, latest day first."""
    rows = history if table_name is None else history.where(F.col("table_name") == table_name)
    return (
        rows.groupBy(F.to_date("start_time").alias("day"), "table_name")
        .agg(F.sum("credits_used").alias("credits"))
        .orderBy(F.desc("day"), "table_name")
    )


def row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Rows per table against what is expected."""
    found = [
        rows.agg(F.lit(name).alias("table_name"), F.lit(expected.get(name)).cast("long").alias("expected"), F.count(F.lit(1)).alias("actual"))
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionAll, found).withColumn("matches", F.col("expected") == F.col("actual"))
