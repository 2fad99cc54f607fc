"""Calendar spines.

A spine is built from a ``sequence`` column, so attaching it to a table is an ``explode`` inside each
task: no shuffle and no cross join, whatever the size of the table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.columns import as_date
from opslens.functions.periods import period_range, quarters_in_window

DateLike = dt.date | str | None

ROWS_A_TASK = 1_000_000


def months(as_of: DateLike = None, count: int = 24) -> Column:
    """Array of month starts, oldest first, ending with the month of ``as_of``."""
    last = F.trunc(F.lit(as_date(as_of)), "month")
    return F.sequence(F.add_months(last, 1 - count), last, F.expr("interval 1 month"))


def days(as_of: DateLike = None, count: int = 730) -> Column:
    last = F.lit(as_date(as_of))
    return F.sequence(F.date_sub(last, count - 1), last)


def weeks(as_of: DateLike = None, count: int = 104) -> Column:
    """Array of weekly snapshot days, oldest first, ending on ``as_of``."""
    last = F.lit(as_date(as_of))
    return F.sequence(F.date_sub(last, 7 * (count - 1)), last, F.expr("interval 7 days"))


def with_spine(rows: DataFrame, spine: Column, name: str, spread_by: str | None = None, times: int = 1) -> DataFrame:
    """Repeat every row for each entry of the spine.

    A table of a few megabytes may sit in one partition and still grow a thousandfold here.
    ``spread_by`` hashes the short rows over all cores first, and over more tasks where one would make more than
    ``ROWS_A_TASK`` of the rows that each row becomes in the end, ``times``; the fixed number keeps adaptive execution
    from merging the partitions again for being small.
    """
    if spread_by:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartition(max(cores, -(-rows.count() * times // ROWS_A_TASK)), spread_by)
    return rows.select("*", F.explode(spine).alias(name))


def quarter_spine(spark: SparkSession, first: DateLike, last: DateLike) -> DataFrame:
    """Quarter labels inside a data window with their half-open day ranges."""
    rows = [period_range(q, last) for q in quarters_in_window(as_date(first), as_date(last))]
    return spark.createDataFrame([(p.name, p.start, p.end) for p in rows], "quarter string, quarter_start date, quarter_end date")


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.year(day))


def monthly_totals(sales: DataFrame, as_of: DateLike = None, count: int = 24) -> DataFrame:
    """Lines and revenue for every month of the spine, zero where nothing was sold."""
    month = F.trunc(F.col("sale_date"), "month").alias("period_month")
    sold = sales.groupBy(month).agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue"))
    spine = sales.sparkSession.range(1).select(F.explode(months(as_of, count)).alias("period_month"))
    return _zero_filled(spine.join(sold, "period_month", "left"), "lines", "revenue")


def weekly_counts(inventory: DataFrame, as_of: DateLike = None, count: int = 104) -> DataFrame:
    """Snapshot rows and units on hand for every weekly snapshot day."""
    seen = inventory.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("snapshots"), F.sum("units_on_hand").alias("units_on_hand")
    )
    spine = inventory.sparkSession.range(1).select(F.explode(weeks(as_of, count)).alias("snapshot_date"))
    return _zero_filled(spine.join(seen, "snapshot_date", "left"), "snapshots", "units_on_hand")


def daily_totals_per_store(
    stores: DataFrame, sales: DataFrame, as_of: DateLike = None, count: int = 730
) -> DataFrame:
    """Every store on every day of the spine, with its lines and revenue (zero on idle days)."""
    sold = (
        sales.where(F.col("sale_date") > F.lit(as_date(as_of) - dt.timedelta(days=count)))
        .groupBy("store_id", "sale_date")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue"))
    )
    spine = with_spine(stores.select("store_id"), days(as_of, count), "sale_date", "store_id", count)
    return _zero_filled(spine.join(sold, ["store_id", "sale_date"], "left"), "lines", "revenue")


def quarterly_totals(sales: DataFrame, first: DateLike, last: DateLike) -> DataFrame:
    """Lines and revenue for every quarter label in the window."""
    spine = quarter_spine(sales.sparkSession, first, last)
    window = (F.col("sale_date") >= F.lit(as_date(first))) & (F.col("sale_date") <= F.lit(as_date(last)))
    sold = (
        sales.where(window)
        .groupBy(quarter_label(F.col("sale_date")).alias("quarter"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue"))
    )
    return _zero_filled(spine.join(sold, "quarter", "left"), "lines", "revenue")


def _zero_filled(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(dict(rows.dtypes)[c])) for c in columns})
