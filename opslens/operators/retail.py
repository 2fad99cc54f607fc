"""Retail questions over the star schema.

Facts are aggregated by their own key columns before any dimension is joined, so a store or product
holding a large part of all rows is combined inside the map tasks and the join sees one row per key.
A side is broadcast only below the configured threshold, by Spark's own choice or, where rows are joined
before any aggregate, after a check of its estimate (``join_dimension``); beyond it sort-merge joins run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslens.functions.columns import as_date, ratio
from opslens.functions.joins import join_dimension
from opslens.functions.periods import Period, between, period_range

DateLike = dt.date | str | None


def _sold(sales: DataFrame, period: Period | None = None) -> DataFrame:
    return sales.where(period.covers(F.col("sale_date"))) if period else sales


def revenue_by_store_attribute(
    sales: DataFrame, stores: DataFrame, attribute: str, period: Period | None = None
) -> DataFrame:
    """Revenue summed by a store column: by store first, then by the attribute."""
    per_store = _sold(sales, period).groupBy("store_id").agg(F.sum("revenue").alias("_revenue"))
    return (
        per_store.join(stores.select("store_id", attribute), "store_id")
        .groupBy(attribute)
        .agg(F.sum("_revenue").alias("total_revenue"))
    )


def top_stores_by_revenue(sales: DataFrame, stores: DataFrame, as_of: DateLike = None, n: int = 10) -> DataFrame:
    """Stores with the highest revenue in the last calendar month."""
    totals = revenue_by_store_attribute(sales, stores, "store_name", period_range("last month", as_of))
    return totals.orderBy(F.desc_nulls_first("total_revenue"), F.asc("store_name")).limit(n)


def inventory_alerts(inventory: DataFrame, stores: DataFrame, products: DataFrame, region: str) -> DataFrame:
    """Products below their reorder point in a region's latest snapshot, largest shortfall first."""
    latest = inventory.agg(F.max("snapshot_date")).scalar()
    low = inventory.where(
        (F.col("snapshot_date") == latest) & (F.col("units_on_hand") < F.col("reorder_point"))
    )
    named = stores.where(F.col("region") == region).select("store_id", "store_name")
    listed = products.select("product_id", "product_name")
    return (
        join_dimension(join_dimension(low, named, "store_id"), listed, "product_id")
        .select("store_name", "product_name", "units_on_hand", "reorder_point")
        .orderBy(
            F.desc_nulls_first(F.col("reorder_point") - F.col("units_on_hand")),
            "store_name", "product_name", "units_on_hand",
        )
    )


def target_attainment(
    sales: DataFrame, targets: DataFrame, stores: DataFrame, period: Period, attribute: str = "region"
) -> DataFrame:
    """Revenue against targets for months with sales, by a store attribute."""
    month = F.trunc(F.col("sale_date"), "month").alias("period_month")
    actual = _sold(sales, period).groupBy("store_id", month).agg(F.sum("revenue").alias("_actual"))
    matched = actual.join(targets.select("store_id", "period_month", "target_revenue"), ["store_id", "period_month"])
    per_store = matched.groupBy("store_id").agg(F.sum("_actual").alias("_actual"), F.sum("target_revenue").alias("_target"))
    return (
        per_store.join(stores.select("store_id", attribute), "store_id")
        .groupBy(attribute)
        .agg(F.sum("_actual").alias("actual_revenue"), F.sum("_target").alias("target_revenue"))
        .withColumn("attainment_pct", ratio(F.col("actual_revenue"), F.col("target_revenue"), 1, 100))
        .orderBy(F.desc_nulls_first("attainment_pct"), attribute)
    )


def category_wow_drop(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """Largest week-over-week revenue drops by category.

    The window runs over weekly totals: one row per category and week.
    """
    week = F.trunc(F.col("sale_date"), "week").alias("week_start")
    per_product = sales.groupBy("product_id", week).agg(F.sum("revenue").alias("_revenue"))
    weekly = (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy("category", "week_start")
        .agg(F.sum("_revenue").alias("revenue"))
    )
    previous = F.lag("revenue").over(Window.partitionBy("category").orderBy("week_start"))
    change = F.col("revenue") - F.col("prev_week_revenue")
    return (
        weekly.withColumn("prev_week_revenue", previous)
        .where(F.col("prev_week_revenue").isNotNull())
        .withColumn("wow_change_pct", ratio(change, F.col("prev_week_revenue"), 1, 100))
        .orderBy(F.asc_nulls_last("wow_change_pct"), "category", "week_start")
        .limit(n)
    )


def sales_per_sqft(sales: DataFrame, stores: DataFrame, n: int = 10) -> DataFrame:
    """Stores with the lowest revenue per square foot."""
    per_store = sales.groupBy("store_id").agg(F.sum("revenue").alias("_revenue"))
    return (
        per_store.join(stores.select("store_id", "store_name", "sq_ft"), "store_id")
        .groupBy("store_name", "sq_ft")
        .agg(F.sum("_revenue").alias("total_revenue"))
        .withColumn("revenue_per_sqft", ratio(F.col("total_revenue"), F.col("sq_ft"), 2))
        .orderBy(F.asc_nulls_last("revenue_per_sqft"), "store_name", "sq_ft")
        .limit(n)
    )


def staffing_vs_revenue(
    shifts: DataFrame, sales: DataFrame, stores: DataFrame, period: Period
) -> DataFrame:
    """Labor hours and revenue for every store in a period, stores without either included."""
    hours = (
        shifts.where(period.covers(F.col("shift_date")))
        .groupBy("store_id")
        .agg(F.sum("hours_worked").alias("_hours"))
    )
    revenue = _sold(sales, period).groupBy("store_id").agg(F.sum("revenue").alias("_revenue"))
    joined = stores.select("store_id", "store_name").join(hours, "store_id", "left").join(revenue, "store_id", "left")
    nothing = F.lit(0).cast("decimal(28,2)")
    return joined.select(
        "store_name",
        F.coalesce("_hours", F.lit(0)).alias("total_labor_hours"),
        F.coalesce(F.col("_revenue").cast("decimal(28,2)"), nothing).alias("total_revenue"),
        ratio(F.coalesce(F.col("_revenue").cast("decimal(28,2)"), nothing), F.col("_hours"), 2).alias("revenue_per_labor_hour"),
    ).orderBy(F.desc_nulls_first("revenue_per_labor_hour"), "store_name")


def regional_revenue(sales: DataFrame, stores: DataFrame, first: DateLike, last: DateLike) -> DataFrame:
    """Revenue by region over a closed day range."""
    totals = revenue_by_store_attribute(sales, stores, "region", between(first, last))
    return totals.orderBy(F.desc_nulls_first("total_revenue"), "region")


def top_products(
    sales: DataFrame, products: DataFrame, stores: DataFrame, region: str | None = None, n: int = 5
) -> DataFrame:
    """Best-selling products by units, in one region or everywhere."""
    if region is not None:
        sales = sales.join(stores.where(F.col("region") == region).select("store_id"), "store_id", "left_semi")
    per_product = sales.groupBy("product_id").agg(F.sum("units_sold").alias("_units"))
    return (
        per_product.join(products.select("product_id", "product_name", "category"), "product_id")
        .groupBy("product_name", "category")
        .agg(F.sum("_units").alias("total_units"))
        .orderBy(F.desc_nulls_first("total_units"), "product_name", "category")
        .limit(n)
    )


def online_penetration(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Online share of revenue by region, in percent."""
    online = F.when(F.col("channel") == "Online", F.col("revenue")).otherwise(F.lit(0).cast("decimal(18,2)"))
    per_store = sales.groupBy("store_id").agg(F.sum(online).alias("_online"), F.sum("revenue").alias("_all"))
    return (
        per_store.join(stores.select("store_id", "region"), "store_id")
        .groupBy("region")
        .agg(F.sum("_online").alias("_online"), F.sum("_all").alias("_all"))
        .select("region", ratio(F.col("_online"), F.col("_all"), 1, 100).alias("online_pct"))
        .orderBy(F.desc_nulls_first("online_pct"), "region")
    )


def return_rate_by_category(sales: DataFrame, returns: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct returns per distinct sale by category; a sale may have several returns.

    The two distinct counts run on separate inputs, so no row is expanded and no wide join result is
    deduplicated: sales alone give the transactions, and only returned sales meet the returns.
    """
    sold = sales.select("sale_id", "product_id")
    categories = products.select("product_id", "category")
    transactions = (
        sold.join(categories, "product_id")
        .groupBy("category")
        .agg(F.count_distinct("sale_id").alias("transaction_count"))
    )
    returned = (
        sold.join(returns.select("sale_id", "return_id"), "sale_id")
        .join(categories, "product_id")
        .groupBy("category")
        .agg(F.count_distinct("return_id").alias("return_count"))
    )
    same = transactions["category"].eqNullSafe(returned["category"])
    return (
        transactions.join(returned, same, "left")
        .select(
            transactions["category"],
            F.coalesce("return_count", F.lit(0)).alias("return_count"),
            "transaction_count",
        )
        .withColumn("return_rate_pct", ratio(F.col("return_count"), F.col("transaction_count"), 2, 100))
        .orderBy(F.desc_nulls_first("return_rate_pct"), "category")
    )


def labor_cost_pct(shifts: DataFrame, sales: DataFrame, period: Period) -> DataFrame:
    """Labor cost, revenue and their ratio over a period, as one row.

    Both totals are tagged and summed in one aggregate, so no join of one-row tables is needed.
    """
    money = "decimal(28,2)"
    cost = shifts.where(period.covers(F.col("shift_date"))).agg(
        F.sum(F.col("hours_worked") * F.col("hourly_wage")).cast(money).alias("_cost")
    )
    earned = _sold(sales, period).agg(F.sum("revenue").cast(money).alias("_revenue"))
    both = cost.withColumn("_revenue", F.lit(None).cast(money)).unionByName(
        earned.withColumn("_cost", F.lit(None).cast(money))
    )
    return both.agg(
        F.sum("_cost").cast(money).alias("total_labor_cost"), F.sum("_revenue").cast(money).alias("total_revenue")
    ).withColumn("labor_cost_pct", ratio(F.col("total_labor_cost"), F.col("total_revenue"), 2, 100))


def supplier_lead_vs_stockouts(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Average lead time and stock-out count per supplier in the latest snapshot."""
    latest = inventory.agg(F.max("snapshot_date")).scalar()
    short = F.count_if(F.col("units_on_hand") < F.col("reorder_point"))
    per_product = (
        inventory.where(F.col("snapshot_date") == latest)
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("_rows"), short.alias("_short"))
    )
    timed = F.when(F.col("lead_time_days").isNotNull(), F.col("_rows"))
    return (
        per_product.join(products.select("product_id", "supplier", "lead_time_days"), "product_id")
        .groupBy("supplier")
        .agg(
            ratio(F.sum(F.col("lead_time_days") * F.col("_rows")), F.sum(timed), 1).alias("avg_lead_time_days"),
            F.sum("_short").alias("stockout_count"),
        )
        .orderBy(F.desc_nulls_first("avg_lead_time_days"), "supplier")
    )


def revenue_per_store_by_tier(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores with sales and mean revenue per store, by performance tier."""
    per_store = sales.groupBy("store_id").agg(F.sum("revenue").alias("_revenue"))
    return (
        per_store.join(stores.select("store_id", "performance_tier"), "store_id")
        .groupBy("performance_tier")
        .agg(
            F.count("store_id").alias("n_stores"),
            ratio(F.sum("_revenue"), F.count("store_id"), 0).alias("avg_revenue_per_store"),
        )
        .orderBy(F.desc_nulls_first("avg_revenue_per_store"), "performance_tier")
    )


def product_concentration(sales: DataFrame, products: DataFrame, top_share: float = 0.1) -> DataFrame:
    """Revenue of the most popular share of products against the rest."""
    total = products.agg(F.count(F.lit(1))).scalar()
    segment = F.when(F.col("popularity_rank") <= total * F.lit(top_share), "Top 10%" if top_share == 0.1 else "Top").otherwise("Rest")
    per_product = sales.groupBy("product_id").agg(F.sum("revenue").alias("_revenue"))
    return (
        per_product.join(products.select("product_id", "popularity_rank"), "product_id")
        .groupBy(segment.alias("segment"))
        .agg(F.round(F.sum("_revenue"), 0).cast("decimal(28,0)").alias("total_revenue"))
    )


def region_last_days(sales: DataFrame, stores: DataFrame, as_of: DateLike = None, days: int = 30) -> DataFrame:
    """Revenue by region from ``days`` before ``as_of`` up to that day."""
    last = as_date(as_of)
    inside = F.col("sale_date").between(F.lit(last - dt.timedelta(days=days)), F.lit(last))
    totals = revenue_by_store_attribute(sales.where(inside), stores, "region")
    return totals.orderBy(F.desc_nulls_first("total_revenue"), "region")


