"""Recurring business asks, each one parameterised query over the metrics model."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.fixed_values import REVENUE_DIMENSIONS, TARGET_DIMENSIONS
from opslens.functions.columns import ratio
from opslens.functions.periods import Period, period_range
from opslens.operators import retail
from opslens.plans.model import Tables, pick
from opslens.plans.query import Where, semantic_query

DateLike = dt.date | str | None

_SALES = ("store_id", "sale_date", "revenue")



def _period(period: str | Period, as_of: DateLike) -> Period:
    return period if isinstance(period, Period) else period_range(period, as_of)


def revenue_by(tables: Tables, dimension: str, period: str | Period, as_of: DateLike = None) -> DataFrame:
    """Revenue of a period by a store, product or sales dimension."""
    if " ".join(dimension.lower().replace("_", " ").split()) not in REVENUE_DIMENSIONS:
        raise ValueError(f"revenue can be asked by {REVENUE_DIMENSIONS}, not {dimension!r}")
    inside = _period(period, as_of)
    return semantic_query(
        tables, ["total_revenue"], [dimension], [Where("sale_date", inside.covers)], order_by=["-total_revenue"]
    )


def inventory_alerts(tables: Tables, region: str) -> DataFrame:
    return retail.inventory_alerts(tables["inventory"], tables["stores"], tables["products"], region)


def target_attainment(tables: Tables, dimension: str, period: str | Period, as_of: DateLike = None) -> DataFrame:
    name = dimension.lower().strip().replace(" ", "_")
    if name.replace("_", " ") not in TARGET_DIMENSIONS:
        raise ValueError(f"attainment can be asked by {TARGET_DIMENSIONS}, not {dimension!r}")
    return retail.target_attainment(
        pick(tables, "daily_sales", _SALES), tables["sales_targets"], tables["stores"], _period(period, as_of), name
    )


def staffing_vs_revenue(tables: Tables, period: str | Period, as_of: DateLike = None) -> DataFrame:
    return retail.staffing_vs_revenue(
        tables["staff_shifts"], pick(tables, "daily_sales", _SALES), tables["stores"], _period(period, as_of)
    )


def return_rate(tables: Tables, category: str) -> DataFrame:
    """Return rate of one category."""
    counts = semantic_query(tables, ["return_count", "transaction_count"], ["category"], [Where("category", category)])
    return counts.withColumn("return_rate_pct", ratio(F.col("return_count"), F.col("transaction_count"), 2, 100))


def returns_by_reason(tables: Tables, reason: str) -> DataFrame:
    """How many returns gave a reason, whatever the case."""
    same = Where("return_reason", lambda c: F.lower(c) == reason.lower())
    return semantic_query(tables, ["return_count"], ["return_reason"], [same])


def top_products(tables: Tables, n: int, region: str) -> DataFrame:
    sales = pick(tables, "daily_sales", ("store_id", "product_id", "units_sold"))
    return retail.top_products(sales, tables["products"], tables["stores"], region, n)


def supplier_lead_time(tables: Tables) -> DataFrame:
    """Suppliers by average lead time, longest first."""
    return semantic_query(tables, ["avg_lead_time_days"], ["supplier"], order_by=["-avg_lead_time_days"])


def compare(ask: Callable[..., DataFrame], slots: Mapping[str, Mapping], key: Sequence[str], value: str) -> DataFrame:
    """The same ask for two or more slots side by side: one column per slot."""
    tagged = [ask(**arguments).select(*key, F.col(value), F.lit(tag).alias("_slot")) for tag, arguments in slots.items()]
    stacked = tagged[0]
    for rows in tagged[1:]:
        stacked = stacked.unionByName(rows)
    return stacked.groupBy(*key).pivot("_slot", list(slots)).agg(F.first(value))
