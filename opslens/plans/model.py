"""The retail metrics model: tables, keys, relationships, facts, dimensions and metrics.

A metric is declared as a few additive measures over facts of one table (sums and counts) and a
closing expression over their totals.  Additive measures can be aggregated by foreign key first and
summed again after a dimension is joined, which is what ``opslens.plans.query`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import fixed_values as fv


@dataclass(frozen=True)
class Table:
    name: str
    primary_key: tuple[str, ...]
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``source`` refer to one row of ``target`` (a single-column key)."""

    source: str
    column: str
    target: str
    target_column: str


@dataclass(frozen=True)
class Fact:
    table: str
    name: str
    column: str


@dataclass(frozen=True)
class Dimension:
    table: str
    name: str
    synonyms: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    is_enum: bool = False


@dataclass(frozen=True)
class Metric:
    """``measures``: name -> (aggregate over one row, as a Column maker); ``close``: totals -> value.

    ``parts`` names metrics of other tables for a metric spanning several base tables; ``needs``
    names columns that the measures read beyond the facts.
    """

    table: str | None
    name: str
    measures: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    close: Callable[[Mapping[str, Column]], Column] | None = None
    synonyms: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


def pick(tables: Tables, name: str, columns: Iterable[str]) -> DataFrame:
    """A table with at least these columns.

    A mapping that offers ``pick(name, columns)`` builds no more than that, so joins that only feed
    other columns are never planned.
    """
    own = getattr(tables, "pick", None)
    return own(name, tuple(dict.fromkeys(columns))) if own else tables[name]


def _sum_of(fact: str) -> Callable[[], Column]:
    return lambda: F.sum(fact)


def _count_of(fact: str) -> Callable[[], Column]:
    return lambda: F.count(fact)


def total(table: str, name: str, fact: str, synonyms: tuple[str, ...] = ()) -> Metric:
    return Metric(table, name, {"s": _sum_of(fact)}, lambda m: m["s"], synonyms)


def mean(table: str, name: str, fact: str, synonyms: tuple[str, ...] = ()) -> Metric:
    def close(m: Mapping[str, Column]) -> Column:
        return m["s"].cast("double") / F.nullif(m["n"].cast("double"), F.lit(0.0))

    return Metric(table, name, {"s": _sum_of(fact), "n": _count_of(fact)}, close, synonyms)


def row_count(table: str, name: str, synonyms: tuple[str, ...] = ()) -> Metric:
    return Metric(table, name, {"n": lambda: F.count(F.lit(1))}, lambda m: F.coalesce(m["n"], F.lit(0)), synonyms)


def _share(top: str, bottom: str) -> Callable[[Mapping[str, Column]], Column]:
    def close(m: Mapping[str, Column]) -> Column:
        return m[top].cast("double") / F.nullif(m[bottom].cast("double"), F.lit(0.0)) * F.lit(100.0)

    return close


@dataclass(frozen=True)
class Model:
    tables: tuple[Table, ...]
    relationships: tuple[Relationship, ...]
    facts: tuple[Fact, ...]
    dimensions: tuple[Dimension, ...]
    metrics: tuple[Metric, ...]

    def table(self, name: str) -> Table:
        return next(t for t in self.tables if t.name == name)

    def facts_of(self, table: str) -> list[Fact]:
        return [f for f in self.facts if f.table == table]


RETAIL_MODEL = Model(
    tables=(
        Table("daily_sales", ("sale_id",), ("sales", "transactions", "orders")),
        Table("stores", ("store_id",), ("locations", "branches")),
        Table("products", ("product_id",), ("items", "skus")),
        Table("sales_targets", ("store_id", "period_month"), ("targets", "quotas", "goals")),
        Table("inventory", ("snapshot_id",), ("stock", "stock levels")),
        Table("staff_shifts", ("shift_id",), ("staffing", "labor", "shifts")),
        Table("returns", ("return_id",), ("refunds", "returned items")),
    ),
    relationships=(
        Relationship("daily_sales", "store_id", "stores", "store_id"),
        Relationship("daily_sales", "product_id", "products", "product_id"),
        Relationship("sales_targets", "store_id", "stores", "store_id"),
        Relationship("inventory", "store_id", "stores", "store_id"),
        Relationship("inventory", "product_id", "products", "product_id"),
        Relationship("staff_shifts", "store_id", "stores", "store_id"),
        Relationship("returns", "store_id", "stores", "store_id"),
        Relationship("returns", "product_id", "products", "product_id"),
        Relationship("returns", "sale_id", "daily_sales", "sale_id"),
    ),
    facts=(
        Fact("daily_sales", "units_sold_fact", "units_sold"),
        Fact("daily_sales", "revenue_fact", "revenue"),
        Fact("daily_sales", "discount_pct_fact", "discount_pct"),
        Fact("inventory", "units_on_hand_fact", "units_on_hand"),
        Fact("inventory", "reorder_point_fact", "reorder_point"),
        Fact("inventory", "units_on_order_fact", "units_on_order"),
        Fact("staff_shifts", "headcount_fact", "headcount"),
        Fact("staff_shifts", "hours_worked_fact", "hours_worked"),
        Fact("staff_shifts", "wage_fact", "hourly_wage"),
        Fact("products", "lead_time_fact", "lead_time_days"),
        Fact("returns", "refund_amount_fact", "refund_amount"),
        Fact("sales_targets", "target_revenue_fact", "target_revenue"),
        Fact("sales_targets", "target_units_fact", "target_units"),
    ),
    dimensions=(
        Dimension("stores", "region", ("area", "territory"), fv.REGIONS, True),
        Dimension("stores", "store_type", ("format", "store format"), fv.STORE_TYPES, True),
        Dimension("stores", "performance_tier", ("store tier",), fv.PERFORMANCE_TIERS, True),
        Dimension("stores", "store_name"),
        Dimension("products", "category", ("department",), fv.CATEGORIES, True),
        Dimension("products", "subcategory", (), fv.SUBCATEGORIES, True),
        Dimension("products", "supplier", ("vendor", "manufacturer")),
        Dimension("daily_sales", "sale_date", ("transaction date", "order date")),
        Dimension("daily_sales", "channel", (), fv.CHANNELS, True),
        Dimension("daily_sales", "promo_name", ("promotion", "sale event")),
        Dimension("sales_targets", "period_month"),
        Dimension("inventory", "snapshot_date"),
        Dimension("staff_shifts", "shift_date"),
        Dimension("staff_shifts", "shift_type", (), fv.SHIFT_TYPES, True),
        Dimension("returns", "return_date"),
        Dimension("returns", "return_reason", (), fv.RETURN_REASONS, True),
    ),
    metrics=(
        total("daily_sales", "total_revenue", "revenue_fact", ("total sales", "gross revenue")),
        total("daily_sales", "total_units_sold", "units_sold_fact", ("units sold",)),
        row_count("daily_sales", "transaction_count", ("number of transactions", "sales count")),
        mean("daily_sales", "avg_discount_pct", "discount_pct_fact"),
        mean("daily_sales", "avg_order_value", "revenue_fact", ("AOV",)),
        Metric(
            "daily_sales",
            "online_revenue_pct",
            {
                "online": lambda: F.sum(
                    F.when(F.col("channel") == "Online", F.col("revenue_fact")).otherwise(F.lit(0).cast("decimal(18,2)"))
                ),
                "all": _sum_of("revenue_fact"),
            },
            _share("online", "all"),
            ("online penetration", "online share"),
            needs=("channel",),
        ),
        mean("inventory", "avg_units_on_hand", "units_on_hand_fact"),
        Metric(
            "inventory",
            "inventory_alert_count",
            {"n": lambda: F.count_if(F.col("units_on_hand_fact") < F.col("reorder_point_fact"))},
            lambda m: F.coalesce(m["n"], F.lit(0)),
            ("stockout risk", "low stock count"),
        ),
        total("inventory", "total_units_on_order", "units_on_order_fact", ("incoming replenishment",)),
        total("staff_shifts", "total_headcount", "headcount_fact"),
        total("staff_shifts", "total_labor_hours", "hours_worked_fact"),
        Metric(
            "staff_shifts",
            "total_labor_cost",
            {"s": lambda: F.sum(F.col("hours_worked_fact") * F.col("wage_fact"))},
            lambda m: m["s"],
            ("labor cost", "staffing cost"),
        ),
        total("sales_targets", "total_target_revenue", "target_revenue_fact"),
        mean("products", "avg_lead_time_days", "lead_time_fact", ("supplier lead time",)),
        row_count("returns", "return_count"),
        total("returns", "total_refund_amount", "refund_amount_fact", ("total refunds",)),
        Metric(
            None,
            "return_rate_pct",
            close=_share("return_count", "transaction_count"),
            synonyms=("return rate",),
            parts=("return_count", "transaction_count"),
        ),
    ),
)

Tables = Mapping[str, DataFrame]
