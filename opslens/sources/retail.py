"""Retail star schema over the order-line tables (region, nation, supplier, part, orders, lineitem).

Every method returns the canonical columns of one table.  Methods that read order lines take the
columns wanted, so that joins which only feed unused columns are never planned, and a day range, so
that it reaches the scan as a pushed filter on the stored timestamp.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.functions.columns import (
    DRAW_SIZE,
    as_date,
    by_position,
    draw_between,
    draw_decimal,
    fixed_list,
    hash_draw,
    money,
)
from opslens.functions.scans import rank_by_draw
from opslens.operators.enrich import padded_code, popularity_multiplier, promo_calendar, tier_multiplier, wage_band
from opslens.sources import spines
from opslens.sources.tables import instant, read_table, wall_time

SALES_COLUMNS = (
    "sale_id", "store_id", "product_id", "sale_date", "units_sold", "discount_pct", "channel",
    "promo_name", "revenue", "created_at",
)


class RetailTables:
    """The eight retail tables as lazy DataFrames."""

    def __init__(self, spark: SparkSession, location: str, as_of: dt.date | str | None = None) -> None:
        self.spark = spark
        self.location = location
        self.as_of = as_date(as_of)

    def _read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.location, name)

    # -- dimensions ---------------------------------------------------------

    def stores(self) -> DataFrame:
        supplier = self._read("supplier")
        places = (
            self._read("nation")
            .join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "r_regionkey", "r_name")
        )
        store_id = (F.col("s_suppkey") + 1).cast("long")
        size = supplier.agg(F.count(F.lit(1))).scalar()
        base = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
            store_id.alias("store_id"),
            padded_code("STORE-", store_id, 4).alias("store_name"),
            F.col("r_name").alias("region"),
            by_position(F.col("r_regionkey"), fv.REGION_WEIGHTS, "decimal(4,2)").alias("region_weight"),
            by_position(F.pmod(F.floor((store_id - 1) / 5), F.lit(5)), fv.STORE_TYPES).alias("store_type"),
            (F.lit(8000) + F.pmod(store_id * 37, F.lit(37001))).alias("sq_ft"),
            F.date_sub(F.lit(self.as_of), draw_between(store_id, "opened", 365, 3650).cast("int")).alias("opened_date"),
            F.when(store_id * 100 <= size * fv.FLAGSHIP_SHARE_PCT, "Flagship")
            .when(store_id * 100 <= size * fv.UNDERPERFORMING_SHARE_PCT, "Underperforming")
            .otherwise("Average")
            .alias("performance_tier"),
        )
        return base.select(
            "*",
            tier_multiplier(F.col("performance_tier"), F.col("store_id")).alias("performance_multiplier"),
            draw_decimal(F.col("store_id"), "trend", *fv.TREND_PCT_RANGE, places=1, precision=4).alias("annual_trend_pct"),
        )

    def products(self, ranked: bool = True) -> DataFrame:
        """``ranked=False`` leaves out the two popularity columns and their sort."""
        product_id = (F.col("p_partkey") + 1).cast("long")
        price = money(F.col("p_retailprice"))
        slot = F.pmod(product_id - 1, F.lit(8))
        lead = by_position(slot, [str(days) for _, days in fv.SUPPLIERS], "int")
        base = self._read("part").select(
            product_id.alias("product_id"),
            padded_code("SKU-", product_id, 5).alias("sku"),
            F.col("p_name").alias("product_name"),
            by_position(slot, fv.CATEGORIES).alias("category"),
            by_position(F.pmod(product_id - 1, F.lit(4)), fv.SUBCATEGORIES).alias("subcategory"),
            F.round(price * F.lit("0.6").cast("decimal(2,1)"), 2).cast("decimal(18,2)").alias("unit_cost"),
            price.alias("unit_price"),
            by_position(slot, [name for name, _ in fv.SUPPLIERS]).alias("supplier"),
            F.greatest(
                F.lit(1),
                F.round(lead * draw_between(product_id, "lead", *fv.LEAD_FACTOR_PCT_RANGE) / F.lit(100.0)).cast("int"),
            ).alias("lead_time_days"),
        )
        if not ranked:
            return base
        drawn = base.withColumn("_draw", hash_draw(F.col("product_id"), "popularity"))
        return rank_by_draw(drawn, "_draw", "product_id", "popularity_rank").select(
            "product_id", "sku", "product_name", "category", "subcategory", "unit_cost", "unit_price",
            F.col("popularity_rank").cast("long").alias("popularity_rank"),
            popularity_multiplier(F.col("popularity_rank")).alias("popularity_multiplier"),
            "supplier", "lead_time_days",
        )

    def promo_calendar(self) -> DataFrame:
        return promo_calendar(self.spark, self.as_of)

    # -- facts --------------------------------------------------------------

    def _lines(self, first: dt.date | None, last: dt.date | None) -> DataFrame:
        lines = self._read("lineitem")
        lines = lines.where(F.col("l_shipdate") < wall_time(last + dt.timedelta(days=1))) if last else lines
        return lines.where(F.col("l_shipdate") >= wall_time(first)) if first else lines

    @staticmethod
    def _sale_id() -> Column:
        return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    @staticmethod
    def _revenue() -> Column:
        kept = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
        return F.round(money(F.col("l_extendedprice")) * kept, 2).cast("decimal(18,2)")

    def _with_channel(self, lines: DataFrame) -> DataFrame:
        orders = self._read("orders").select("o_orderkey", "o_orderpriority")
        urgent = F.substring("o_orderpriority", 1, 1).isin("1", "2")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn(
            "channel", F.when(urgent, "Online").otherwise("In-Store")
        )

    def daily_sales(
        self,
        columns: Sequence[str] = SALES_COLUMNS,
        first: dt.date | str | None = None,
        last: dt.date | str | None = None,
    ) -> DataFrame:
        lines = self._lines(as_date(first) if first else None, as_date(last) if last else None)
        if "channel" in columns:
            lines = self._with_channel(lines)
        made = {
            "sale_id": self._sale_id(),
            "store_id": (F.col("l_suppkey") + 1).cast("long"),
            "product_id": (F.col("l_partkey") + 1).cast("long"),
            "sale_date": F.to_date("l_shipdate"),
            "units_sold": F.col("l_quantity").cast("int"),
            "discount_pct": F.col("l_discount").cast("decimal(4,2)"),
            "revenue": self._revenue(),
            "created_at": instant(F.col("l_shipdate")),
        }
        named = "promo_name" in columns
        needed = dict.fromkeys([*columns, "sale_date"] if named else columns)
        sales = lines.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in needed if c != "promo_name"])
        if named:
            promos = self.promo_calendar().select(F.col("promo_date").alias("sale_date"), "promo_name")
            sales = sales.join(promos, "sale_date", "left")
        return sales.select(*columns)

    def returns(self, first: dt.date | str | None = None, last: dt.date | str | None = None) -> DataFrame:
        """Returned lines: a repeatable draw against the category and channel rate, times five.

        ``first`` and ``last`` bound the day of the sale.
        """
        bounds = [as_date(day) if day else None for day in (first, last)]
        lines = self._with_channel(self._lines(*bounds).where(F.col("l_returnflag") == "R"))
        sale_id = self._sale_id()
        rates = by_position(F.pmod(F.col("l_partkey"), F.lit(8)), [str(fv.RETURN_RATE_PCT[c]) for c in fv.CATEGORIES], "long")
        rate = rates + F.when(F.col("channel") == "Online", fv.RETURN_ONLINE_UPLIFT_PCT).otherwise(0)
        kept = lines.where(hash_draw(sale_id, "return") * 100 < rate * 5 * F.lit(DRAW_SIZE))
        copies = F.when(F.col("l_linenumber") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        refund_share = ((F.lit(85) + F.pmod(F.col("l_orderkey"), F.lit(16))) / F.lit(100.0)).cast("decimal(4,2)")
        rows = kept.select(
            F.explode(copies).alias("_n"),
            sale_id.alias("sale_id"),
            (F.col("l_suppkey") + 1).cast("long").alias("store_id"),
            (F.col("l_partkey") + 1).cast("long").alias("product_id"),
            F.to_date("l_shipdate").alias("sale_date"),
            F.date_add(F.to_date("l_shipdate"), (F.lit(1) + F.pmod(F.col("l_orderkey"), F.lit(14))).cast("int")).alias("return_date"),
            by_position(F.pmod(F.col("l_partkey"), F.lit(5)), fv.RETURN_REASONS).alias("return_reason"),
            F.round(self._revenue() * refund_share, 2).cast("decimal(18,2)").alias("refund_amount"),
        )
        return rows.select(F.concat(F.lit("R-"), "sale_id", F.lit("-"), "_n").alias("return_id"), *rows.columns[1:])

    def sales_targets(self) -> DataFrame:
        """Stores x months; the target is the store's mean month in the window times a drawn share."""
        months = spines.months(self.as_of, fv.TARGET_MONTHS)
        first = period_start(self.as_of, fv.TARGET_MONTHS)
        sold = (
            self.daily_sales(("store_id", "revenue", "units_sold"), first=first, last=self.as_of)
            .groupBy("store_id")
            .agg(F.sum("revenue").alias("_revenue"), F.sum("units_sold").alias("_units"))
        )
        grid = spines.with_spine(self._read("supplier").select((F.col("s_suppkey") + 1).cast("long").alias("store_id")), months, "period_month", "store_id", fv.TARGET_MONTHS)
        share = F.lit(75) + F.pmod(hash_draw(F.concat_ws("-", "store_id", "period_month"), "target"), F.lit(50))
        # whole cents and whole numbers only: half a cent is rounded up exactly
        cents = F.coalesce((F.col("_revenue") * 100).cast("long"), F.lit(0))
        units = F.coalesce("_units", F.lit(0))
        shared = grid.join(sold, "store_id", "left").select(
            "store_id", "period_month", (cents * share).alias("_cents"), (units * share).alias("_shared_units")
        )
        parts = 100 * fv.TARGET_MONTHS
        return shared.select(
            "store_id",
            "period_month",
            (F.expr(f"(_cents * 2 + {parts}) div {2 * parts}") / F.lit(100.0)).cast("decimal(18,2)").alias("target_revenue"),
            F.expr(f"(_shared_units * 2 + {parts}) div {2 * parts}").cast("int").alias("target_units"),
        )

    def inventory(self) -> DataFrame:
        """Each part in four stores over eight weekly snapshots."""
        size = self._read("supplier").agg(F.count(F.lit(1))).scalar()
        places = F.sequence(F.lit(0), F.lit(3))
        parts = spines.with_spine(self._read("part").select("p_partkey"), places, "_i", "p_partkey", 4 * 8)
        grid = spines.with_spine(parts, spines.weeks(self.as_of, 8), "snapshot_date").select(
            (F.pmod(F.col("p_partkey") * 4 + F.col("_i"), size) + 1).cast("long").alias("store_id"),
            (F.col("p_partkey") + 1).cast("long").alias("product_id"),
            "snapshot_date",
        )
        keyed = grid.select(F.concat_ws("-", "product_id", "store_id", "snapshot_date").alias("snapshot_id"), "*")
        key = F.col("snapshot_id")
        return keyed.select(
            "*",
            F.pmod(hash_draw(key, "on_hand"), F.lit(500)).cast("int").alias("units_on_hand"),
            (F.lit(20) + F.pmod(hash_draw(key, "reorder"), F.lit(61))).cast("int").alias("reorder_point"),
            (F.pmod(hash_draw(key, "supply"), F.lit(600)) / F.lit(10.0)).cast("decimal(6,1)").alias("days_of_supply"),
            F.pmod(hash_draw(key, "on_order"), F.lit(151)).cast("int").alias("units_on_order"),
            F.col("snapshot_date").cast("timestamp").alias("created_at"),
        )

    def staff_shifts(self, first: dt.date | str | None = None) -> DataFrame:
        """Three shifts per store and day over 730 days; ``first`` starts the calendar later."""
        return self.shift_figures(self.shift_grid(first))

    def shift_grid(self, first: dt.date | str | None = None) -> DataFrame:
        """Store, region, day and type of every shift, without the drawn figures."""
        count = fv.HISTORY_DAYS
        if first:
            count = min(count, (self.as_of - as_date(first)).days + 1)
        stores = self.stores().select("store_id", "region")
        dated = spines.with_spine(stores, spines.days(self.as_of, count), "shift_date", "store_id", count * len(fv.SHIFT_TYPES))
        return spines.with_spine(dated, fixed_list(fv.SHIFT_TYPES), "shift_type")

    @staticmethod
    def shift_figures(grid: DataFrame) -> DataFrame:
        """The shifts of a grid, each from its own row."""
        keyed = grid.withColumn("shift_id", F.concat_ws("-", "store_id", "shift_date", "shift_type"))
        key = F.col("shift_id")
        as_region = F.when(F.col("region") == "AMERICA", "West").when(F.col("region") == "EUROPE", "Northeast")
        return keyed.select(
            "shift_id", "store_id", "shift_date", "shift_type",
            (F.lit(5) + F.pmod(hash_draw(key, "headcount"), F.lit(10))).cast("int").alias("headcount"),
            (F.lit(40) + F.pmod(hash_draw(key, "hours"), F.lit(73))).cast("int").alias("hours_worked"),
            wage_band(as_region, key).alias("hourly_wage"),
        )


def period_start(as_of: dt.date, months: int) -> dt.date:
    index = as_of.year * 12 + as_of.month - months
    return dt.date(index // 12, index % 12 + 1, 1)
