"""Retail enrichment: business rules that derive columns and rows of the star schema.

All rules are row-local expressions, except where a rule needs another table.  Draws come from
``hash_draw`` on a key, so reruns and retried tasks give the same rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.functions.columns import (
    DRAW_SIZE,
    as_date,
    by_position,
    draw_between,
    draw_decimal,
    fixed,
    fixed_list,
    hash_draw,
    is_weekend,
)
from opslens.functions.joins import join_dimension
from opslens.functions.scans import rank_by_draw
from opslens.sources import spines

# -- stores ------------------------------------------------------------------


def padded_code(prefix: str, number: Column, width: int) -> Column:
    """Prefix and zero-padded number; a longer number keeps all its digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def tier_of(position: Column, total: Column) -> Column:
    """Performance tier by share of the ranking: first tenth, next fifth, rest."""
    return (
        F.when(position * 100 <= total * fv.FLAGSHIP_SHARE_PCT, "Flagship")
        .when(position * 100 <= total * fv.UNDERPERFORMING_SHARE_PCT, "Underperforming")
        .otherwise("Average")
    )


def tier_multiplier(tier: Column, key: Column) -> Column:
    """Multiplier drawn from the range of the tier, two decimals."""
    drawn = {
        name: draw_decimal(key, "multiplier", low, high, places=2, precision=4)
        for name, (low, high) in fv.TIER_MULTIPLIER_RANGE.items()
    }
    return (
        F.when(tier == "Flagship", drawn["Flagship"])
        .when(tier == "Underperforming", drawn["Underperforming"])
        .otherwise(drawn["Average"])
    )


def store_tier(stores: DataFrame, position: str = "store_id") -> DataFrame:
    """Add ``performance_tier`` from a dense 1-based position."""
    total = stores.agg(F.count(F.lit(1))).scalar()
    return stores.withColumn("performance_tier", tier_of(F.col(position), total))


def store_attributes(stores: DataFrame, key: str = "store_id") -> DataFrame:
    """Add name, region, region weight and store type by position."""
    number = F.col(key)
    region = F.pmod(number - 1, F.lit(len(fv.REGIONS)))
    kind = F.pmod(F.floor((number - 1) / len(fv.REGIONS)), F.lit(len(fv.STORE_TYPES)))
    return stores.withColumns(
        {
            "store_name": padded_code("STORE-", number, 3),
            "region": by_position(region, fv.REGIONS),
            "region_weight": by_position(region, fv.REGION_WEIGHTS, "decimal(4,2)"),
            "store_type": by_position(kind, fv.STORE_TYPES),
        }
    )


# -- products ----------------------------------------------------------------


def product_attributes(products: DataFrame, key: str = "product_id") -> DataFrame:
    """Add sku, name, category, price tier, supplier and its base lead time by position."""
    number = F.col(key)
    slot = F.pmod(number - 1, F.lit(len(fv.CATEGORIES)))
    return products.withColumns(
        {
            "sku": padded_code("SKU-", number, 5),
            "product_name": F.concat(F.lit("Product "), number.cast("string")),
            "category": by_position(slot, fv.CATEGORIES),
            "subcategory": by_position(F.pmod(number - 1, F.lit(len(fv.SUBCATEGORIES))), fv.SUBCATEGORIES),
            "supplier": by_position(slot, [name for name, _ in fv.SUPPLIERS]),
            "base_lead_time": by_position(slot, [str(days) for _, days in fv.SUPPLIERS], "int"),
        }
    )


def popularity_multiplier(rank: Column) -> Column:
    """Hyperbolic fall-off by rank, three decimals."""
    curve = F.lit(fv.POPULARITY_TOP) / (F.lit(1.0) + F.lit(fv.POPULARITY_DECAY) * (rank - 1))
    return F.round(curve.cast("decimal(38,10)"), 3).cast("decimal(6,3)")


def popularity(products: DataFrame, key: str = "product_id") -> DataFrame:
    """Add a shuffled popularity rank and its multiplier; no global sort (see ``rank_by_draw``)."""
    drawn = products.withColumn("_draw", hash_draw(F.col(key), "popularity"))
    ranked = rank_by_draw(drawn, "_draw", key, "popularity_rank").drop("_draw")
    return ranked.withColumn("popularity_multiplier", popularity_multiplier(F.col("popularity_rank")))


def lead_time(products: DataFrame, base: str = "base_lead_time", key: str = "product_id") -> DataFrame:
    """Add ``lead_time_days``: base time stretched by 0.80 to 1.30, at least one day."""
    factor = draw_between(F.col(key), "lead", *fv.LEAD_FACTOR_PCT_RANGE)
    stretched = F.round(F.col(base) * factor / F.lit(100.0)).cast("int")
    return products.withColumn("lead_time_days", F.greatest(F.lit(1), stretched))


def unit_price(products: DataFrame, cost: str = "unit_cost", key: str = "product_id") -> DataFrame:
    """Add ``unit_price``: the cost marked up by 1.30 to 3.00, rounded to cents."""
    markup = (draw_between(F.col(key), "markup", *fv.MARKUP_PCT_RANGE) / F.lit(100.0)).cast("decimal(4,2)")
    return products.withColumn("unit_price", F.round(F.col(cost) * markup, 2).cast("decimal(18,2)"))


# -- promotions --------------------------------------------------------------


def promo_calendar(spark: SparkSession, as_of: dt.date | str | None = None) -> DataFrame:
    """Promotion days counted back from ``as_of``: 17 literal rows, so it always broadcasts."""
    rows = ", ".join(f"({days}, '{name}', {volume}BD, {discount}BD)" for days, name, volume, discount in fv.PROMOS)
    table = spark.sql(f"SELECT * FROM VALUES {rows} AS p(day_offset, promo_name, volume_multiplier, extra_discount)")
    return table.select(
        F.date_sub(F.lit(as_date(as_of)), F.col("day_offset")).alias("promo_date"),
        "promo_name",
        F.col("volume_multiplier").cast("decimal(3,1)").alias("volume_multiplier"),
        F.col("extra_discount").cast("decimal(4,2)").alias("extra_discount"),
    )


def promo_join(sales: DataFrame, promos: DataFrame) -> DataFrame:
    """Attach the promotion of the sale date; neutral values and a NULL name on ordinary days."""
    days = promos.select(
        F.col("promo_date").alias("sale_date"),
        "promo_name",
        F.col("volume_multiplier").alias("promo_volume_mult"),
        F.col("extra_discount").alias("promo_extra_discount"),
    )
    return sales.drop("promo_name").join(days, "sale_date", "left").withColumns(
        {
            "promo_volume_mult": F.coalesce("promo_volume_mult", F.lit("1.0").cast("decimal(3,1)")),
            "promo_extra_discount": F.coalesce("promo_extra_discount", F.lit("0.00").cast("decimal(4,2)")),
        }
    )


# -- sales -------------------------------------------------------------------


def trend_years(sales: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """Add ``years_elapsed`` since the start of the 730-day history."""
    days_ago = F.datediff(F.lit(as_date(as_of)), F.col("sale_date"))
    return sales.withColumn("years_elapsed", (F.lit(fv.HISTORY_DAYS - 1) - days_ago) / F.lit(365.0))


def final_units(sales: DataFrame) -> DataFrame:
    """Add ``final_units``: base units scaled by tier, popularity, weekday, trend and promotion.

    Needs units_sold, performance_multiplier, popularity_multiplier, annual_trend_pct, years_elapsed
    and promo_volume_mult.
    """
    weekday = F.when(is_weekend(F.col("sale_date")), float(fv.WEEKEND_FACTOR)).otherwise(float(fv.WEEKDAY_FACTOR))
    trend = F.lit(1.0) + F.col("annual_trend_pct").cast("double") / F.lit(100.0) * F.col("years_elapsed")
    scaled = (
        F.col("units_sold").cast("double")
        * F.col("performance_multiplier").cast("double")
        * F.col("popularity_multiplier").cast("double")
        * weekday
        * trend
        * F.col("promo_volume_mult").cast("double")
    )
    return sales.withColumn("final_units", F.greatest(F.lit(1), fixed(scaled, 0).cast("int")))


def discount_cap(sales: DataFrame) -> DataFrame:
    """Add ``final_discount_pct``: base plus promotion discount, never above the ceiling."""
    total = (F.col("discount_pct") + F.col("promo_extra_discount")).cast("decimal(5,2)")
    ceiling = F.lit(fv.DISCOUNT_CEILING).cast("decimal(5,2)")
    return sales.withColumn("final_discount_pct", F.least(ceiling, total))


def channel_of_store_type(sales: DataFrame, key: str = "sale_id") -> DataFrame:
    """Add ``drawn_channel``: Online when a draw falls below the share of the store type."""
    share = F.lit(0)
    for kinds, pct in fv.ONLINE_SHARE_PCT:
        share = F.when(F.col("store_type").isin(*kinds), pct).otherwise(share)
    online = hash_draw(F.col(key), "channel") * 100 < share.cast("long") * F.lit(DRAW_SIZE)
    return sales.withColumn("drawn_channel", F.when(online, "Online").otherwise("In-Store"))


def season_factor(day: Column) -> Column:
    factor = F.lit("1.00").cast("decimal(3,2)")
    for months, value in fv.SEASON_FACTORS:
        factor = F.when(F.month(day).isin(*months), F.lit(value).cast("decimal(3,2)")).otherwise(factor)
    return factor


def season_revenue(sales: DataFrame, units: str = "units_sold", discount: str = "discount_pct") -> DataFrame:
    """Add ``season_revenue``: units x price x (1 - discount) x month factor, in exact decimals."""
    kept = (F.lit(1).cast("decimal(4,2)") - F.col(discount)).cast("decimal(4,2)")
    gross = F.col(units).cast("decimal(10,0)") * F.col("unit_price").cast("decimal(18,2)")
    revenue = F.round(gross * kept * season_factor(F.col("sale_date")), 2)
    return sales.withColumn("season_revenue", revenue.cast("decimal(18,2)"))


# -- targets and shifts ------------------------------------------------------


def tier_targets(stores: DataFrame, as_of: dt.date | str | None = None) -> DataFrame:
    """Monthly targets per store, scaled by its multiplier."""
    months = spines.months(as_of, fv.TARGET_MONTHS)
    grid = spines.with_spine(stores.select("store_id", "performance_multiplier"), months, "period_month")
    key = F.concat_ws("-", "store_id", "period_month")
    revenue = draw_between(key, "target_revenue", *fv.TARGET_REVENUE_RANGE).cast("decimal(12,0)")
    units = draw_between(key, "target_units", *fv.TARGET_UNITS_RANGE)
    multiplier = F.col("performance_multiplier")
    return grid.select(
        "store_id",
        "period_month",
        F.round(multiplier * revenue, 2).cast("decimal(18,2)").alias("target_revenue"),
        F.round(multiplier * units.cast("decimal(12,0)"), 0).cast("long").alias("target_units"),
    )


def wage_band(region: Column, key: Column) -> Column:
    """Hourly wage drawn from the band of the region, two decimals."""
    wage = draw_decimal(key, "wage", *fv.WAGE_DEFAULT, places=2, precision=5)
    for name, band in fv.WAGE_BANDS.items():
        wage = F.when(region == name, draw_decimal(key, "wage", *band, places=2, precision=5)).otherwise(wage)
    return wage


def staffed_shifts(
    stores: DataFrame, as_of: dt.date | str | None = None, days: int = fv.HISTORY_DAYS
) -> DataFrame:
    """Shifts per store, day and type; headcount and hours follow weekday and store multiplier."""
    kept = stores.select("store_id", "region", "performance_multiplier")
    dated = spines.with_spine(kept, spines.days(as_of, days), "shift_date", "store_id", days * len(fv.SHIFT_TYPES))
    grid = spines.with_spine(dated, fixed_list(fv.SHIFT_TYPES), "shift_type")
    keyed = grid.withColumn("shift_id", F.concat_ws("-", "store_id", "shift_date", "shift_type"))
    key = F.col("shift_id")
    scale = F.sqrt(F.col("performance_multiplier").cast("double"))

    def staffed(salt: str, weekend: tuple[int, int], weekday: tuple[int, int], floor: int) -> Column:
        drawn = F.when(is_weekend(F.col("shift_date")), draw_between(key, salt, *weekend)).otherwise(
            draw_between(key, salt, *weekday)
        )
        return F.greatest(F.lit(floor), fixed(drawn.cast("double") * scale, 0).cast("int"))

    return keyed.select(
        "shift_id", "store_id", "shift_date", "shift_type",
        staffed("staff", fv.HEADCOUNT_WEEKEND, fv.HEADCOUNT_WEEKDAY, fv.HEADCOUNT_FLOOR).alias("headcount"),
        staffed("labor", fv.HOURS_WEEKEND, fv.HOURS_WEEKDAY, fv.HOURS_FLOOR).alias("hours_worked"),
        wage_band(F.col("region"), key).alias("hourly_wage"),
    )


# -- inventory ---------------------------------------------------------------


def stock_levels(snapshots: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Stock columns per snapshot: bestsellers run leaner, strong stores reorder earlier.

    Far down the ranks of a large catalog the popularity multiplier is 0.000.  A share of it has no value then: days of supply
    are NULL, and of units on hand only the floor of 0 is left.
    """
    pulls = products.select("product_id", F.col("popularity_multiplier").cast("double").alias("_pull"))
    tiers = stores.select("store_id", F.col("performance_multiplier").cast("double").alias("_tier"))
    keys = snapshots.select("snapshot_id", "store_id", "product_id", "snapshot_date")
    joined = join_dimension(join_dimension(keys, pulls, "product_id"), tiers, "store_id")
    key, pull = F.col("snapshot_id"), F.col("_pull")
    divisor = F.nullif(pull, F.lit(0.0))
    on_hand = draw_between(key, "stock", *fv.ON_HAND_RANGE).cast("double") / F.power(divisor, F.lit(fv.ON_HAND_POWER))
    reorder = draw_between(key, "threshold", *fv.REORDER_RANGE).cast("double") * F.sqrt("_tier")
    supply = draw_between(key, "cover", *fv.SUPPLY_DAYS_TENTHS_RANGE) / F.lit(10.0)
    on_order = draw_between(key, "incoming", *fv.ON_ORDER_RANGE).cast("double") * F.power(pull, F.lit(fv.ON_ORDER_POWER))
    return joined.select(
        "snapshot_id", "store_id", "product_id", "snapshot_date",
        F.greatest(F.lit(0), fixed(on_hand, 0).cast("int")).alias("units_on_hand"),
        fixed(reorder, 0).cast("int").alias("reorder_point"),
        fixed(supply / F.power(divisor, F.lit(fv.SUPPLY_DAYS_POWER)), 1).alias("days_of_supply"),
        F.greatest(F.lit(0), fixed(on_order, 0).cast("int")).alias("units_on_order"),
    )


# -- returns -----------------------------------------------------------------


def return_rate_pct(category: Column, channel: Column) -> Column:
    """Share of lines returned, in percent: by category, higher online; NULL for unknown categories."""
    rate = F.lit(None).cast("int")
    for name, pct in fv.RETURN_RATE_PCT.items():
        rate = F.when(category == name, pct).otherwise(rate)
    return rate + F.when(channel == "Online", fv.RETURN_ONLINE_UPLIFT_PCT).otherwise(0)


def sample_returns(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Keep a sale when its draw falls below its return rate."""
    priced = sales.join(products.select("product_id", "category"), "product_id")
    rate = return_rate_pct(F.col("category"), F.col("channel")).cast("long")
    return priced.where(hash_draw(F.col("sale_id"), "return") * 100 < rate * F.lit(DRAW_SIZE))


def return_details(sold: DataFrame) -> DataFrame:
    """Return rows for sampled sales: date 1 to 14 days later, a reason, 85 to 100 percent back."""
    key = F.col("sale_id")
    delay = draw_between(key, "delay", *fv.RETURN_DELAY_DAYS).cast("int")
    reason = by_position(draw_between(key, "reason", 0, len(fv.RETURN_REASONS) - 1), fv.RETURN_REASONS)
    share = (draw_between(key, "refund", *fv.REFUND_PCT_RANGE) / F.lit(100.0)).cast("decimal(4,2)")
    return sold.select(
        F.concat(F.lit("R-"), key).alias("return_id"),
        "sale_id", "store_id", "product_id", "sale_date",
        F.date_add(F.col("sale_date"), delay).alias("return_date"),
        reason.alias("return_reason"),
        F.round(F.col("revenue") * share, 2).cast("decimal(18,2)").alias("refund_amount"),
    )
