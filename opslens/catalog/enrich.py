"""Catalog entries: retail enrichment rules over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.catalog.registry import entry
from opslens.catalog.retail import AS_OF, tables
from opslens.catalog.sqltext import (
    CTES,
    big,
    code,
    dbl,
    draw,
    draw_dec,
    draw_int,
    fix,
    multiplier,
    pick,
    popularity,
    tier,
    wage,
)
from opslens.operators import enrich

_A = f"DATE '{AS_OF}'"
_N = "(SELECT n FROM n_stores)"
_WEEKEND = "dayofweek({d}) IN (5, 6, 0)"


def _staffed(salt: str, weekend, weekday, floor: int) -> str:
    drawn = (
        f"CASE WHEN {_WEEKEND.format(d='shift_date')} THEN {draw_int('shift_id', salt, *weekend)} "
        f"ELSE {draw_int('shift_id', salt, *weekday)} END"
    )
    return f"greatest({floor}, CAST({fix(f'CAST({drawn} AS DOUBLE) * sqrt(CAST(performance_multiplier AS DOUBLE))', 0)} AS INTEGER))"


_RETURN_RATE = (
    "(CASE category "
    + " ".join(f"WHEN '{c}' THEN {p}" for c, p in fv.RETURN_RATE_PCT.items())
    + f" END + CASE WHEN channel = 'Online' THEN {fv.RETURN_ONLINE_UPLIFT_PCT} ELSE 0 END)"
)
_SHARE = (
    "CASE "
    + " ".join(f"WHEN store_type IN ({', '.join(repr(k) for k in kinds)}) THEN {pct}" for kinds, pct in fv.ONLINE_SHARE_PCT)
    + " ELSE 0 END"
)

CTES.update(
    {
        "sales_promo": """
        SELECT s.*, p.promo_name AS promo, COALESCE(volume_multiplier, 1.0) AS promo_volume_mult,
               COALESCE(extra_discount, 0.00) AS promo_extra_discount
        FROM sales_base s LEFT JOIN promo_calendar p ON promo_date = sale_date""",
        "sampled_sales": f"""
        SELECT s.*, category FROM sales_base s JOIN products_base USING (product_id)
        WHERE {draw('sale_id', 'return')} * 100 < {_RETURN_RATE} * 4294967296""",
    }
)

# -- stores ------------------------------------------------------------------


@entry("enrich_store_tier", f"SELECT store_id, {tier('store_id', _N)} AS performance_tier FROM stores_base")
def store_tier(spark, location):
    return enrich.store_tier(tables(spark, location).stores().select("store_id"))


@entry(
    "enrich_store_attrs",
    f"""
    SELECT store_id, {code('STORE-', 'store_id', 3)} AS store_name, {pick('((store_id - 1) % 5)', fv.REGIONS)} AS region,
           {dbl(pick('((store_id - 1) % 5)', fv.REGION_WEIGHTS, 'DECIMAL(4,2)'))} AS region_weight,
           {pick('((store_id - 1) // 5 % 5)', fv.STORE_TYPES)} AS store_type
    FROM stores_base""",
)
def store_attrs(spark, location):
    return enrich.store_attributes(tables(spark, location).stores().select("store_id"))


@entry(
    "enrich_tier_multiplier",
    f"SELECT store_id, performance_tier, {dbl(multiplier('performance_tier', 'store_id'))} AS performance_multiplier FROM stores_base",
)
def store_multiplier(spark, location):
    stores = tables(spark, location).stores().select("store_id", "performance_tier")
    return stores.withColumn("performance_multiplier", enrich.tier_multiplier(F.col("performance_tier"), F.col("store_id")))


# -- products ----------------------------------------------------------------


@entry(
    "enrich_product_attrs",
    f"""
    SELECT product_id, {code('SKU-', 'product_id', 5)} AS sku, 'Product ' || product_id AS product_name, category, subcategory,
           supplier, {pick('((product_id - 1) % 8)', [d for _, d in fv.SUPPLIERS], 'INTEGER')} AS base_lead_time
    FROM products_base""",
)
def product_attrs(spark, location):
    return enrich.product_attributes(tables(spark, location).products(ranked=False).select("product_id"))


@entry(
    "enrich_popularity",
    f"""
    SELECT product_id, popularity_rank, {dbl(popularity('popularity_rank'))} AS popularity_multiplier FROM products""",
)
def product_popularity(spark, location):
    return enrich.popularity(tables(spark, location).products(ranked=False).select("product_id"))


@entry(
    "enrich_lead_time",
    f"""
    SELECT product_id, base_lead_time,
           greatest(1, CAST(ROUND(base_lead_time * {draw_int('product_id', 'lead', *fv.LEAD_FACTOR_PCT_RANGE)} / 100.0) AS INTEGER)) AS lead_time_days
    FROM (SELECT product_id, {pick('((product_id - 1) % 8)', [d for _, d in fv.SUPPLIERS], 'INTEGER')} AS base_lead_time FROM products_base)""",
)
def product_lead_time(spark, location):
    products = enrich.product_attributes(tables(spark, location).products(ranked=False).select("product_id"))
    return enrich.lead_time(products).select("product_id", "base_lead_time", "lead_time_days")


@entry(
    "enrich_unit_price",
    f"""
    SELECT product_id, {dbl('unit_cost')} AS unit_cost,
           {dbl(f"ROUND(unit_cost * {draw_dec('product_id', 'markup', '1.30', '3.00', 2, 4)}, 2)")} AS unit_price
    FROM products_base""",
)
def product_price(spark, location):
    return enrich.unit_price(tables(spark, location).products(ranked=False).select("product_id", "unit_cost"))


# -- promotions --------------------------------------------------------------


@entry(
    "enrich_promo_calendar",
    f"""
    SELECT promo_date, p.promo_name, {dbl('volume_multiplier')} AS volume_multiplier, {dbl('extra_discount')} AS extra_discount,
           COUNT(sale_id) AS lines, {dbl('COALESCE(SUM(revenue), 0)')} AS revenue
    FROM promo_calendar p LEFT JOIN sales_base ON sale_date = promo_date GROUP BY ALL""",
)
def promo_calendar(spark, location):
    t = tables(spark, location)
    sold = (
        t.daily_sales(("sale_date", "revenue"))
        .groupBy("sale_date")
        .agg(F.count(F.lit(1)).alias("_lines"), F.sum("revenue").alias("_revenue"))
    )
    days = t.promo_calendar()
    return days.join(sold, F.col("promo_date") == F.col("sale_date"), "left").select(
        *days.columns,
        F.coalesce("_lines", F.lit(0)).alias("lines"),
        F.coalesce(F.col("_revenue").cast("double"), F.lit(0.0)).alias("revenue"),
    )


@entry(
    "enrich_promo_join",
    f"""
    SELECT sale_id, sale_date, promo AS promo_name, {dbl('promo_volume_mult')} AS promo_volume_mult,
           {dbl('promo_extra_discount')} AS promo_extra_discount FROM sales_promo""",
)
def promo_join(spark, location):
    t = tables(spark, location)
    return enrich.promo_join(t.daily_sales(("sale_id", "sale_date")), t.promo_calendar())


# -- sales -------------------------------------------------------------------


@entry("enrich_trend_years", f"SELECT sale_id, sale_date, (729 - date_diff('day', sale_date, {_A})) / CAST(365.0 AS DOUBLE) AS years_elapsed FROM sales_base")
def trend_years(spark, location):
    return enrich.trend_years(tables(spark, location).daily_sales(("sale_id", "sale_date")), AS_OF)


@entry(
    "enrich_units",
    f"""
    SELECT sale_id, units_sold, greatest(1, CAST({fix(f'''CAST(units_sold AS DOUBLE) * CAST(performance_multiplier AS DOUBLE)
               * CAST(popularity_multiplier AS DOUBLE) * CASE WHEN {_WEEKEND.format(d='sale_date')} THEN 1.25::DOUBLE ELSE 0.95::DOUBLE END
               * (1.0::DOUBLE + CAST(annual_trend_pct AS DOUBLE) / 100.0::DOUBLE * ((729 - date_diff('day', sale_date, {_A})) / 365.0::DOUBLE))
               * CAST(promo_volume_mult AS DOUBLE)''', 0)} AS INTEGER)) AS final_units
    FROM sales_promo JOIN stores USING (store_id) JOIN products USING (product_id)""",
)
def units(spark, location):
    t = tables(spark, location)
    sales = enrich.trend_years(t.daily_sales(("sale_id", "store_id", "product_id", "sale_date", "units_sold")), AS_OF)
    joined = (
        enrich.promo_join(sales, t.promo_calendar())
        .join(t.stores().select("store_id", "performance_multiplier", "annual_trend_pct"), "store_id")
        .join(t.products().select("product_id", "popularity_multiplier"), "product_id")
    )
    return enrich.final_units(joined).select("sale_id", "units_sold", "final_units")


@entry(
    "enrich_discount_cap",
    f"""
    SELECT sale_id, {dbl('discount_pct')} AS discount_pct, {dbl('promo_extra_discount')} AS promo_extra_discount,
           {dbl('least(0.60, discount_pct + promo_extra_discount)')} AS final_discount_pct FROM sales_promo""",
)
def discount_cap(spark, location):
    t = tables(spark, location)
    sales = enrich.promo_join(t.daily_sales(("sale_id", "sale_date", "discount_pct")), t.promo_calendar())
    return enrich.discount_cap(sales).select("sale_id", "discount_pct", "promo_extra_discount", "final_discount_pct")


@entry(
    "enrich_channel",
    f"""
    SELECT sale_id, store_type, CASE WHEN {draw('sale_id', 'channel')} * 100 < ({_SHARE}) * 4294967296 THEN 'Online' ELSE 'In-Store' END AS drawn_channel
    FROM sales_base JOIN stores_base USING (store_id)""",
)
def channel(spark, location):
    t = tables(spark, location)
    sales = t.daily_sales(("sale_id", "store_id")).join(t.stores().select("store_id", "store_type"), "store_id")
    return enrich.channel_of_store_type(sales).select("sale_id", "store_type", "drawn_channel")


@entry(
    "enrich_season_revenue",
    f"""
    SELECT sale_id, {dbl('''ROUND(units_sold * unit_price * CAST(1 - discount_pct AS DECIMAL(4,2))
               * CAST(CASE WHEN month(sale_date) IN (10, 11, 12) THEN 1.15 WHEN month(sale_date) IN (1, 2, 3) THEN 0.90 ELSE 1.00 END AS DECIMAL(3,2)), 2)''')} AS season_revenue
    FROM sales_base JOIN products_base USING (product_id)""",
)
def season_revenue(spark, location):
    t = tables(spark, location)
    sales = t.daily_sales(("sale_id", "product_id", "sale_date", "units_sold", "discount_pct"))
    priced = sales.join(t.products(ranked=False).select("product_id", "unit_price"), "product_id")
    return enrich.season_revenue(priced).select("sale_id", "season_revenue")


# -- targets and shifts ------------------------------------------------------

_TARGET_KEY = "(store_id || '-' || CAST(period_month AS VARCHAR))"


@entry(
    "enrich_targets",
    f"""
    SELECT store_id, period_month,
           {dbl(f"ROUND(performance_multiplier * CAST({draw_int(_TARGET_KEY, 'target_revenue', *fv.TARGET_REVENUE_RANGE)} AS DECIMAL(12,0)), 2)")} AS target_revenue,
           {big(f"ROUND(performance_multiplier * CAST({draw_int(_TARGET_KEY, 'target_units', *fv.TARGET_UNITS_RANGE)} AS DECIMAL(12,0)), 0)")} AS target_units
    FROM stores, months24""",
)
def targets(spark, location):
    return enrich.tier_targets(tables(spark, location).stores(), AS_OF)


_SHIFT_GRID = f"""(SELECT store_id || '-' || CAST(d AS VARCHAR) || '-' || t AS shift_id, store_id, d AS shift_date, t AS shift_type, region, performance_multiplier
    FROM stores, (VALUES ('Morning'), ('Afternoon'), ('Evening')) AS k(t),
         (SELECT CAST(unnest(generate_series({_A} - 729, {_A}, INTERVAL 1 DAY)) AS DATE) AS d))"""


@entry(
    "enrich_shifts",
    f"""
    SELECT shift_id, store_id, shift_date, shift_type, {_staffed('staff', fv.HEADCOUNT_WEEKEND, fv.HEADCOUNT_WEEKDAY, fv.HEADCOUNT_FLOOR)} AS headcount,
           {_staffed('labor', fv.HOURS_WEEKEND, fv.HOURS_WEEKDAY, fv.HOURS_FLOOR)} AS hours_worked
    FROM {_SHIFT_GRID}""",
)
def shifts(spark, location):
    return enrich.staffed_shifts(tables(spark, location).stores(), AS_OF).drop("hourly_wage")


@entry(
    "enrich_wage",
    f"""
    SELECT s.store_id, r.region, {dbl(wage('r.region', 's.store_id'))} AS hourly_wage
    FROM stores_base s JOIN (SELECT store_id, {pick('((store_id - 1) % 5)', fv.REGIONS)} AS region FROM stores_base) r ON r.store_id = s.store_id""",
)
def wages(spark, location):
    stores = enrich.store_attributes(tables(spark, location).stores().select("store_id"))
    return stores.select("store_id", "region", enrich.wage_band(F.col("region"), F.col("store_id")).alias("hourly_wage"))


# -- inventory and returns ---------------------------------------------------

_PULL = "CAST(popularity_multiplier AS DOUBLE)"


@entry(
    "enrich_inventory",
    f"""
    SELECT snapshot_id, store_id, product_id, snapshot_date,
           greatest(0, CAST({fix(f"CAST({draw_int('snapshot_id', 'stock', *fv.ON_HAND_RANGE)} AS DOUBLE) / pow({_PULL}, 0.6)", 0)} AS INTEGER)) AS units_on_hand,
           CAST({fix(f"CAST({draw_int('snapshot_id', 'threshold', *fv.REORDER_RANGE)} AS DOUBLE) * sqrt(CAST(performance_multiplier AS DOUBLE))", 0)} AS INTEGER) AS reorder_point,
           {fix(f"{draw_int('snapshot_id', 'cover', *fv.SUPPLY_DAYS_TENTHS_RANGE)} / 10.0::DOUBLE / pow({_PULL}, 0.4)", 1)} AS days_of_supply,
           greatest(0, CAST({fix(f"CAST({draw_int('snapshot_id', 'incoming', *fv.ON_ORDER_RANGE)} AS DOUBLE) * pow({_PULL}, 0.5)", 0)} AS INTEGER)) AS units_on_order
    FROM inventory JOIN stores USING (store_id) JOIN products USING (product_id)""",
)
def inventory(spark, location):
    t = tables(spark, location)
    return enrich.stock_levels(t.inventory(), t.stores(), t.products())


@entry("sample_returns", f"SELECT sale_id, store_id, product_id, sale_date, channel, {dbl('revenue')} AS revenue, category FROM sampled_sales")
def sample_returns(spark, location):
    t = tables(spark, location)
    columns = ("sale_id", "store_id", "product_id", "sale_date", "channel", "revenue")
    return enrich.sample_returns(t.daily_sales(columns), t.products(ranked=False))


@entry(
    "enrich_returns",
    f"""
    SELECT 'R-' || sale_id AS return_id, sale_id, store_id, product_id, sale_date,
           sale_date + CAST({draw_int('sale_id', 'delay', *fv.RETURN_DELAY_DAYS)} AS INTEGER) AS return_date,
           {pick(draw_int('sale_id', 'reason', 0, 4), fv.RETURN_REASONS)} AS return_reason,
           {dbl(f"ROUND(revenue * {draw_dec('sale_id', 'refund', '0.85', '1.00', 2, 4)}, 2)")} AS refund_amount
    FROM sampled_sales""",
)
def returns(spark, location):
    t = tables(spark, location)
    columns = ("sale_id", "store_id", "product_id", "sale_date", "channel", "revenue")
    return enrich.return_details(enrich.sample_returns(t.daily_sales(columns), t.products(ranked=False)))
