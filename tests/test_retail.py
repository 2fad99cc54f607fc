import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opslens.functions.periods import between
from opslens.operators import enrich, retail

D = dt.date


def stores(spark):
    rows = [(1, "S1", "West", "Mall", "Flagship", 100), (2, "S2", "South", "Mall", "Average", 50), (3, "S3", "West", "Rural", "Average", 10)]
    return spark.createDataFrame(rows, "store_id long, store_name string, region string, store_type string, performance_tier string, sq_ft int")


def products(spark):
    rows = [(1, "P1", "Home", "Acme", 4, 1), (2, "P2", "Food", "Acme", 5, 2), (3, "P3", "Home", "Slow", 30, 3)]
    return spark.createDataFrame(rows, "product_id long, product_name string, category string, supplier string, lead_time_days int, popularity_rank long")


def sales(spark):
    rows = [
        ("a", 1, 1, D(2001, 5, 2), 3, "Online", "10.00"),
        ("b", 1, 2, D(2001, 5, 31), 1, "In-Store", "30.00"),
        ("c", 2, 1, D(2001, 5, 1), 1, "In-Store", "40.00"),
        ("d", 2, 3, D(2001, 6, 1), 9, "In-Store", "500.00"),
    ]
    rows = [(*r[:6], Decimal(r[6])) for r in rows]
    return spark.createDataFrame(rows, "sale_id string, store_id long, product_id long, sale_date date, units_sold int, channel string, revenue decimal(18,2)")


def test_top_stores_ties_break_by_name(spark):
    got = retail.top_stores_by_revenue(sales(spark), stores(spark), "2001-06-30", 5).collect()
    assert [(r.store_name, float(r.total_revenue)) for r in got] == [("S1", 40.0), ("S2", 40.0)]


def test_staffing_keeps_stores_without_shifts_or_sales(spark):
    shifts = spark.createDataFrame([(1, D(2001, 5, 1), 8), (3, D(2001, 5, 1), 0)], "store_id long, shift_date date, hours_worked int")
    got = retail.staffing_vs_revenue(shifts, sales(spark), stores(spark), between("2001-05-01", "2001-06-30")).collect()
    # no hours: the ratio is NULL and NULL sorts first
    assert [(r.store_name, r.total_labor_hours, float(r.total_revenue), r.revenue_per_labor_hour) for r in got] == [
        ("S2", 0, 540.0, None),
        ("S3", 0, 0.0, None),
        ("S1", 8, 40.0, 5.0),
    ]


def test_two_returns_of_one_sale(spark):
    returns = spark.createDataFrame([("r1", "a"), ("r2", "a"), ("r3", "gone")], "return_id string, sale_id string")
    got = {r.category: r for r in retail.return_rate_by_category(sales(spark), returns, products(spark)).collect()}
    assert (got["Home"].return_count, got["Home"].transaction_count, got["Home"].return_rate_pct) == (2, 3, 66.67)
    assert (got["Food"].return_count, got["Food"].return_rate_pct) == (0, 0.0)


def test_labor_cost_without_sales_is_null(spark):
    shifts = spark.createDataFrame([(D(2001, 5, 1), 8, Decimal("20.00"))], "shift_date date, hours_worked int, hourly_wage decimal(5,2)")
    row = retail.labor_cost_pct(shifts, sales(spark).limit(0), between("2001-05-01", "2001-06-30")).first()
    assert (float(row.total_labor_cost), row.total_revenue, row.labor_cost_pct) == (160.0, None, None)


def test_inventory_alerts_latest_snapshot_only(spark):
    rows = [(1, 1, D(2001, 6, 1), 0, 50), (1, 1, D(2001, 6, 8), 10, 50), (3, 2, D(2001, 6, 8), 10, 90), (2, 2, D(2001, 6, 8), 0, 90), (1, 3, D(2001, 6, 8), 50, 50)]
    inv = spark.createDataFrame(rows, "store_id long, product_id long, snapshot_date date, units_on_hand int, reorder_point int")
    got = retail.inventory_alerts(inv, stores(spark), products(spark), "West").collect()
    assert [(r.store_name, r.product_name) for r in got] == [("S3", "P2"), ("S1", "P1")]
    lead = {r.supplier: (r.avg_lead_time_days, r.stockout_count) for r in retail.supplier_lead_vs_stockouts(inv, products(spark)).collect()}
    assert lead == {"Acme": (4.7, 3), "Slow": (30.0, 0)}


def test_top_products_and_concentration(spark):
    got = retail.top_products(sales(spark), products(spark), stores(spark), "West", 1).collect()
    assert [(r.product_name, r.total_units) for r in got] == [("P1", 3)]
    parts = {r.segment: float(r.total_revenue) for r in retail.product_concentration(sales(spark), products(spark), 0.34).collect()}
    assert parts == {"Top": 50.0, "Rest": 530.0}


def test_wow_drop(spark):
    got = retail.category_wow_drop(sales(spark), products(spark), 10).collect()
    assert [(r.category, str(r.week_start), r.wow_change_pct) for r in got] == [("Home", "2001-05-28", 900.0)]


def test_promo_join_is_neutral_off_promo(spark):
    promos = enrich.promo_calendar(spark, "2001-05-20")
    assert promos.count() == 17
    got = {r.sale_id: r for r in enrich.promo_join(sales(spark), promos).collect()}
    assert (got["a"].promo_name, float(got["a"].promo_volume_mult)) == ("Flash Sale", 2.2)
    assert (got["d"].promo_name, float(got["d"].promo_volume_mult), float(got["d"].promo_extra_discount)) == (None, 1.0, 0.0)


def test_discount_never_above_ceiling(spark):
    rows = spark.createDataFrame([(Decimal("0.50"), Decimal("0.25")), (Decimal("0.10"), Decimal("0.25"))], "discount_pct decimal(4,2), promo_extra_discount decimal(4,2)")
    assert [float(r.final_discount_pct) for r in enrich.discount_cap(rows).collect()] == [0.60, 0.35]


def test_codes_keep_long_numbers(spark):
    got = spark.createDataFrame([(7,), (12345,)], "n long").select(enrich.padded_code("S-", F.col("n"), 4).alias("v")).collect()
    assert [r.v for r in got] == ["S-0007", "S-12345"]


def test_tiers_by_share(spark):
    got = enrich.store_tier(spark.range(1, 51).withColumnRenamed("id", "store_id")).groupBy("performance_tier").count().collect()
    assert {r.performance_tier: r["count"] for r in got} == {"Flagship": 5, "Underperforming": 10, "Average": 35}


@pytest.mark.parametrize("rank,want", [(1, 3.0), (500, 0.3)])
def test_popularity_curve(spark, rank, want):
    assert float(spark.range(1).select(enrich.popularity_multiplier(F.lit(rank))).first()[0]) == want


def test_stock_of_a_product_without_pull_left(spark):
    held = spark.createDataFrame([("a", 1, 1, D(2001, 5, 2)), ("b", 1, 2, D(2001, 5, 2))], "snapshot_id string, store_id long, product_id long, snapshot_date date")
    stores_ = spark.createDataFrame([(1, Decimal("1.00"))], "store_id long, performance_multiplier decimal(4,2)")
    pulls = spark.createDataFrame([(1, Decimal("0.000")), (2, Decimal("0.001"))], "product_id long, popularity_multiplier decimal(6,3)")
    got = {r["product_id"]: r for r in enrich.stock_levels(held, stores_, pulls).collect()}
    assert (got[1]["units_on_hand"], got[1]["days_of_supply"], got[1]["units_on_order"]) == (0, None, 0)
    assert got[1]["reorder_point"] > 0 and got[2]["days_of_supply"] is not None
