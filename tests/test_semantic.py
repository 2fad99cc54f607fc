import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslens.catalog.semantic import ModelTables
from opslens.operators import retail
from opslens.plans import asks, checks
from opslens.plans.query import UnknownName, Where, find_dimension, find_metric, join_path, semantic_query


@pytest.fixture(scope="module")
def tables(spark, small):
    return ModelTables(spark, small)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_names():
    assert find_metric("AOV").name == "avg_order_value"
    assert find_metric("Gross Revenue").name == "total_revenue"
    assert find_dimension("stores.REGION").name == "region"
    assert find_dimension("vendor").name == "supplier"
    for bad in ("target revenue fact", "revenue_fact", "products.region"):
        with pytest.raises(UnknownName):
            find_metric(bad)
    with pytest.raises(UnknownName):
        find_dimension("products.region")


def test_ambiguous_name():
    from dataclasses import replace

    from opslens.plans.model import RETAIL_MODEL, Dimension

    twice = replace(RETAIL_MODEL, dimensions=(*RETAIL_MODEL.dimensions, Dimension("products", "format")))
    assert find_dimension("format", twice).table == "products"  # a name goes before a synonym
    clash = replace(RETAIL_MODEL, dimensions=(*RETAIL_MODEL.dimensions, Dimension("products", "packing", ("format",))))
    with pytest.raises(UnknownName):
        find_dimension("format", clash)


def test_paths():
    assert [r.target for r in join_path("returns", "stores")] == ["stores"]
    with pytest.raises(UnknownName):
        join_path("staff_shifts", "products")


def test_unreachable_dimension(tables):
    with pytest.raises(UnknownName):
        semantic_query(tables, ["total_headcount"], ["category"])


def test_parity_with_the_written_query(tables):
    got = rows(semantic_query(tables, ["online_revenue_pct"], ["region"]).withColumn("online_revenue_pct", F.round("online_revenue_pct", 1)))
    assert got == rows(retail.online_penetration(tables["daily_sales"], tables["stores"]))


def test_grains_are_not_multiplied(tables):
    got = semantic_query(tables, ["total_revenue", "total_target_revenue", "return_count"]).first()
    assert got.total_revenue == tables["daily_sales"].agg(F.sum("revenue")).first()[0]
    assert got.total_target_revenue == tables["sales_targets"].agg(F.sum("target_revenue")).first()[0]
    assert got.return_count == tables["returns"].count()


def test_null_groups_meet(tables):
    got = {r.promo_name: r for r in semantic_query(tables, ["return_count", "transaction_count"], ["promo_name"]).collect()}
    assert None in got and got[None].return_count > 0
    assert sum(r.return_count for r in got.values()) == tables["returns"].count()
    assert sum(r.transaction_count for r in got.values()) == tables["daily_sales"].count()


def test_filters_on_both_sides(tables):
    day = dt.date(2000, 1, 1)
    got = rows(
        semantic_query(tables, ["total_units_sold"], ["category"], [Where("sale_date", lambda d: d >= F.lit(day)), Where("region", "ASIA")])
    )
    want = (
        tables["daily_sales"].where(F.col("sale_date") >= F.lit(day))
        .join(tables["stores"].where("region = 'ASIA'"), "store_id").join(tables["products"], "product_id")
        .groupBy("category").agg(F.sum("units_sold"))
    )
    assert got == rows(want)


def test_hot_store(spark, tables):
    hot = tables["daily_sales"].withColumn("store_id", F.when(F.col("sale_id").substr(-1, 1) < "5", 1).otherwise(F.col("store_id")))
    made = {"daily_sales": hot, "stores": tables["stores"]}
    want = hot.join(tables["stores"], "store_id").groupBy("region").agg(F.sum("revenue"))
    assert rows(semantic_query(made, ["total_revenue"], ["region"])) == rows(want)


def test_order_and_limit(tables):
    got = [r.total_revenue for r in semantic_query(tables, ["total_revenue"], ["store_name"], order_by=["-total_revenue"], limit=3).collect()]
    assert got == sorted(got, reverse=True) and len(got) == 3


def test_asks(tables):
    with pytest.raises(ValueError):
        asks.revenue_by(tables, "supplier", "last month", "2001-06-30")
    rate = asks.return_rate(tables, "Apparel").first()
    assert rate.return_rate_pct == round(rate.return_count * 100 / rate.transaction_count, 2)


def test_checks_find_edges(spark):
    stores = spark.createDataFrame([(1, "West", "Mall", "Average"), (1, "West", "Mall", None), (None, "Mars", "Mall", "Average")], "store_id long, region string, store_type string, performance_tier string")
    from opslens.plans.model import Dimension, Model, Relationship, Table

    model = Model(
        (Table("stores", ("store_id",)), Table("shifts", ("shift_id",))),
        (Relationship("shifts", "store_id", "stores", "store_id"),), (),
        (Dimension("stores", "region", (), ("West",), True), Dimension("stores", "performance_tier", (), ("Average",), True)), (),
    )
    shifts = spark.createDataFrame([(1, 1), (2, 9), (3, 9), (4, None)], "shift_id long, store_id long")
    made = {"stores": stores, "shifts": shifts}
    assert rows(checks.key_violations(made, model)) == [("shifts", 4, 0, 0, 0), ("stores", 3, 1, 1, 1)]
    assert rows(checks.orphans(made, model)) == [("shifts.store_id -> stores", 1, 2)]
    assert rows(checks.enum_violations(made, model)) == [("region", "Mars", 1)]
    assert rows(checks.enum_summary(made, model)) == [("performance_tier", 2, 0, 1), ("region", 2, 1, 0)]
