import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslens.plans.query import Where, semantic_query
from opslens.plans.rollups import RollupStore

DAY = dt.date(2001, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    """Half of all lines in one store, a store without a row, one without a region, missing measures and days."""
    lines = [(1 if k % 2 else k % 5, k % 3, DAY + dt.timedelta(k % 40), k % 7, float(k) if k % 11 else None) for k in range(400)]
    lines += [(None, 1, None, None, 5.0), (99, 0, DAY, 3, 8.0)]
    sales = spark.createDataFrame(lines, "store_id long, product_id long, sale_date date, units_sold int, revenue double")
    sales = sales.withColumn("revenue", F.col("revenue").cast("decimal(18,2)")).withColumns({"sale_id": F.col("product_id"), "discount_pct": F.lit(0.1)})
    stores = spark.createDataFrame([(0, "West", "Mall"), (1, "East", "Mall"), (2, None, "Outlet"), (3, "West", None), (4, "East", "Outlet")], "store_id long, region string, store_type string")
    returns = spark.createDataFrame([(k, k % 6) for k in range(30)], "return_id long, store_id long")
    returns = returns.withColumn("refund_amount", F.lit(1.5))
    return {"daily_sales": sales, "stores": stores, "returns": returns, "products": spark.createDataFrame([(0, "Toys"), (1, None)], "product_id long, category string")}


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    made = RollupStore(spark, str(tmp_path_factory.mktemp("rollups")))
    assert made.rollups() == []
    sales = ["total_revenue", "total_units_sold", "daily_sales.avg_order_value"]
    made.build(tables, sales, ["region", "category", "daily_sales.sale_date"], "v1")
    made.build(tables, sales, ["region", "store_type"], "v1")
    made.build(tables, ["return_count"], ["region"], "v1")
    return made


METRICS = ["total_revenue", "total_units_sold", "avg_order_value"]
QUERIES = [
    (METRICS, [], []),
    (METRICS, ["region"], []),
    (METRICS, ["store_type", "region"], [Where("region", "East")]),
    (METRICS, ["category"], [Where("daily_sales.sale_date", lambda d: d >= F.lit(dt.date(2001, 1, 20)))]),
    (METRICS, ["region"], [Where("daily_sales.sale_date", lambda d: d.isNull())]),
    (METRICS, ["region"], [Where("region", "nowhere")]),
    (METRICS, [], [Where("region", "nowhere")]),
    (["total_revenue", "return_count"], ["region"], []),
]


@pytest.mark.parametrize("metrics, groups, where", QUERIES)
def test_a_rollup_gives_what_the_base_gives_and_only_the_rollup_is_read(tables, store, metrics, groups, where):
    got = store.query(tables, {"daily_sales": "v1", "returns": "v1"}, metrics, groups, where)
    assert rows(got) == rows(semantic_query(tables, metrics, groups, where))
    files = got.inputFiles()
    assert files and all(store.folder in f for f in files)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() or len(metrics) == 2


def test_the_smallest_rollup_that_covers(store):
    asked = ["total_revenue"]
    assert store.smallest("daily_sales", asked, ["stores.region"], "v1").dimensions == ("stores.region", "stores.store_type")
    assert "daily_sales.sale_date" in store.smallest("daily_sales", asked, ["daily_sales.sale_date"], "v1").dimensions
    assert store.smallest("daily_sales", asked, ["stores.store_name"], "v1") is None
    assert store.smallest("daily_sales", ["transaction_count"], [], "v1") is None


@pytest.mark.parametrize("versions", [{}, {"daily_sales": "v2"}])
def test_a_stale_rollup_is_refused(tables, store, versions):
    got = store.query(tables, versions, METRICS, ["region"])
    assert got.inputFiles() == []
    assert rows(got) == rows(semantic_query(tables, METRICS, ["region"]))


def test_a_condition_that_missing_values_meet_is_left_to_the_base(tables, store):
    where = [Where("region", lambda r: r.isNull())]
    got = store.query(tables, {"daily_sales": "v1"}, METRICS, ["store_type"], where)
    assert got.inputFiles() == []
    assert rows(got) == rows(semantic_query(tables, METRICS, ["store_type"], where))


def test_a_new_version_is_found_by_another_session(tables, store, spark):
    more = tables | {"returns": tables["returns"].unionAll(tables["returns"])}
    store.build(more, ["return_count"], ["region"], "v2")
    again = RollupStore(spark, store.folder)
    assert rows(again.query(more, {"returns": "v2"}, ["return_count"], ["region"])) == rows(semantic_query(more, ["return_count"], ["region"]))


def test_metrics_of_two_bases_make_no_rollup(tables, store):
    with pytest.raises(ValueError):
        store.build(tables, ["total_revenue", "return_count"], ["region"], "v1")
