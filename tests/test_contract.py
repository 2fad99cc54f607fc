import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import compare
from opslens import catalog

QUERIES = catalog.QUERIES
ORACLES = catalog.oracles()
# these write tables while the query is built, so building all plans would run them all
WRITERS = re.compile(r"^(sink|layout|lookup|src_turnlog|refresh_lag|late_match)|_stream$")


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, duck, name):
    frame = QUERIES[name](spark, small)
    rows = [tuple(r) for r in frame.collect()]
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert compare(frame.columns, rows, columns, cursor.fetchall()) == ""
    else:
        assert rows


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).columns == ["region", "actual_revenue", "target_revenue", "attainment_pct"]


def physical(spark, small, name):
    return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not WRITERS.search(n)])
def test_no_pairing_of_everything_and_no_python_rows(spark, small, name):
    plan = physical(spark, small, name)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan


NO_CHANNEL = (
    "sem_query", "sem_query_multi_grain", "sem_check_pk", "sem_check_fk", "met_total_revenue", "met_total_units_sold", "met_avg_discount_pct",
    "met_avg_order_value", "ask_revenue_by", "ask_target_attainment", "ask_staffing_vs_revenue", "ask_top_products", "ask_compare",
)


@pytest.mark.parametrize("name", NO_CHANNEL)
def test_orders_are_read_for_returns_only(spark, small, name):
    plan = physical(spark, small, name)
    returns = {"sem_query_multi_grain": 1, "sem_check_pk": 1, "sem_check_fk": 3}.get(name, 0)
    assert len(re.findall(r"Scan parquet .*/orders.parquet|ReadSchema: struct<o_orderkey", plan)) <= 2 * returns


def test_entry_works_without_the_training_data_modules(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(contract.queries()) == set(QUERIES) and set(contract.oracle_sql()) == set(ORACLES)


def test_scans_read_only_what_is_asked(spark, small):
    plan = physical(spark, small, "vq_regional_revenue")
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(l_shipdate,2000" in plan
    assert "LessThan(l_shipdate,2001-01-01T00:00)" in plan
    assert "o_orderkey" not in plan


def test_top_k_needs_no_full_sort(spark, small):
    for name in ("vq_top_stores_by_revenue", "top_questions", "turn_picker"):
        assert "TakeOrderedAndProject" in physical(spark, small, name)
