import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.functions import columns as c
from opslens.functions.periods import Period, period_range, quarters_in_window, totals_by_period
from opslens.functions.quantiles import percentiles
from opslens.functions.scans import carry_forward, number_rows, rank_by_draw


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hash_draw_is_md5(spark):
    want = int(hashlib.md5(b"abc|salt").hexdigest()[:8], 16)
    assert one(spark, c.hash_draw(F.lit("abc"), "salt")) == want


@pytest.mark.parametrize("num,den,places,want", [(285, 1000, 2, 0.29), (1, 0, 1, None), (1, None, 1, None), (49, 400, 1, 0.1), (-5, 2, 0, -3.0)])
def test_ratio(spark, num, den, places, want):
    assert one(spark, c.ratio(F.lit(num).cast("long"), F.lit(den).cast("long"), places)) == want


@pytest.mark.parametrize("text,want", [("12.7", 13), ("abc", None), ("12", 12), ("", None), (None, None), ("-0.5", -1), ("n/a", None)])
def test_whole_number(spark, text, want):
    assert one(spark, c.whole_number(F.lit(text).cast("string"))) == want


def test_millisecond_boundaries_are_counted(spark):
    first = F.lit("2024-01-01 00:00:00.000900").cast("timestamp")
    second = F.lit("2024-01-01 00:00:00.001100").cast("timestamp")
    assert one(spark, c.millis_between(first, second)) == 1


def test_attribute_keys_are_literal(spark):
    v = F.parse_json(F.lit('{"a.b": "dotted", "a": {"b": "nested"}, "x.0.y": 3}'))
    assert one(spark, c.attribute(v, "a.b")) == "dotted"
    assert one(spark, c.attribute(v, "x.0.y")) == "3"
    assert one(spark, c.attribute(v, "missing.key")) is None


def test_match_group_without_match_is_null(spark):
    assert one(spark, c.match_group(F.lit("no code"), r"error code (\d+)")) is None
    assert one(spark, c.match_group(F.lit("error code 000904: x"), r"error code (\d+)")) == "000904"


def test_weekend_is_friday_to_sunday(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(7)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", c.is_weekend(F.col("d")).alias("w")).collect()
    assert [r.w for r in sorted(rows)] == [False] * 4 + [True] * 3


@pytest.mark.parametrize(
    "name,start,end",
    [
        ("last month", "2001-05-01", "2001-06-01"),
        ("this month", "2001-06-01", "2001-07-01"),
        ("last quarter", "2001-01-01", "2001-04-01"),
        ("this quarter", "2001-04-01", "2001-07-01"),
        ("last 7 days", "2001-06-23", "2001-07-01"),
        ("last 30 days", "2001-05-31", "2001-07-01"),
        ("year to date", "2001-01-01", "2001-07-01"),
        ("last week", "2001-06-18", "2001-06-25"),
        ("Q4 2000", "2000-10-01", "2001-01-01"),
    ],
)
def test_periods(name, start, end):
    p = period_range(name, "2001-06-30")
    assert (str(p.start), str(p.end)) == (start, end)


def test_unknown_period():
    with pytest.raises(ValueError):
        period_range("next year", "2001-06-30")


def test_quarters():
    assert quarters_in_window("2000-08-11", "2001-02-01") == ["Q3 2000", "Q4 2000", "Q1 2001"]


def test_totals_by_period_counts_overlaps(spark):
    rows = spark.createDataFrame([(dt.date(2001, 1, i + 1), i) for i in range(10)], "d date, n int")
    a = Period("a", dt.date(2001, 1, 1), dt.date(2001, 1, 4))
    b = Period("b", dt.date(2001, 1, 3), dt.date(2001, 1, 6))
    got = {r.period: r.n for r in totals_by_period(rows, "d", [a, b], {"n": F.col("n")}).collect()}
    assert got == {"a": 0 + 1 + 2, "b": 2 + 3 + 4}


def test_percentiles_match_numpy(spark):
    rng = random.Random(1)
    data = [(rng.choice("aab"), rng.choice([None, rng.randint(0, 50)])) for _ in range(500)]
    rows = spark.createDataFrame(data, "g string, v int")
    got = percentiles(rows, {"p50": ("v", 0.5), "p95": ("v", 0.95)}, by=["g"], largest={"top": "v"}, count_as="n")
    for r in got.collect():
        values = [v for g, v in data if g == r.g and v is not None]
        assert r.p50 == pytest.approx(np.percentile(values, 50))
        assert r.p95 == pytest.approx(np.percentile(values, 95))
        assert (r.top, r.n) == (max(values), sum(g == r.g for g, _ in data))


def test_percentiles_of_nothing(spark):
    row = percentiles(spark.createDataFrame([], "v int"), {"p": ("v", 0.5)}, count_as="n").first()
    assert (row.p, row.n) == (None, 0)


def test_rank_by_draw_is_a_global_order(spark):
    rng = random.Random(2)
    data = [(i, rng.choice([5, 2**31, 2**32 - 1, rng.randrange(2**32)])) for i in range(300)]
    got = rank_by_draw(spark.createDataFrame(data, "id long, draw long"), "draw", "id", "place").collect()
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((d, i) for i, d in data))}
    assert {r.id: r.place for r in got} == want


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_carry_forward(spark, chunk):
    rng = random.Random(3)
    data = [(g, i, rng.choice([None, None, i * 10])) for g, n in (("hot", 40), ("cold", 5)) for i in range(n)]
    rows = spark.createDataFrame(data, "g string, i int, v int")
    got = {(r.g, r.i): r.prev for r in carry_forward(rows, ["g"], "i", F.col("v"), "prev", chunk).collect()}
    last = {}
    for g, i, v in data:
        assert got[(g, i)] == last.get(g)
        if v is not None:
            last[g] = v


def test_number_rows(spark):
    rng = random.Random(4)
    data = [(g, rng.randrange(50), i) for g, n in (("hot", 60), ("cold", 4)) for i in range(n)]
    rows = spark.createDataFrame(data, "g string, at int, id int")
    got = number_rows(rows, ["g"], "at", [F.asc("at"), F.desc("id")], "n", chunk=7).collect()
    for g in ("hot", "cold"):
        want = [(at, i) for at, i in sorted(((at, i) for h, at, i in data if h == g), key=lambda x: (x[0], -x[1]))]
        assert [(r.at, r.id) for r in sorted((r for r in got if r.g == g), key=lambda r: r.n)] == want


def test_a_dimension_of_joined_tables_is_as_large_as_they_are(spark, small):
    from opslens.functions.joins import estimated_bytes, stored_bytes
    from opslens.sources.retail import RetailTables

    stores = RetailTables(spark, small, "2001-06-30").stores()
    assert stored_bytes(stores) < 1_000_000 < estimated_bytes(stores)


def test_join_dimension_never_broadcasts_the_facts(spark):
    from opslens.functions.joins import join_dimension

    facts = spark.range(100).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("n"))
    small = spark.range(10)
    plan = join_dimension(facts, small, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    large = spark.range(10**8)
    plan = join_dimension(facts, large, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert join_dimension(facts, large, "id").count() == 100_000


def test_sql_values_are_bound(spark):
    from opslens.session import run_sql

    rows = spark.range(10)
    got = run_sql(spark, "SELECT id FROM {numbers} WHERE id >= :low ORDER BY id LIMIT :n", {"numbers": rows}, low=4, n=2)
    assert [r.id for r in got.collect()] == [4, 5]
