import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from opslens.functions import refine
from opslens.functions.joins import join_splitting_heavy_keys
from opslens.operators import fingerprints, identity, sketches, threads
from opslens.sources.sinks import work_folder
from opslens.streaming.merge import MergedTable
from opslens.streaming.refresh import stream_files

# --- id layout -----------------------------------------------------------------


@pytest.fixture(scope="module")
def keyed(spark):
    sales = spark.createDataFrame([(f"s{k % 900}", k % 7, float(k)) for k in range(1000)] + [(None, 1, 1.0)], "sale_id string, product_id long, revenue double")
    returns = spark.createDataFrame([(f"r{k}", f"s{k * 3}") for k in range(200)] + [("r0", "s0"), ("rx", "s9")] + [(f"h{k}", "s5") for k in range(300)], "return_id string, sale_id string")
    return identity.write_keyed({"sales": sales, "returns": returns}, "sale_id", "sale_key", 8), sales, returns


def test_a_lookup_opens_one_bucket(spark, keyed):
    tables, sales, _ = keyed
    found = identity.lookup_by_key(tables["sales"], "sale_key", tables.key_of("s17"))
    assert sorted(r["revenue"] for r in found.collect()) == [17.0, 917.0]
    assert tables.key_of("nobody") is None and tables["sales"].count() == sales.count()


def test_a_lookup_reads_no_other_file(spark):
    import os

    rows = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("sale_id"), "id")
    tables = identity.write_keyed({"sales": rows}, "sale_id", "sale_key", 8)
    stored = tables["sales"]
    place = stored.where("sale_id = 's77'").select(F.input_file_name()).first()[0].removeprefix("file://")
    others = [f.removeprefix("file://") for f in stored.inputFiles() if f.removeprefix("file://") != place]
    assert len(others) == 7
    for path in others:  # a query that opened one of them would fail
        os.rename(path, path + ".gone")
    found = identity.lookup_by_key(stored, "sale_key", tables.key_of("s77"))
    assert [r["id"] for r in found.collect()] == [77]


def test_joins_by_key_shuffle_no_sales(spark, keyed):
    tables, sales, returns = keyed
    path = work_folder(spark, "products")
    spark.createDataFrame([(k, "abc"[k % 3]) for k in range(7)], "product_id long, category string").write.parquet(path)
    products = spark.read.parquet(path)
    got = identity.return_rate_by_category(tables["sales"], tables["returns"], products)
    shuffles = identity.exchanges(got)
    assert shuffles and all("category" in x or "return_rate_pct" in x for x in shuffles)
    assert not [x for x in shuffles if "sale_key" in x]
    duck = duckdb.connect()
    for name, rows in (("sales", sales), ("returns", returns), ("products", products)):
        pandas = rows.toPandas()  # noqa: F841
        duck.execute(f"CREATE TABLE {name} AS SELECT * FROM pandas")
    expected = duck.execute("""
        SELECT category, COUNT(DISTINCT return_id), COUNT(DISTINCT s.sale_id) FROM sales s JOIN products USING (product_id)
        LEFT JOIN returns r ON r.sale_id = s.sale_id WHERE s.sale_id IS NOT NULL GROUP BY 1""").fetchall()
    assert {r["category"]: (r["return_count"], r["transaction_count"]) for r in got.where("transaction_count > 0").collect()}.keys() == {"a", "b", "c"}
    held = sales.where("sale_id is not null")
    clean = identity.write_keyed({"sales": held, "returns": returns}, "sale_id", "sale_key", 4)
    got = identity.return_rate_by_category(clean["sales"], clean["returns"], products).collect()
    assert sorted((r["category"], r["return_count"], r["transaction_count"]) for r in got) == sorted(expected)


# --- merged refresh ------------------------------------------------------------

SCHEMA = "id string, version int, day string, amount long"


def merged(spark):
    by_day = lambda rows: rows.groupBy("day").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    return MergedTable(spark, work_folder(spark, "merged"), SCHEMA, "id", "version", "day", by_day)


def rebuilt(rows):
    """Current rows by key, summed by day."""
    now = {}
    for at, (key, version, day, amount) in rows:
        if key is not None and day is not None:
            now[key] = max(now.get(key, (version, at, day, amount)), (version, at, day, amount))
    out = {}
    for _, _, day, amount in now.values():
        total, n = out.get(day, (0, 0))
        out[day] = total + amount, n + 1
    return out


def days(table):
    return {r["day"]: (r["amount"], r["n"]) for r in table.read().collect()}


def test_merges_equal_a_rebuild(spark):
    rng = random.Random(4)
    table, seen = merged(spark), []
    for batch in range(5):
        rows = [(f"k{rng.randrange(40)}", rng.randrange(6), f"d{rng.randrange(5)}", rng.randrange(100)) for _ in range(30)]
        rows += [(None, 1, "d0", 5), ("lost", 1, None, 5)]
        if batch == 2:
            rows += [("once", 1, "only", 7)]
        if batch == 4:
            rows += [("once", 2, "d1", 8)] + [("hot", v, f"d{v % 3}", v) for v in range(50)]
        # of equal versions of one batch the largest row counts: keep one of each here
        rows = list({(r[0], r[1]): r for r in rows}.values())
        seen += [(batch, r) for r in rows]
        frame = spark.createDataFrame(rows, SCHEMA)
        table.apply(frame, batch)
        assert days(table) == rebuilt(seen)
        table.apply(frame, batch)  # a batch that comes twice
        assert days(table) == rebuilt(seen)
    assert "only" not in days(table)  # its last row moved away
    assert sorted(r["batch_id"] for r in table.ledger().collect()) == [0, 1, 2, 3, 4]


def test_a_run_that_stopped_is_finished_by_the_next(spark, monkeypatch):
    table = merged(spark)
    table.apply(spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 2)], SCHEMA), 0)
    second = spark.createDataFrame([("a", 2, "y", 5)], SCHEMA)
    real = MergedTable._replace

    def stops(self, rows, part, *by):
        if part == "table":
            raise RuntimeError("lost")
        real(self, rows, part, *by)

    monkeypatch.setattr(MergedTable, "_replace", stops)
    with pytest.raises(RuntimeError):
        table.apply(second, 1)
    monkeypatch.setattr(MergedTable, "_replace", real)
    assert days(table) == {"x": (1, 1), "y": (2, 1)}
    table.apply(second, 1)
    assert days(table) == {"y": (7, 2)}


def test_only_touched_partitions_are_written(spark):
    import glob
    import os

    table = merged(spark)
    table.apply(spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 2)], SCHEMA), 0)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{table.folder}/table/day=x/*.parquet")}
    table.apply(spark.createDataFrame([("b", 2, "y", 3)], SCHEMA), 1)
    assert before and before == {f: os.path.getmtime(f) for f in glob.glob(f"{table.folder}/table/day=x/*.parquet")}
    assert days(table) == {"x": (1, 1), "y": (3, 1)}


def test_a_stream_is_merged_batch_by_batch(spark):
    table = merged(spark)
    for k, rows in enumerate([[("a", 1, "x", 1)], [("a", 3, "y", 9), ("b", 1, "x", 4)], [("a", 2, "x", 5)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{table.folder}/feed")
    for _ in range(2):  # nothing new the second time
        table.run(stream_files(spark, f"{table.folder}/feed", files_per_trigger=1), f"{table.folder}/checkpoint")
        assert days(table) == {"y": (9, 1), "x": (4, 1)}
    assert table.ledger().count() >= 3


# --- threads -------------------------------------------------------------------


def chains(spark, rows, **settings):
    frame = spark.createDataFrame(rows, "message_id string, parent_message_id string, state string, to string")
    return {r["message_id"]: (r["root_message_id"], r["depth"], r["state"]) for r in threads.reply_chains(frame, **settings).collect()}


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    written = []
    real = threads.create_table_as
    monkeypatch.setattr(threads, "create_table_as", lambda rows, path: written.append(path) or real(rows, path))
    n = 10_000
    got = chains(spark, [(f"m{k}", f"m{k - 1}" if k else None, "", "") for k in range(n)])
    assert got == {f"m{k}": ("m0", k, "rooted") for k in range(n)}
    assert len(written) <= 2 + 15


@pytest.mark.parametrize("heavy", [5, 100_000])
def test_roots_orphans_circles_and_crowds(spark, heavy):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("o", "gone"), ("p", "o"), ("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self")]
    rows += [(None, "a"), ("twice", "c"), ("twice", "b"), ("either", None), ("either", "a")] + [(f"k{k}", "b") for k in range(400)]
    got = chains(spark, [(*r, "", "") for r in rows], heavy=heavy)
    expected = {"a": ("a", 0, "rooted"), "b": ("a", 1, "rooted"), "c": ("a", 2, "rooted"), "o": ("o", 0, "orphaned"), "p": ("o", 1, "orphaned")}
    expected |= {c: (None, None, "cyclic") for c in ("x", "y", "z", "into", "self")}
    expected |= {"twice": ("a", 2, "rooted"), "either": ("a", 1, "rooted")} | {f"k{k}": ("a", 2, "rooted") for k in range(400)}
    assert got == expected
    assert chains(spark, []) == {}


def test_heavy_keys_are_joined_by_broadcast(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, F.lit(1)).when(F.col("id") < 990, F.col("id")).alias("k"), "id")
    lookup = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = join_splitting_heavy_keys(rows, lookup, "k", at_least=100)
    assert sorted((r["id"], r["v"]) for r in got.collect() if r["k"] is not None) == [(k, 2 if k < 600 else 2 * k) for k in range(990)]
    assert got.count() == 1000


# --- fingerprints --------------------------------------------------------------


def test_one_altered_row_is_found_in_its_partition(spark):
    rows = [(f"d{k % 5}", k, None if k % 7 == 0 else k * 1.5, "x" * (k % 3)) for k in range(500)]
    schema = "day string, id long, v double, t string"
    base = spark.createDataFrame(rows, schema)
    same = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), schema)
    marks = fingerprints.fingerprints(base, "day")
    assert fingerprints.differing_partitions(fingerprints.fingerprints(same, "day"), marks, "day").collect() == []
    changed = [(d, i, 0.25 if i == 123 else v, t) for d, i, v, t in rows]
    path = work_folder(spark, "derived")
    spark.createDataFrame(changed, schema).write.partitionBy("day").parquet(path)
    derived = spark.read.parquet(path).select("day", "id", "v", "t")
    parts = fingerprints.differing_partitions(fingerprints.fingerprints(derived, "day"), marks, "day")
    assert [tuple(r) for r in parts.collect()] == [("d3", 100, 100)]
    found = fingerprints.differing_rows(derived, base, "day", parts)
    assert sorted((r["id"], r["v"], r["surplus"]) for r in found.collect()) == [(123, 0.25, 1), (123, 184.5, -1)]
    filters = re.findall(r"PartitionFilters: \[[^\n]*", found._jdf.queryExecution().executedPlan().toString())
    assert any("d3" in f for f in filters)


def test_nulls_places_and_repeats_change_a_fingerprint(spark):
    def mark(rows):
        return {tuple(r) for r in fingerprints.fingerprints(spark.createDataFrame(rows, "p int, a string, b string"), "p").collect()}

    assert mark([(1, None, "x")]) != mark([(1, "x", None)])
    assert mark([(1, "a", "b")] * 2) != mark([(1, "a", "b")])
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a"), (None, "b")], "p int, a string"), "p")
    two = fingerprints.fingerprints(spark.createDataFrame([(1, "a"), (2, "c")], "p int, a string"), "p")
    assert {tuple(r) for r in fingerprints.differing_partitions(one, two, "p").collect()} == {(None, 1, 0), (2, 0, 1)}


# --- stored sketches -----------------------------------------------------------


def test_stored_quantiles_are_within_the_rank_error(spark):
    rnd = random.Random(2)
    # one day holds most rows; nulls and NaN are left out
    rows = [("d0" if k % 3 else f"d{k % 7}", rnd.gauss(0, 1)) for k in range(20_000)] + [("d0", None), ("d9", None), ("d1", float("nan"))]
    frame = spark.createDataFrame(rows, "day string, v double")
    values = sorted(v for _, v in rows if v is not None and v == v)
    days = sketches.quantile_sketches(frame, "v", ("day",), k=400)
    (got,) = sketches.window_quantiles(days, {"p50": 0.5, "p99": 0.99}, k=400).collect()
    assert (got["n"], got["least"], got["largest"]) == (len(values), values[0], values[-1])
    for name, p in (("p50", 0.5), ("p99", 0.99)):
        rank = sum(v <= got[name] for v in values) / len(values)
        assert abs(rank - p) < 0.02
    assert sketches.window_quantiles(days.where("day = 'none'"), {"p": 0.5}).collect() == []


def test_stored_sets_unite_and_intersect(spark):
    import datetime as dt

    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=k % 21), f"u{k % (50 + k % 21)}", None) for k in range(6000)]
    frame = spark.createDataFrame(rows, "day date, who string, nobody string")
    days = sketches.distinct_sketches(frame, ("who", "nobody"), ("day",))
    weeks = sketches.merged_sets(days, ("who", "nobody"), F.trunc("day", "week"), "week")
    got = {r["week"]: r for r in sketches.with_returning(weeks, ("who", "nobody"), "week", F.date_sub("week", 7)).collect()}
    sets = {}
    for day, who, _ in rows:
        sets.setdefault(day - dt.timedelta(days=day.weekday()), set()).add(who)
    assert set(got) == set(sets)
    for week, held in sets.items():
        before = sets.get(week - dt.timedelta(days=7), set())
        assert (got[week]["distinct_who"], got[week]["returning_who"]) == (len(held), len(held & before))
        assert (got[week]["distinct_nobody"], got[week]["returning_nobody"]) == (0, 0)


# --- refined quantiles ---------------------------------------------------------


def interpolated(values, p):
    held = sorted(values)
    at = p * (len(held) - 1)
    low = int(at)
    high = min(low + 1, len(held) - 1)
    return held[low] * (1 - (at - low)) + held[high] * (at - low)


@pytest.mark.parametrize("kind", ["distinct", "tied", "skewed"])
def test_refined_quantiles_are_exact(spark, kind):
    rnd = random.Random(8)
    make = {"distinct": lambda: rnd.gauss(0, 5), "tied": lambda: rnd.choice([1.0, 1.0, rnd.random()]), "skewed": lambda: 10 ** rnd.uniform(-200, 200)}
    values = [make[kind]() for _ in range(20_000)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(6).cache()
    shares = (0.0, 0.01, 0.5, 0.999, 1.0)
    got = refine.exact_quantiles(frame, "v", shares, bound=50, accuracy=100)
    for p in shares:
        assert got[p] == pytest.approx(interpolated(values, p), rel=1e-12)
    frame.unpersist()


def test_refined_quantiles_of_few_and_no_values(spark):
    frame = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert refine.exact_quantiles(frame, "v", (0.5,)) == {0.5: None}
    assert refine.exact_quantiles(spark.createDataFrame([(3.5,)], "v double"), "v", (0.0, 0.5, 1.0), bound=0) == {0.0: 3.5, 0.5: 3.5, 1.0: 3.5}
    same = spark.createDataFrame([(float("inf"),)] * 40, "v double")
    assert refine.exact_quantiles(same, "v", (0.3,), bound=5) == {0.3: float("inf")}


# --- stored days, exact --------------------------------------------------------


def test_counted_quantiles_are_exact_beyond_any_sketch(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("2024-01-0"), F.col("id") % 3 + 1).cast("date").alias("day"), (F.col("id") * 7919 % 60_000).alias("v"))
    odd = spark.createDataFrame([("2024-01-01", None), ("2024-01-02", None)], "day string, v long").select(F.col("day").cast("date"), "v")
    days = sketches.value_counts(rows.union(odd), "v", ("day",)).withColumn("week", F.trunc("day", "week"))
    (got,) = sketches.counted_quantiles(days, "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, ("week",)).collect()
    assert (got["n"], got["least"], got["largest"]) == (60_000, 0.0, 59_999.0)
    assert (got["p0"], got["p50"], got["p95"], got["p100"]) == (0.0, 29_999.0, 56_999.0, 59_999.0)


def test_stored_members_are_exact_beyond_any_sketch(spark):
    first = spark.range(200_001).select(F.lit("2024-01-02").cast("date").alias("day"), F.col("id").alias("who"), F.lit(None).cast("string").alias("nobody"))
    second = spark.range(100_000, 270_000).select(F.lit("2024-01-09").cast("date").alias("day"), F.col("id").alias("who"), F.lit("x").alias("nobody"))
    days = sketches.day_members(first.union(second), ("who", "nobody"), ("day",))
    got = {str(r["week"]): r[1:] for r in sketches.members_returning(days, ("who", "nobody"), F.trunc("day", "week"), "week", F.date_add("week", 7)).collect()}
    assert got == {"2024-01-01": (200_001, 0, 0, 0), "2024-01-08": (170_000, 1, 100_001, 0)}


# --- growth --------------------------------------------------------------------


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(identity, "IDS_A_BUCKET", 50)
    rows = spark.range(1001).select(F.concat(F.lit("s"), "id").alias("sale_id"), "id")
    tables = identity.write_keyed({"sales": rows}, "sale_id", "sale_key")
    assert len(tables["sales"].inputFiles()) == 21 and tables["sales"].count() == 1001


def test_a_feed_is_written_by_all_tasks(spark, small, monkeypatch):
    import glob

    from opslens.catalog import derived

    seen = []

    def run(self, stream, checkpoint):
        seen.append(len(glob.glob(f"{self.folder}/feed/*.parquet".removeprefix("file://"))))
        return self.spark.createDataFrame([], "sale_month date, store_id long, revenue long, units long")

    monkeypatch.setattr(MergedTable, "run", run)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        derived.refresh_merge(spark, small)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen == [4, 8]  # the session's four shuffle partitions, for each part


def test_a_merge_writes_few_files_a_partition(spark):
    import glob

    table = merged(spark)
    rows = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(1).alias("version"), F.concat(F.lit("d"), F.col("id") % 3).alias("day"), F.lit(1).alias("amount"))
    table.apply(rows.repartition(12), 0)
    assert len(glob.glob(f"{table.folder}/versions/*/*/*.parquet")) == 3
    assert sum(n for _, n in days(table).values()) == 4000
