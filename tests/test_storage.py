import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opslens.functions.columns import day
from opslens.operators import freshness, layout
from opslens.sources import history, sinks, traces
from opslens.sources.retail import RetailTables
from opslens.streaming import refresh
from opslens.streaming import spans as live


def rows(df):
    return sorted(map(repr, df.collect()))


def test_depths_match_pairwise_counting(spark):
    rng = random.Random(5)
    files = [(f"f{i}", 1, 1, *sorted((rng.randrange(30), rng.randrange(30)))) for i in range(40)]
    table = spark.createDataFrame(files, "file string, bytes long, rows long, low int, high int")
    got = {r.file: r.depth for r in layout.overlap_depths(table).collect()}
    for f, _, _, low, high in files:
        assert got[f] == sum(lo <= high and hi >= low for _, _, _, lo, hi in files)


@pytest.fixture(scope="module")
def sales(spark, small):
    return RetailTables(spark, small, "2001-06-30").daily_sales(("sale_id", "store_id", "product_id", "sale_date", "revenue"))


def test_clustering_cuts_overlap_and_scans(spark, sales, tmp_path):
    loose, tight = str(tmp_path / "loose"), str(tmp_path / "tight")
    sales.repartition(8, "sale_id").write.parquet(loose)
    layout.cluster_write(sales, tight, ["sale_date", "store_id"], ["sale_id"], files=8)
    tables = {"loose": spark.read.parquet(loose), "tight": spark.read.parquet(tight)}
    assert rows(tables["loose"]) == rows(tables["tight"])
    depth = {r.table_name: r.average_depth for r in layout.overlap_report(tables, "sale_date").collect()}
    assert depth["loose"] == 8 and depth["tight"] < 3
    scan = {r.table_name: r for r in layout.scan_report(tables, "sale_date", dt.date(2000, 10, 1), dt.date(2000, 12, 31)).collect()}
    assert scan["loose"].files_read == 8 and scan["tight"].files_read <= 3
    one = layout.lookup_by_id(tables["tight"], sale_id="no such id")
    assert one.count() == 0
    assert "EqualTo(sale_id,no such id)" in one._jdf.queryExecution().executedPlan().toString()


def test_rows_sharing_all_keys_are_spread(spark, tmp_path):
    same = spark.range(1000).withColumn("region", F.lit("West"))
    layout.cluster_write(same, str(tmp_path / "t"), ["region"], files=4)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.select("_metadata.file_path").distinct().count() == 4 and stored.count() == 1000


def test_recluster_keeps_the_rows(spark, sales, tmp_path):
    path = str(tmp_path / "sales")
    sales.repartition(6, "sale_id").write.parquet(path)
    aside = layout.recluster(spark, path, ["sale_date"])
    assert rows(spark.read.parquet(path)) == rows(sales)
    assert spark.read.parquet(aside).count() == sales.count()
    again = layout.recluster(spark, path, ["store_id"])
    assert again != aside and rows(spark.read.parquet(path)) == rows(spark.read.parquet(again)) == rows(sales)


def test_lines_after_as_of_are_kept(spark, small):
    early = RetailTables(spark, small, "1995-01-01")
    assert early.daily_sales(("sale_id",)).count() == spark.read.parquet(f"{small}/lineitem.parquet").count()
    bounded = early.daily_sales(("sale_date",), first="2000-01-01", last="2000-12-31").agg(F.min("sale_date"), F.max("sale_date")).first()
    assert dt.date(2000, 1, 1) <= bounded[0] and bounded[1] <= dt.date(2000, 12, 31)


def test_streams_read_a_folder_like_a_file(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    from opslens.catalog import QUERIES

    for name in ("refresh_lag", "flatten_stream", "concurrency_stream", "turns_per_day_stream", "late_match"):
        assert rows(QUERIES[name](spark, str(tmp_path))) == rows(QUERIES[name](spark, small)) != []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        refresh.stream_files(spark, str(tmp_path), "nothing.parquet")


def test_freshness(spark):
    base = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("b", dt.date(2024, 1, 2)), ("b", dt.date(2024, 1, 2))], "trace_id string, event_date date")
    part = base.where(F.col("event_date") == day("2024-01-01"))
    assert [(str(r.event_date), r.base_rows) for r in freshness.missing_days(base, part).collect()] == [("2024-01-02", 2)]
    assert {(r.source, r.n, r["keys"], r.equal) for r in freshness.compare(part, base).collect()} == {("derived", 1, 1, False), ("base", 3, 2, False)}
    assert {r.equal for r in freshness.compare(base, base).collect()} == {True}
    now = F.lit("2024-01-03 01:00:00").cast("timestamp")
    got = freshness.status({"t": freshness.Watched(base, "event_date", 3600)}, now).first()
    assert (got.behind_s, got.late) == (90000, True)
    assert [r.matches for r in freshness.row_counts({"t": base, "u": part}, {"t": 3, "u": 9}).collect()] == [True, False]


@pytest.fixture()
def split_events(spark, small, tmp_path):
    """The events in two files, the second one later in time."""
    events = spark.read.parquet(f"{small}/events.parquet")
    cut = dt.datetime(2024, 1, 16)
    folder = tmp_path / "events"
    early, late = events.where(F.col("ts") < F.lit(cut)), events.where(F.col("ts") >= F.lit(cut))
    early.coalesce(1).write.parquet(str(folder))
    return str(folder), late, traces.spans_of(events), events


def test_stream_adds_only_what_is_new(spark, split_events, tmp_path):
    folder, late, spans, _ = split_events
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        return refresh.refresh_once(traces.spans_of(refresh.stream_files(spark, folder)), out, mark)

    first = run().count()
    assert 0 < first < spans.count()
    assert run().count() == first
    late.coalesce(1).write.mode("append").parquet(folder)
    assert rows(run()) == rows(spans)


def test_streamed_figures_equal_batch(spark, split_events, tmp_path):
    folder, late, spans, events = split_events
    late.coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return refresh.stream_files(spark, folder, files_per_trigger=1)

    days = live.turns_per_day(traces.spans_of(stream()), str(tmp_path / "d"), str(tmp_path / "dm"))
    want = spans.groupBy("event_date").agg(F.count_distinct("trace_id").alias("turns"))
    assert rows(days.select("event_date", "turns")) == rows(want)

    seconds = refresh.refresh_once(live.concurrency(traces.spans_of(stream())), str(tmp_path / "s"), str(tmp_path / "sm"))
    calls = spans.where("span_name = 'SqlExecution_SystemSQL'")
    last = calls.agg(F.max("start_ts")).first()[0] - dt.timedelta(minutes=10)
    batch = calls.groupBy(F.date_trunc("second", "start_ts").alias("sec")).agg(F.count(F.lit(1)).alias("sql_starts"))
    assert rows(seconds) == rows(batch.where(F.col("sec") + F.expr("interval 1 second") <= F.lit(last)))


def test_repeated_batch_is_counted_once(spark, tmp_path):
    batch = spark.createDataFrame([(dt.date(2024, 1, 1),)] * 3, "event_date date")
    write = live.daily_counts_writer(str(tmp_path / "c"))
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "c")).agg(F.sum("turns")).first()[0] == 3


def test_late_match_gives_up_after_the_bound(spark, split_events, tmp_path):
    folder, late, spans, events = split_events
    late.coalesce(1).write.mode("append").parquet(folder)
    calls = traces.spans_of(refresh.stream_files(spark, folder))
    arrived = history.history_of(refresh.stream_files(spark, folder))
    got = refresh.refresh_once(live.late_match(calls, arrived), str(tmp_path / "m"), str(tmp_path / "mm"))
    # rows come up to an hour late: those beyond 45 minutes find no partner
    known = history.history_of(events).select("query_id", "start_time")
    wanted = spans.where("span_name = 'SqlExecution_SystemSQL'").select("query_id", "start_ts")
    in_time = wanted.join(known, "query_id").where("start_time <= start_ts + INTERVAL 45 MINUTES").select("query_id")
    assert 0 < in_time.count() < wanted.join(known, "query_id").count()
    assert rows(got.where("arrived IS NOT NULL").select("query_id")) == rows(in_time)
    missed = got.where("arrived IS NULL").select("query_id")
    assert missed.count() > 0 and missed.join(in_time, "query_id", "left_semi").count() == 0


def test_work_folder_is_in_the_shared_folder(spark):
    assert sinks.work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_derived_columns_are_made_after_sorting(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 30).alias("day"), "id")
    made = lambda grid: grid.withColumn("twice", F.col("id") * 2)
    layout.cluster_write(rows, str(tmp_path / "t"), ["day"], files=5, derive=made)
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, made(rows).collect()))
    ends = layout.overlap_depths(layout.file_ranges(stored, "day")).agg(F.max("depth")).first()[0]
    assert ends <= 3  # itself and its two neighbours


def test_parts_grow_with_the_rows(spark):
    assert [layout.parts_for(spark.range(n), 100) for n in (0, 800, 801, 5000)] == [8, 8, 9, 50]


def test_a_spine_takes_more_tasks_on_more_rows(spark, monkeypatch):
    from opslens.sources import spines

    monkeypatch.setattr(spines, "ROWS_A_TASK", 100)
    grown = spines.with_spine(spark.range(100), spines.days("2001-06-30", 50), "day", "id", 50)
    assert grown.rdd.getNumPartitions() == 50 and grown.count() == 5000
