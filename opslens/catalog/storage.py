"""Catalog entries: sources, sinks, layout, freshness and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.catalog.registry import entry
from opslens.catalog.retail import AS_OF, tables
from opslens.catalog.sqltext import big, dbl, quote
from opslens.catalog.turnlog import _SUMMARY
from opslens.operators import freshness, layout, turnlog as turns
from opslens.operators import spans as flat
from opslens.sources import history, sinks, spines, traces
from opslens.sources import turnlog as turn_source
from opslens.sources.tables import parse_attributes, read_table, read_turn_log
from opslens.streaming import refresh
from opslens.streaming import spans as live

_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
_A = f"DATE '{AS_OF}'"

# -- sources -----------------------------------------------------------------


@entry("src_table", " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in _TABLES))
def src_table(spark, location):
    found = [
        read_table(spark, location, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t in _TABLES
    ]
    result = found[0]
    for rows in found[1:]:
        result = result.unionAll(rows)
    return result


_SUPPLIER_ROWS = ", ".join(f"({i}, {quote(n)}, {d})" for i, (n, d) in enumerate(fv.SUPPLIERS))


@entry(
    "src_values",
    f"""
    SELECT v.supplier, v.base_lead_time, COUNT(*) AS products
    FROM part JOIN (VALUES {_SUPPLIER_ROWS}) AS v(slot, supplier, base_lead_time) ON slot = p_partkey % 8
    GROUP BY ALL""",
)
def src_values(spark, location):
    inline = spark.sql(f"SELECT * FROM VALUES {_SUPPLIER_ROWS} AS v(slot, supplier, base_lead_time)")
    per_slot = read_table(spark, location, "part").groupBy((F.col("p_partkey") % 8).cast("int").alias("slot")).agg(
        F.count(F.lit(1)).alias("products")
    )
    return per_slot.join(inline, "slot").select("supplier", "base_lead_time", "products")


@entry(
    "src_spine_month",
    f"""
    SELECT period_month, COUNT(sale_id) AS lines, {dbl('COALESCE(SUM(revenue), 0)')} AS revenue
    FROM months24 LEFT JOIN sales_base ON DATE_TRUNC('month', sale_date) = period_month GROUP BY period_month""",
)
def src_spine_month(spark, location):
    return spines.monthly_totals(tables(spark, location).daily_sales(("sale_date", "revenue"), first="1999-07-01"), AS_OF)


@entry(
    "src_spine_day",
    f"""
    SELECT g.store_id, g.sale_date, COUNT(sale_id) AS lines, {dbl('COALESCE(SUM(revenue), 0)')} AS revenue
    FROM (SELECT store_id, CAST(unnest(generate_series({_A} - 729, {_A}, INTERVAL 1 DAY)) AS DATE) AS sale_date FROM stores_base) g
    LEFT JOIN sales_base s ON s.store_id = g.store_id AND s.sale_date = g.sale_date GROUP BY ALL""",
)
def src_spine_day(spark, location):
    t = tables(spark, location)
    first = dt.date.fromisoformat(AS_OF) - dt.timedelta(days=729)
    return spines.daily_totals_per_store(t.stores(), t.daily_sales(("store_id", "sale_date", "revenue"), first=first), AS_OF)


@entry(
    "src_spine_week",
    f"""
    SELECT g.snapshot_date, COUNT(snapshot_id) AS snapshots, {big('COALESCE(SUM(units_on_hand), 0)')} AS units_on_hand
    FROM (SELECT CAST(unnest(generate_series({_A} - 721, {_A}, INTERVAL 7 DAY)) AS DATE) AS snapshot_date) g
    LEFT JOIN inventory i ON i.snapshot_date = g.snapshot_date GROUP BY g.snapshot_date""",
)
def src_spine_week(spark, location):
    return spines.weekly_counts(tables(spark, location).inventory(), AS_OF)


_WINDOW = ("1999-07-02", AS_OF)


@entry(
    "src_spine_quarter",
    f"""
    SELECT 'Q' || quarter(quarter_start) || ' ' || year(quarter_start) AS quarter, quarter_start,
           CAST(quarter_start + INTERVAL 3 MONTH AS DATE) AS quarter_end, COUNT(sale_id) AS lines, {dbl('COALESCE(SUM(revenue), 0)')} AS revenue
    FROM (SELECT CAST(unnest(generate_series(DATE '1999-07-01', DATE '2001-04-01', INTERVAL 3 MONTH)) AS DATE) AS quarter_start)
    LEFT JOIN sales_base ON DATE_TRUNC('quarter', sale_date) = quarter_start AND sale_date BETWEEN DATE '{_WINDOW[0]}' AND DATE '{_WINDOW[1]}'
    GROUP BY quarter_start""",
)
def src_spine_quarter(spark, location):
    return spines.quarterly_totals(tables(spark, location).daily_sales(("sale_date", "revenue"), first=_WINDOW[0]), *_WINDOW)


@entry(
    "src_events_variant",
    """
    SELECT span_name, COUNT(*) AS n, COUNT(query_id) AS with_query, COUNT(question) AS with_question
    FROM all_spans GROUP BY span_name""",
)
def src_events_variant(spark, location):
    rows = flat.span_view(traces.raw_events(spark, location))
    return rows.groupBy("span_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("query_id").alias("with_query"), F.count("question").alias("with_question")
    )


_LOG_SUMS = f"""
    SELECT COALESCE(tier, 'unknown') AS tier, COUNT(*) AS turns, {big('SUM(sql_tool_uses)')} AS sql_calls, {big('SUM(least(id_count, 3))')} AS query_ids,
           {big('SUM(answer_chars)')} AS answer_chars, COUNT(assistant_message_id) AS replies, MIN(expected_lo) AS expected_lo, MAX(expected_hi) AS expected_hi
    FROM turn_log GROUP BY 1"""


def _log_sums(log):
    return log.groupBy(F.coalesce("tier", F.lit("unknown")).alias("tier")).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("sql_tool_uses").alias("sql_calls"),
        F.sum(F.size("query_ids")).alias("query_ids"),
        F.sum("answer_chars").alias("answer_chars"),
        F.count("assistant_message_id").alias("replies"),
        F.min("expected_lo").alias("expected_lo"),
        F.max("expected_hi").alias("expected_hi"),
    )


def _stored_log(spark, location):
    path = sinks.work_folder(spark, "turn-log")
    sinks.write_turn_log(turn_source.turn_log(spark, location), path)
    return path


@entry("src_turnlog_jsonl", _LOG_SUMS)
def src_turnlog_jsonl(spark, location):
    return _log_sums(read_turn_log(spark, _stored_log(spark, location)))


# -- sinks -------------------------------------------------------------------


@entry(
    "sink_ctas",
    f"""
    SELECT CAST(DATE_TRUNC('month', sale_date) AS DATE) AS period_month, COUNT(*) AS lines, {dbl('SUM(revenue)')} AS revenue
    FROM daily_sales GROUP BY 1""",
)
def sink_ctas(spark, location):
    stored = sinks.create_table_as(tables(spark, location).daily_sales(), sinks.work_folder(spark, "daily-sales"))
    return stored.groupBy(F.trunc("sale_date", "month").alias("period_month")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue")
    )


@entry(
    "sink_jsonl",
    """
    SELECT thread_id, turn_index, tier, sql_tool_uses, CAST(least(id_count, 3) AS INTEGER) AS query_ids, input_tokens FROM turn_log""",
)
def sink_jsonl(spark, location):
    log = read_turn_log(spark, _stored_log(spark, location))
    return log.select(
        "thread_id", "turn_index", "tier", F.col("sql_tool_uses").cast("long"), F.size("query_ids").alias("query_ids"), "input_tokens"
    )


@entry(
    "sink_append_summary",
    f"SELECT label, calls, succeeded, median_total_s, median_first_event_s, median_input_tokens, median_output_tokens FROM ({_SUMMARY})",
)
def sink_append_summary(spark, location):
    path = sinks.work_folder(spark, "summaries")
    log = turn_source.turn_log(spark, location)
    for label in ("baseline", "optimized"):
        sinks.append_summary(turns.latency_summary(log, label), path)
    return spark.read.parquet(path).select("label", "calls", "succeeded", *turns._MEDIANS)


@entry("sink_columns_pinned", "SELECT record_id, trace_id, span_name, event_date, duration_ms FROM spans")
def sink_columns_pinned(spark, location):
    wider = traces.spans(spark, location).withColumn("added_later", F.lit(1))
    kept = sinks.pinned(wider, fv.SPAN_COLUMNS, {"event_date": "date", "duration_ms": "bigint"})
    stored = sinks.create_table_as(kept, sinks.work_folder(spark, "spans-pinned"))
    return stored.select("record_id", "trace_id", "span_name", "event_date", "duration_ms")


# -- layout ------------------------------------------------------------------


def _clustered(spark, rows, name: str, files: int | None = None, derive=None) -> str:
    path = sinks.work_folder(spark, f"{name}-clustered")
    layout.cluster_write(rows, path, fv.CLUSTER_KEYS[name], fv.LOOKUP_KEYS.get(name, ()), files, derive=derive)
    return path


@entry(
    "layout_cluster_write",
    f"""
    SELECT sale_date, COUNT(*) AS lines, COUNT(DISTINCT store_id) AS stores, {dbl('SUM(revenue)')} AS revenue FROM daily_sales GROUP BY sale_date""",
)
def layout_cluster_write(spark, location):
    stored = spark.read.parquet(_clustered(spark, tables(spark, location).daily_sales(), "daily_sales"))
    return stored.groupBy("sale_date").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("store_id").alias("stores"), F.sum("revenue").alias("revenue")
    )


@entry(
    "layout_recluster",
    "SELECT span_name, event_date, COUNT(*) AS n FROM spans GROUP BY span_name, event_date",
)
def layout_recluster(spark, location):
    path = sinks.work_folder(spark, "spans")
    spans = traces.spans(spark, location)
    sinks.create_table_as(spans.repartition(layout.parts_for(spans)), path)
    layout.recluster(spark, path, fv.CLUSTER_KEYS["spans"])
    return spark.read.parquet(path).groupBy("span_name", "event_date").agg(F.count(F.lit(1)).alias("n"))


def _before_and_after(spark, location):
    sales = tables(spark, location).daily_sales(("sale_id", "store_id", "product_id", "sale_date", "revenue"))
    scattered, files = sinks.work_folder(spark, "sales-scattered"), layout.parts_for(sales)
    sales.repartition(files, "sale_id").write.parquet(scattered)
    return {
        "scattered": spark.read.parquet(scattered),
        "clustered": spark.read.parquet(_clustered(spark, sales, "daily_sales", files)),
    }


def _best(report, figure: str):
    """What does not depend on file sizes: the rows, and which table has the smallest figure alone."""
    least, most = report.agg(F.min(figure)).scalar(), report.agg(F.max(figure)).scalar()
    return report.select("table_name", "rows", ((F.col(figure) == least) & (least < most)).alias("best"))


_CLUSTERED_WINS = """
    SELECT 'scattered' AS table_name, COUNT(*) AS rows, FALSE AS best FROM lineitem
    UNION ALL SELECT 'clustered', COUNT(*), TRUE FROM lineitem"""


@entry("layout_overlap_report", _CLUSTERED_WINS)
def layout_overlap_report(spark, location):
    return _best(layout.overlap_report(_before_and_after(spark, location), "sale_date"), "average_depth")


@entry("layout_scan_report", _CLUSTERED_WINS)
def layout_scan_report(spark, location):
    low, high = dt.date(2000, 10, 1), dt.date(2000, 12, 31)
    return _best(layout.scan_report(_before_and_after(spark, location), "sale_date", low, high), "files_read")


def _lookup(name: str, sql: str, table: str, columns: tuple[str, ...]) -> None:
    @entry(name, sql)
    def query(spark, location):
        t = tables(spark, location)
        if table == "staff_shifts":
            stored = spark.read.parquet(_clustered(spark, t.shift_grid(), table, derive=t.shift_figures))
        else:
            stored = spark.read.parquet(_clustered(spark, getattr(t, table)(), table))
        first = {c: F.min(c).alias(c) for c in fv.LOOKUP_KEYS[table]}
        if len(first) == 1:
            (column,) = first
            return layout.lookup_by_id(stored, **{column: stored.agg(first[column]).scalar()}).select(*columns)
        # the pair of ids of the row with the smallest first id
        one, two = first
        pair = {one: stored.agg(F.min(one)).scalar(), two: stored.agg(F.min_by(two, one)).scalar()}
        return layout.lookup_by_id(stored, **pair).select(*columns)


_lookup(
    "lookup_by_id",
    f"SELECT sale_id, store_id, product_id, sale_date, units_sold, {dbl('revenue')} AS revenue FROM daily_sales WHERE sale_id = (SELECT MIN(sale_id) FROM daily_sales)",
    "daily_sales",
    ("sale_id", "store_id", "product_id", "sale_date", "units_sold", "revenue"),
)
_lookup(
    "lookup_by_id_inventory",
    "SELECT snapshot_id, store_id, product_id, units_on_hand FROM inventory WHERE snapshot_id = (SELECT MIN(snapshot_id) FROM inventory)",
    "inventory",
    ("snapshot_id", "store_id", "product_id", "units_on_hand"),
)
_lookup(
    "lookup_by_id_returns",
    "SELECT return_id, sale_id, return_reason FROM returns WHERE return_id = (SELECT MIN(return_id) FROM returns)",
    "returns",
    ("return_id", "sale_id", "return_reason"),
)
_lookup(
    "lookup_by_id_shifts",
    "SELECT shift_id, store_id, headcount, hours_worked FROM staff_shifts WHERE shift_id = (SELECT MIN(shift_id) FROM staff_shifts)",
    "staff_shifts",
    ("shift_id", "store_id", "headcount", "hours_worked"),
)

# -- freshness ---------------------------------------------------------------

_NOW = "2024-01-31 12:00:00"


def _late(table: str, time: str, name: str, lag: int) -> str:
    behind = f"CAST(epoch(TIMESTAMP '{_NOW}') AS BIGINT) - CAST(FLOOR(epoch(MAX(CAST({time} AS TIMESTAMP)))) AS BIGINT)"
    return (
        f"SELECT '{name}' AS table_name, MAX(CAST({time} AS TIMESTAMP)) AS latest_data, {lag} AS target_lag_s, "
        f"{behind} AS behind_s, {behind} > {lag} AS late FROM {table}"
    )


@entry(
    "fresh_status",
    " UNION ALL ".join(
        [
            _late("spans", "end_ts", "spans", fv.SPAN_LAG_SECONDS),
            _late("sales_base", "created_at", "daily_sales", fv.RETAIL_LAG_SECONDS),
            _late("returns", "return_date", "returns", fv.RETAIL_LAG_SECONDS),
        ]
    ),
)
def fresh_status(spark, location):
    t = tables(spark, location)
    watched = {
        "spans": freshness.Watched(traces.spans(spark, location), "end_ts", fv.SPAN_LAG_SECONDS),
        "daily_sales": freshness.Watched(t.daily_sales(("created_at",)), "created_at", fv.RETAIL_LAG_SECONDS),
        "returns": freshness.Watched(t.returns(), "return_date", fv.RETAIL_LAG_SECONDS),
    }
    return freshness.status(watched, F.lit(_NOW).cast("timestamp"))


@entry(
    "fresh_compare",
    """
    WITH derived AS (SELECT COUNT(*) AS n, COUNT(DISTINCT trace_id) AS keys FROM spans),
    base AS (SELECT COUNT(*) AS n, COUNT(DISTINCT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS keys FROM events WHERE user_id % 10 <> 9)
    SELECT source, n, keys, (SELECT d.n = b.n AND d.keys = b.keys FROM derived d, base b) AS equal
    FROM (SELECT 'derived' AS source, * FROM derived UNION ALL SELECT 'base', * FROM base)""",
)
def fresh_compare(spark, location):
    base = flat.keep_agent(traces.raw_events(spark, location), traces.AGENT)
    return freshness.compare(traces.spans(spark, location), flat.span_durations(base))


_CUT = "2024-01-25 06:00:00"


@entry(
    "fresh_missing_days",
    f"""
    SELECT event_date, COUNT(*) AS base_rows FROM spans
    WHERE event_date NOT IN (SELECT event_date FROM spans WHERE end_ts <= TIMESTAMP '{_CUT}') GROUP BY event_date""",
)
def fresh_missing_days(spark, location):
    base = traces.spans(spark, location)
    return freshness.missing_days(base, base.where(F.col("end_ts") <= F.lit(_CUT).cast("timestamp")))


@entry(
    "refresh_cost_by_day",
    f"SELECT CAST(start_time AS DATE) AS day, table_name, {dbl('SUM(credits_used)')} AS credits FROM refresh_history GROUP BY ALL",
)
def refresh_cost(spark, location):
    return freshness.cost_by_day(history.refresh_history(spark, location))


_COUNTED = {
    "stores": "stores_base", "products": "products_base", "promo_calendar": "promo_calendar", "sales_targets": "sales_targets",
    "staff_shifts": "staff_shifts", "daily_sales": "daily_sales", "inventory": "inventory",
}


@entry(
    "check_row_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST({fv.EXPECTED_ROWS[name]} AS BIGINT) AS expected, COUNT(*) AS actual, COUNT(*) = {fv.EXPECTED_ROWS[name]} AS matches FROM {sql}"
        for name, sql in _COUNTED.items()
    ),
)
def check_row_counts(spark, location):
    t = tables(spark, location)
    made = {name: (t.products(ranked=False) if name == "products" else getattr(t, name)()) for name in _COUNTED}
    return freshness.row_counts(made, fv.EXPECTED_ROWS)


# -- streams -----------------------------------------------------------------


def _event_stream(spark, location):
    return refresh.stream_files(spark, location, "events.parquet")


@entry(
    "refresh_lag",
    "SELECT query_id, warehouse_name, execution_time FROM query_history",
)
def refresh_lag(spark, location):
    folder = sinks.work_folder(spark, "history-copy")
    stream = history.history_of(_event_stream(spark, location)).select("query_id", "warehouse_name", "execution_time")
    return refresh.refresh_once(stream, f"{folder}/table", f"{folder}/checkpoint")


@entry(
    "refresh_incremental_view",
    "SELECT event_date, COUNT(*) AS n, COUNT(DISTINCT trace_id) AS traces FROM spans GROUP BY event_date",
)
def refresh_view(spark, location):
    view = refresh.current_view(traces.raw_events(spark, location), traces.AGENT, "current_spans")
    return view.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces"))


@entry("flatten_stream", "SELECT * FROM spans")
def flatten_stream(spark, location):
    folder = sinks.work_folder(spark, "spans-stream")
    events = parse_attributes(traces.event_json(_event_stream(spark, location)))
    return refresh.flatten_stream(events, traces.AGENT, f"{folder}/table", f"{folder}/checkpoint")


@entry(
    "concurrency_stream",
    """
    SELECT DATE_TRUNC('second', start_ts) AS sec, COUNT(*) AS sql_starts FROM sql_spans GROUP BY 1
    HAVING DATE_TRUNC('second', MIN(start_ts)) + INTERVAL 1 SECOND <= (SELECT MAX(start_ts) - INTERVAL 10 MINUTE FROM sql_spans)""",
)
def concurrency_stream(spark, location):
    folder = sinks.work_folder(spark, "concurrency")
    stream = live.concurrency(traces.spans_of(_event_stream(spark, location)))
    return refresh.refresh_once(stream, f"{folder}/table", f"{folder}/checkpoint")


@entry("turns_per_day_stream", "SELECT event_date, COUNT(DISTINCT trace_id) AS turns FROM spans GROUP BY event_date")
def turns_per_day_stream(spark, location):
    folder = sinks.work_folder(spark, "turns-per-day")
    return live.turns_per_day(traces.spans_of(_event_stream(spark, location)), f"{folder}/table", f"{folder}/checkpoint")


@entry(
    "late_match",
    """
    WITH h AS (SELECT q.*, ts + to_minutes(k % 61) AS ts FROM query_history q JOIN events_k ON query_id = 'q' || event_id),
    passed AS (SELECT least((SELECT MAX(start_ts) FROM sql_spans), (SELECT MAX(ts) FROM h)) - INTERVAL 10 MINUTE AS mark)
    SELECT trace_id, s.query_id, start_ts, warehouse_name, execution_time, ts AS arrived
    FROM sql_spans s LEFT JOIN h ON h.query_id = s.query_id AND ts BETWEEN start_ts AND start_ts + INTERVAL 45 MINUTE
    WHERE h.query_id IS NOT NULL OR start_ts + INTERVAL 45 MINUTE < (SELECT mark FROM passed)""",
)
def late_match(spark, location):
    folder = sinks.work_folder(spark, "late-match")
    calls = traces.spans_of(_event_stream(spark, location))
    arrivals = history.history_of(_event_stream(spark, location))
    stream = live.late_match(calls, arrivals)
    return refresh.refresh_once(stream, f"{folder}/table", f"{folder}/checkpoint")
