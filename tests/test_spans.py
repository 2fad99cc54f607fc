import datetime as dt

from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.operators import kpi, observe
from opslens.operators.spans import AgentFilter, attribute_key, flatten_spans, span_view
from opslens.sources.tables import parse_attributes

AGENT = AgentFilter("DB", "BOT", "Agent")
DAY = dt.date(2024, 1, 10)


def raw(spark, *attributes):
    import json

    rows = []
    for i, extra in enumerate(attributes):
        base = {attribute_key("database_name"): "DB", attribute_key("agent_name"): "BOT", attribute_key("agent_type"): "Agent"}
        text = extra if isinstance(extra, str) else json.dumps({**base, **extra})
        start = dt.datetime(2024, 1, 1, 0, 0, 0, 900)
        rows.append((start, start + dt.timedelta(microseconds=200), json.dumps({"trace_id": f"t{i}"}), '{"name": "Agent"}', "SPAN", text, "{}"))
    schema = "start_timestamp timestamp, timestamp timestamp, trace string, record string, record_type string, record_attributes string, resource_attributes string"
    return parse_attributes(spark.createDataFrame(rows, schema))


def test_flatten_edges(spark):
    events = raw(
        spark,
        {attribute_key("tokens_total"): "12.7", attribute_key("validation_error"): "literal", "snow": {"ai": "nested"}},
        {attribute_key("tokens_total"): "abc", attribute_key("planning_step"): 4},
        "{broken",
        {attribute_key("agent_name"): "SOMEONE ELSE"},
        {attribute_key("question"): None},
    )
    for flatten in (flatten_spans, span_view):
        spans = flatten(events, AGENT)
        assert spans.columns == list(fv.SPAN_COLUMNS)
        got = {r.trace_id: r for r in spans.collect()}
        assert sorted(got) == ["t0", "t1", "t4"]
        assert (got["t0"].tokens_total, got["t0"].validation_error, got["t0"].duration_ms) == (13, "literal", 1)
        assert (got["t1"].tokens_total, got["t1"].planning_step) == (None, 4)
        assert got["t4"].question is None


SPAN_SCHEMA = (
    "trace_id string, span_name string, start_ts timestamp, end_ts timestamp, event_date date, duration_ms long, thread_id string, "
    "question string, response_text string, status string, status_description string, sql_status string, sql_error string, "
    "query_id string, final_sql string, sql_num_rows long, verified_query_used string, tokens_total long, tokens_input long, "
    "tokens_output long, tokens_cache_read long"
)
FIELDS = [f.split()[0] for f in SPAN_SCHEMA.split(", ")]


def spans_of(spark, *rows):
    made = []
    for r in rows:
        start = dt.datetime(2024, 1, 10, 12) + dt.timedelta(milliseconds=r.get("at", 0))
        base = {"start_ts": start, "end_ts": start + dt.timedelta(milliseconds=r.get("duration_ms", 0)), "event_date": DAY, "duration_ms": 0}
        made.append(tuple({**base, **r}.get(f) for f in FIELDS))
    return spark.createDataFrame(made, SPAN_SCHEMA)


def sql(trace, status, error=None, **more):
    return {"trace_id": trace, "span_name": fv.SQL_SPAN, "sql_status": status, "sql_error": error, **more}


def tool(trace, status, error=None):
    return {"trace_id": trace, "span_name": fv.SQL_TOOL_SPAN, "sql_status": status, "sql_error": error}


def test_statements_are_counted_once(spark):
    spans = spans_of(spark, sql("a", "ERROR"), tool("a", "ERROR"), sql("a", "SUCCESS"), tool("a", "SUCCESS"), {"trace_id": "b", "span_name": "Agent"})
    row = observe.sql_reliability(spans, DAY).first()
    assert (row.sql_calls, row.sql_ok, row.sql_err, row.sql_success_pct) == (2, 1, 1, 50.0)
    assert (row.total_turns, row.turns_with_error, row.turns_with_error_pct) == (2, 1, 50.0)
    fanout = {r.sql_calls: r.traces for r in observe.sql_fanout_distribution(spans, DAY).collect()}
    assert fanout == {0: 1, 2: 1}


def test_nothing_recorded(spark):
    empty = spans_of(spark, {"trace_id": "old", "span_name": "Agent", "event_date": dt.date(2020, 1, 1)})
    row = observe.sql_reliability(empty, DAY).first()
    assert (row.sql_calls, row.sql_success_pct, row.total_turns, row.turns_with_error_pct) == (0, None, 0, None)
    assert tuple(observe.turn_duration_percentiles(empty, DAY).first()) == (None, None, None, 0)
    assert tuple(observe.success_rate(empty, DAY).first()) == (0, 0, 0, None)
    assert kpi.peak_concurrency(empty, DAY).first()[0] is None
    assert tuple(kpi.fanout(empty, DAY).first()) == (0, None, 0)


def test_errors_without_code_or_identifier(spark):
    spans = spans_of(
        spark,
        sql("a", "ERROR", "error code 000904: invalid identifier 'X.Y'"),
        sql("b", "ERROR", "Error Code 1: INVALID IDENTIFIER unquoted"),
        sql("b", "ERROR", "timed out"),
        sql("b", "ERROR", None),
        tool("a", "ERROR", "error code 000904: invalid identifier 'X.Y'"),
    )
    assert [tuple(r) for r in observe.hallucinated_columns(spans, DAY).collect()] == [("X.Y", 1, 1)]
    assert [tuple(r) for r in observe.error_taxonomy(spans, DAY).collect()] == [("other", 3, 1), ("000904", 1, 1)]


def test_turn_whose_calls_all_failed(spark):
    spans = spans_of(spark, sql("a", "ERROR"), sql("a", "ERROR"), sql("b", "ERROR"), sql("b", "SUCCESS"), sql("c", None))
    assert [tuple(r) for r in observe.self_correction(spans, DAY).collect()] == [(1, 1, 1), (2, 1, 0)]
    rows = {r.failures: r.never_recovered for r in kpi.never_recovered(spans, DAY).collect()}
    assert rows == {1: 0, 2: 1, None: 1}


def test_threads_and_status(spark):
    def turn(trace, thread, status, at):
        return {"trace_id": trace, "thread_id": thread, "span_name": fv.TURN_SPAN, "status": status, "question": trace, "at": at}

    spans = spans_of(spark, turn("a", "t", "SUCCESS", 0), turn("b", "t", None, 5), turn("c", "0", "FAILURE", 1), turn("d", "0", "SUCCESS", 2), turn("e", None, "SLOW", 9))
    assert [(r.thread_id, r.turns) for r in observe.multi_turn_threads(spans).collect()] == [("t", 2)]
    assert [r.trace_id for r in observe.failed_turns(spans, DAY).collect()] == ["e", "c"]
    assert [r.question for r in observe.thread_messages(spans, "t").collect()] == ["a", "b"]
    assert [r.trace_id for r in observe.turn_picker(spans, DAY, limit=2).collect()] == ["e", "b"]


def test_latency_of_turns_without_sql(spark):
    spans = spans_of(
        spark,
        {"trace_id": "a", "span_name": "Agent", "duration_ms": 100},
        {"trace_id": "b", "span_name": "Agent", "duration_ms": 300},
        sql("b", "SUCCESS", duration_ms=50),
        sql("b", "SUCCESS", duration_ms=30),
    )
    assert tuple(observe.latency_breakdown(spans, DAY).first()) == (200.0, 40.0, 160.0, 2)
    assert tuple(kpi.latency_share(spans, DAY).first()) == (0.2, 0.0, 0.2, 20.0, 2)


def test_wall_clock_bounds(spark):
    spans = spans_of(spark, {"trace_id": "a", "span_name": "Agent", "at": 0, "duration_ms": 500}, sql("a", "SUCCESS", at=900, duration_ms=50))
    row = kpi.wall_clock(spans).first()
    assert (row.upper_bound_ms, row.wall_clock_ms) == (1400, 950)
    labels = [r.label for r in kpi.waterfall_labels(spans, "a").collect()]
    assert labels == ["00 Agent", "01 SqlExecution_SystemSQL"]


def test_costly_turns(spark):
    plan = f"{fv.PLANNING_PREFIX}-0"
    spans = spans_of(
        spark,
        {"trace_id": "a", "span_name": plan, "tokens_total": 10, "tokens_output": 1, "tokens_input": 8, "tokens_cache_read": 4},
        {"trace_id": "a", "span_name": plan, "tokens_output": 99},
        {"trace_id": "a", "span_name": fv.TURN_SPAN, "question": "q" * 100},
        {"trace_id": "b", "span_name": plan, "tokens_total": 20, "tokens_output": 0},
        {"trace_id": "c", "span_name": "Agent"},
    )
    assert [tuple(r) for r in observe.tokens_per_turn(spans, DAY).collect()] == [(20, 0, "(unknown)"), (10, 1, "q" * 90)]
    assert [(r.part, r.tokens, r.input_per_output) for r in kpi.token_mix(spans, DAY).collect()] == [
        ("Input (fresh)", 4, 8.0), ("Input (cache read)", 4, 8.0), ("Output", 1, 8.0)
    ]


def test_concurrency_needs_company(spark):
    spans = spans_of(spark, sql("a", "SUCCESS", at=0), sql("b", "SUCCESS", at=999), sql("c", "SUCCESS", at=1000))
    got = observe.concurrency_timeline(spans, DAY).collect()
    assert [(r.sec.second, r.sql_starts) for r in got] == [(0, 2)]


def test_warehouse_truth_without_partitions(spark):
    spans = spans_of(spark, sql("a", "SUCCESS", query_id="q1"), sql("a", "SUCCESS", query_id="q1"), sql("a", "SUCCESS", query_id="lost"))
    schema = "query_id string, warehouse_name string, compilation_time long, execution_time long, bytes_scanned long, partitions_scanned long, partitions_total long, rows_produced long"
    history = spark.createDataFrame([("q1", "W", 3, 4, 2**30, 0, 0, 7), ("other", "W", 1, 1, 1, 1, 1, 1)], schema)
    assert tuple(observe.warehouse_truth(spans, history, DAY).first()) == (1, 3.0, 4.0, 1.0, None, 7, 1)


def test_one_trace_equals_all_traces(spark):
    spans = spans_of(spark, *[sql("a", "SUCCESS", at=i * 7) for i in range(5)], {"trace_id": "b", "span_name": "Agent", "at": 3})
    one = {(r.span_name, r.offset_ms) for r in observe.trace_waterfall(spans, "a").collect()}
    every = {(r.span_name, r.offset_ms) for r in observe.trace_waterfall_all(spans).where(F.col("trace_id") == "a").collect()}
    assert one == every == {(fv.SQL_SPAN, i * 7) for i in range(5)}
