import datetime as dt

import pytest
from pyspark.sql import functions as F

from opslens.operators import turnlog
from opslens.sources import sinks
from opslens.sources import turnlog as source
from opslens.sources.tables import read_turn_log

T0 = dt.datetime(2024, 1, 1)


def log(spark, *events, turn="t"):
    rows = [(turn, i, e, T0 + dt.timedelta(seconds=i + 1), d, T0) for i, (e, d) in enumerate(events)]
    return spark.createDataFrame(rows, "turn_id string, seq long, event string, t timestamp, data string, started timestamp")


CALL = ("response.tool_use", '{"type": "system_execute_sql"}')
DONE = ("response", '{"metadata": {"thread_id": 5, "assistant_message_id": 6, "usage": {"tokens_consumed": [{"input_tokens": {"total": 7}, "output_tokens": {"total": 8}}, {"input_tokens": {"total": 99}}]}}}')


def found(*ids):
    items = ", ".join('{"json": {"query_id": "%s"}}' % i for i in ids)
    return "response.tool_result", '{"type": "system_execute_sql", "content": [%s, {"text": "x"}]}' % items


def test_fold(spark):
    events = log(
        spark,
        ("response.text", "{broken"),
        CALL,
        ("response.tool_use", '{"type": "chart"}'),
        found("q2", "q1", ""),
        ("response.table", '{"query_id": "q1"}'),
        ("response.tool_result.analyst.delta", '{"delta": {"query_id": "q3", "verified_query_used": true}}'),
        ("response.text", '{"text": "hello"}'),
        ("response.text", '{"text": null}'),
        ("response", "{broken too"),
        DONE,
        CALL,
        found("late"),
        ("error", '{"message": "too late"}'),
    )
    row = turnlog.fold_turns(events).first().asDict()
    assert row == {
        "turn_id": "t", "error": None, "total_s": 10.0, "first_event_s": 1.0, "sql_tool_uses": 1, "verified_query_used": True,
        "answer_chars": 5, "input_tokens": 7, "output_tokens": 8, "thread_id": 5, "assistant_message_id": 6, "query_id_count": 3,
    }
    ids = turnlog.turn_query_ids(events).orderBy("first_seq", "first_pos").collect()
    assert [r.query_id for r in ids] == ["q2", "q1", "q3"]
    counts = {r.event: r.n for r in turnlog.event_counts(events).collect()}
    assert counts["response"] == 2 and counts["response.tool_use"] == 2 and "error" not in counts


def test_fold_of_error_and_of_open_turn(spark):
    events = log(spark, ("error", '{"message": "boom"}'), CALL, turn="bad").unionAll(log(spark, CALL, CALL, turn="open"))
    rows = {r.turn_id: r for r in turnlog.fold_turns(events).collect()}
    assert (rows["bad"].error, rows["bad"].sql_tool_uses, rows["bad"].query_id_count) == ("boom", 0, 0)
    assert (rows["open"].error, rows["open"].sql_tool_uses, rows["open"].thread_id) == (None, 2, None)


def turns(spark, *rows):
    fields = {
        "label": "string", "run": "int", "http_status": "int", "error": "string", "total_s": "double", "first_event_s": "double", "input_tokens": "long",
        "output_tokens": "long", "sql_tool_uses": "int", "verified_query_used": "boolean", "answer_chars": "long", "tier": "string",
        "query_ids": "array<string>", "turn_index": "int", "thread_id": "long", "expected_lo": "int", "expected_hi": "int", "assistant_message_id": "long",
    }
    base = {"label": "a", "run": 1, "http_status": 200, "total_s": 1.0, "turn_index": 0}
    return spark.createDataFrame([tuple({**base, **r}.get(f) for f in fields) for r in rows], ", ".join(f"{k} {v}" for k, v in fields.items()))


def test_summary_uses_later_runs_or_all(spark):
    rows = turns(
        spark,
        {"total_s": 9.0, "answer_chars": 3}, {"run": 2, "total_s": 1.0, "first_event_s": 0.0, "input_tokens": 5}, {"run": 2, "total_s": 2.0, "first_event_s": 0.5, "input_tokens": 8},
        {"run": 2, "total_s": 50.0, "http_status": 500}, {"run": 2, "total_s": 60.0, "error": "x"},
        {"label": "b", "total_s": 4.0, "verified_query_used": True, "sql_tool_uses": 3}, {"label": "b", "run": 2, "error": "x", "sql_tool_uses": 9},
    )
    got = {r.label: r for r in turnlog.latency_summary(rows).collect()}
    a, b = got["a"], got["b"]
    assert (a.calls, a.succeeded, a.median_total_s, a.median_first_event_s, a.median_input_tokens, a.empty_answers) == (5, 3, 1.5, 0.5, 6, 2)
    assert (b.calls, b.succeeded, b.median_total_s, b.median_first_event_s, b.total_sql_calls, b.vqr_hits) == (2, 1, 4.0, None, 3, 1)
    change = {r.figure: r for r in turnlog.latency_compare(rows, ["a", "b"]).collect()}
    assert change["median_total_s"].change == 2.5 and change["median_input_tokens"].change is None


def test_tiers(spark):
    rows = turns(spark, {"query_ids": ["x", "x"], "tier": "simple"}, {"query_ids": None}, {"error": "x", "sql_tool_uses": 4, "tier": "simple", "turn_index": 1})
    assert {r.tier: (r.turns, r.query_ids) for r in turnlog.ids_by_tier(rows).collect()} == {"simple": (2, 2), "unknown": (1, 0)}
    assert {r.tier: (r.questions, r.turns, r.ok_turns, r.sql_calls) for r in turnlog.batch_summary(rows).collect()} == {
        "simple": (1, 2, 1, 0), "unknown": (1, 1, 1, 0), None: (2, 3, 2, 0)
    }


def test_chain_goes_on_from_the_last_good_reply(spark):
    rows = turns(
        spark,
        {"thread_id": 1, "turn_index": 0, "assistant_message_id": 10}, {"thread_id": 1, "turn_index": 1}, {"thread_id": 1, "turn_index": 2, "assistant_message_id": 12},
        {"thread_id": 2, "turn_index": 0}, {"thread_id": 2, "turn_index": 1, "assistant_message_id": 21},
    )
    got = {(r.thread_id, r.turn_index): (r.parent_message_id, r.linked) for r in turnlog.chain_check(rows).collect()}
    assert got == {(1, 0): (0, True), (1, 1): (10, True), (1, 2): (10, True), (2, 0): (0, True), (2, 1): (None, False)}


def test_turn_log_round_trip(spark, small, tmp_path):
    before = source.turn_log(spark, small)
    path = str(tmp_path / "log")
    sinks.write_turn_log(before, path)
    (tmp_path / "log" / "blank.json").write_text("\n\n")
    after = read_turn_log(spark, path)
    assert sorted(map(repr, after.select(*before.columns).collect())) == sorted(map(repr, before.collect()))


def test_pinned_columns(spark):
    rows = spark.range(1).select(F.col("id"), F.lit(1).alias("new"))
    assert sinks.pinned(rows, ["id"]).columns == ["id"]
    with pytest.raises(sinks.ColumnsChanged):
        sinks.pinned(rows, ["id", "gone"])
    with pytest.raises(sinks.ColumnsChanged):
        sinks.pinned(rows, ["id"], {"id": "string"})
