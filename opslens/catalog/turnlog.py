"""Catalog entries: turn logs."""

from __future__ import annotations

from opslens import fixed_values as fv
from opslens.catalog.registry import entry
from opslens.catalog.sqltext import CTES, big, dbl, fix, pick, ratio
from opslens.operators import turnlog as ops
from opslens.sources import history
from opslens.sources import turnlog as src

_TOOL = fv.SQL_TOOL_TYPE

CTES.update(
    {
        # what each event says, read straight from its number k instead of from its payload
        "turn_events": f"""
        SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS turn_id, event_id AS seq, ts AS t,
               CAST(CAST(ts AS DATE) AS TIMESTAMP) AS started, event_type, user_id, k, k % 13 <> 0 AS decoded,
               CASE event_type WHEN 'purchase' THEN 'response' WHEN 'error' THEN 'error' WHEN 'click' THEN 'response.tool_use'
                    WHEN 'view' THEN CASE k % 5 WHEN 0 THEN 'response.table' WHEN 1 THEN 'response.tool_result.analyst.delta'
                                     ELSE 'response.tool_result' END
                    ELSE CASE k % 7 WHEN 0 THEN 'response.status' WHEN 1 THEN 'response.thinking.delta' ELSE 'response.text' END END AS event
        FROM events_k""",
        "kept_events": """
        SELECT e.* FROM turn_events e LEFT JOIN (
            SELECT turn_id, MIN(seq) AS stop FROM turn_events WHERE decoded AND event IN ('response', 'error') GROUP BY turn_id) s
            ON s.turn_id = e.turn_id
        WHERE stop IS NULL OR seq <= stop""",
        "seen_ids": """
        SELECT turn_id, query_id, MIN({'seq': seq, 'pos': pos}) AS first FROM (
            SELECT turn_id, seq, 0 AS pos, 'q' || k AS query_id FROM kept_events
            WHERE decoded AND event_type = 'view' AND (k % 5 < 2 OR k % 4 <> 3)
            UNION ALL SELECT turn_id, seq, 1, 'q' || (k + 1) FROM kept_events
            WHERE decoded AND event_type = 'view' AND k % 5 >= 2 AND k % 4 <> 3)
        GROUP BY turn_id, query_id""",
        "turn_log": f"""
        SELECT c.text AS question, CASE WHEN c.conv_id % 29 <> 0 THEN {pick('(c.conv_id % 6)', fv.TIERS)} END AS tier,
               CASE WHEN (c.conv_id * 7 + c.turn) % 23 = 0 THEN 500 ELSE 200 END AS http_status,
               (c.conv_id + c.turn) % 17 = 0 AS failed,
               (CASE WHEN (c.conv_id * 7 + c.turn) % 23 = 0 THEN 500 ELSE 200 END) = 200 AND (c.conv_id + c.turn) % 17 <> 0 AS ok,
               length(c.text) % 400 / 10.0 AS total_s,
               CASE WHEN c.turn % 5 <> 4 THEN length(c.text) % 300 / 100.0 END AS first_event_s,
               (c.conv_id + c.turn) % 6 AS sql_tool_uses, (c.conv_id + c.turn) % 4 AS id_count, c.conv_id * 40 + c.turn * 4 AS first_id,
               c.conv_id % 3 = 0 AS verified_query_used, COALESCE(length(a.text), 0) AS answer_chars,
               CASE WHEN (c.conv_id + c.turn) % 17 <> 0 THEN length(c.text) + 1000 END AS input_tokens,
               CASE WHEN (c.conv_id + c.turn) % 17 <> 0 THEN length(c.text) % 500 END AS output_tokens,
               c.conv_id AS thread_id,
               CASE WHEN (c.conv_id + c.turn) % 17 <> 0 AND a.text IS NOT NULL THEN c.conv_id * 1000 + c.turn END AS assistant_message_id,
               CAST(c.turn // 2 AS INTEGER) AS turn_index,
               {pick('(c.conv_id % 6)', [fv.EXPECTED_CALLS[t][0] for t in fv.TIERS], 'INTEGER')} AS expected_lo,
               {pick('(c.conv_id % 6)', [fv.EXPECTED_CALLS[t][1] for t in fv.TIERS], 'INTEGER')} AS expected_hi,
               CASE WHEN c.conv_id % 2 = 0 THEN 'baseline' ELSE 'optimized' END AS label,
               c.conv_id // 2 % 2 + 1 AS run
        FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
        WHERE c.role = 'user'""",
    }
)


@entry(
    "turnlog_fold",
    f"""
    SELECT e.turn_id, MAX(CASE WHEN decoded AND event = 'error' THEN 'failed ' || k END) AS error,
           {fix('(epoch_us(MAX(t)) - epoch_us(MIN(started))) / 1e6', 1)} AS total_s,
           {fix('(epoch_us(MIN(t)) - epoch_us(MIN(started))) / 1e6', 2)} AS first_event_s,
           COUNT(*) FILTER (decoded AND event = 'response.tool_use' AND k % 4 <> 0) AS sql_tool_uses,
           COALESCE(BOOL_OR(decoded AND event = 'response.tool_result.analyst.delta' AND k % 2 = 0), FALSE) AS verified_query_used,
           {big("COALESCE(SUM(k % 50) FILTER (decoded AND event = 'response.text'), 0)")} AS answer_chars,
           MAX(k * 100) FILTER (decoded AND event = 'response' AND k % 8 <> 0) AS input_tokens,
           MAX(k * 7) FILTER (decoded AND event = 'response' AND k % 8 <> 0) AS output_tokens,
           MAX(user_id) FILTER (decoded AND event = 'response' AND k % 8 <> 0) AS thread_id,
           MAX(seq) FILTER (decoded AND event = 'response' AND k % 8 <> 0) AS assistant_message_id,
           COALESCE(MAX(n), 0) AS query_id_count
    FROM kept_events e LEFT JOIN (SELECT turn_id, COUNT(*) AS n FROM seen_ids GROUP BY turn_id) i ON i.turn_id = e.turn_id
    GROUP BY e.turn_id""",
)
def turnlog_fold(spark, location):
    return ops.fold_turns(src.turn_event_log(spark, location))


@entry("turnlog_query_ids", "SELECT turn_id, query_id, first.seq AS first_seq, first.pos AS first_pos FROM seen_ids")
def turnlog_query_ids(spark, location):
    return ops.turn_query_ids(src.turn_event_log(spark, location))


@entry("turnlog_event_counts", "SELECT turn_id, event, COUNT(*) AS n FROM kept_events GROUP BY turn_id, event")
def turnlog_event_counts(spark, location):
    return ops.event_counts(src.turn_event_log(spark, location))


@entry(
    "turnlog_progress_counts",
    """
    SELECT turn_id, COUNT(*) FILTER (event = 'response.status') AS status_events,
           COUNT(*) FILTER (event = 'response.thinking.delta') AS thinking_deltas FROM kept_events GROUP BY turn_id""",
)
def turnlog_progress_counts(spark, location):
    return ops.progress_counts(src.turn_event_log(spark, location))


@entry(
    "turnlog_ids_by_tier",
    f"""
    SELECT COALESCE(tier, 'unknown') AS tier, COUNT(*) AS turns, {big('SUM(least(id_count, 3))')} AS query_ids
    FROM turn_log GROUP BY 1""",
)
def turnlog_ids_by_tier(spark, location):
    return ops.ids_by_tier(src.turn_log(spark, location))


@entry(
    "turnlog_query_stats",
    f"""
    SELECT warehouse_name, COUNT(*) AS queries, {ratio('SUM(execution_time)', 'COUNT(execution_time)', 0)} AS avg_exec_ms,
           {fix('MEDIAN(execution_time)', 0)} AS p50_exec_ms, {fix('QUANTILE_CONT(execution_time, 0.95)', 0)} AS p95_exec_ms,
           {big('SUM(bytes_scanned)')} AS total_bytes_scanned
    FROM query_history WHERE query_id IN (
        SELECT 'q' || (first_id + i) FROM turn_log, (VALUES (0), (1), (2)) AS v(i) WHERE i < id_count)
    GROUP BY warehouse_name""",
)
def turnlog_query_stats(spark, location):
    return ops.query_stats(src.turn_log(spark, location), history.query_history(spark, location))


_SUMMARY = f"""
    SELECT t.label, COUNT(*) AS calls, COUNT(*) FILTER (ok) AS succeeded,
           {fix('MEDIAN(total_s) FILTER (ok AND (run > 1 OR later = 0))', 1)} AS median_total_s,
           {fix('MEDIAN(NULLIF(first_event_s, 0)) FILTER (ok AND (run > 1 OR later = 0))', 2)} AS median_first_event_s,
           CAST(TRUNC(MEDIAN(NULLIF(input_tokens, 0)) FILTER (ok AND (run > 1 OR later = 0))) AS BIGINT) AS median_input_tokens,
           CAST(TRUNC(MEDIAN(NULLIF(output_tokens, 0)) FILTER (ok AND (run > 1 OR later = 0))) AS BIGINT) AS median_output_tokens,
           {big('COALESCE(SUM(sql_tool_uses) FILTER (ok), 0)')} AS total_sql_calls,
           COUNT(*) FILTER (ok AND verified_query_used) AS vqr_hits, COUNT(*) FILTER (ok AND answer_chars = 0) AS empty_answers
    FROM turn_log t JOIN (SELECT label, COUNT(*) FILTER (ok AND run > 1) AS later FROM turn_log GROUP BY label) l ON l.label = t.label
    GROUP BY t.label"""


@entry("latency_summary", _SUMMARY)
def latency_summary(spark, location):
    return ops.latency_summary(src.turn_log(spark, location))


_FIGURES = (*ops._COUNTS, *ops._MEDIANS)


@entry(
    "latency_compare",
    f"WITH s AS ({_SUMMARY}), b AS (SELECT * FROM s WHERE label = 'baseline'), o AS (SELECT * FROM s WHERE label = 'optimized') "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS figure, {dbl(f'b.{f}')} AS baseline, {dbl(f'o.{f}')} AS optimized, {dbl(f'o.{f}')} - {dbl(f'b.{f}')} AS change FROM b, o"
        for f in _FIGURES
    ),
)
def latency_compare(spark, location):
    return ops.latency_compare(src.turn_log(spark, location), ["baseline", "optimized"])


@entry(
    "turnlog_batch_summary",
    f"""
    SELECT tier, COUNT(*) FILTER (turn_index = 0) AS questions, COUNT(*) AS turns, COUNT(*) FILTER (ok) AS ok_turns,
           {big('COALESCE(SUM(sql_tool_uses) FILTER (ok), 0)')} AS sql_calls
    FROM (SELECT * REPLACE (COALESCE(tier, 'unknown') AS tier) FROM turn_log) GROUP BY ROLLUP (tier)""",
)
def turnlog_batch_summary(spark, location):
    return ops.batch_summary(src.turn_log(spark, location))


@entry(
    "turnlog_fanout_vs_expected",
    f"""
    SELECT tier, COUNT(*) AS questions, {big('SUM(calls)')} AS sql_calls, COUNT(*) FILTER (calls < expected_lo) AS below,
           COUNT(*) FILTER (calls BETWEEN expected_lo AND expected_hi) AS within, COUNT(*) FILTER (calls > expected_hi) AS above
    FROM (SELECT thread_id, tier, expected_lo, expected_hi, SUM(sql_tool_uses) AS calls FROM turn_log GROUP BY ALL) GROUP BY tier""",
)
def turnlog_fanout(spark, location):
    return ops.fanout_vs_expected(src.turn_log(spark, location))


@entry(
    "turnlog_chain_check",
    """
    WITH p AS (
        SELECT thread_id, turn_index, assistant_message_id,
               LAST_VALUE(assistant_message_id IGNORE NULLS) OVER (PARTITION BY thread_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent,
               turn_index = MIN(turn_index) OVER (PARTITION BY thread_id) AS opening
        FROM turn_log)
    SELECT thread_id, turn_index, assistant_message_id, CASE WHEN opening THEN 0 ELSE parent END AS parent_message_id,
           opening OR parent IS NOT NULL AS linked FROM p""",
)
def turnlog_chain_check(spark, location):
    return ops.chain_check(src.turn_log(spark, location))
