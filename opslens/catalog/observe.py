"""Catalog entries: event flattening, span questions and headline figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.catalog.registry import entry
from opslens.catalog.sqltext import SPANS_AS_OF, big, dbl, fix, ratio
from opslens.operators import kpi, observe, spans as flat
from opslens.sources import history, traces

AS_OF = SPANS_AS_OF
ALL = observe.ALL_TIME

# -- flattening --------------------------------------------------------------


@entry("flatten_spans", "SELECT * FROM spans")
def flatten(spark, location):
    return traces.flattened(spark, location)


@entry(
    "flatten_filter",
    "SELECT database_name, agent_name, agent_type, COUNT(*) AS n FROM spans GROUP BY ALL",
)
def flatten_filter(spark, location):
    kept = flat.keep_agent(traces.raw_events(spark, location), traces.AGENT)
    columns = ("database_name", "agent_name", "agent_type")
    return flat.span_view(kept).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@entry("flatten_duration", "SELECT record_id, trace_id, start_ts, end_ts, event_date, duration_ms FROM all_spans")
def flatten_duration(spark, location):
    return flat.span_durations(traces.raw_events(spark, location))


@entry(
    "flatten_trycast",
    """
    SELECT record_id,
           CASE WHEN event_type IN ('click', 'error') THEN CASE WHEN k % 13 = 0 THEN 'n/a' ELSE CAST(k * 10 AS VARCHAR) END END AS sql_num_rows_text,
           sql_num_rows, CAST(planning_step AS VARCHAR) AS planning_step_text, planning_step,
           CASE WHEN tokens_total IS NULL THEN NULL WHEN k % 10 = 0 THEN '12.7' ELSE CAST(tokens_total AS VARCHAR) END AS tokens_total_text,
           tokens_total, CAST(tokens_input AS VARCHAR) AS tokens_input_text, tokens_input,
           CAST(tokens_output AS VARCHAR) AS tokens_output_text, tokens_output,
           CAST(tokens_cache_read AS VARCHAR) AS tokens_cache_read_text, tokens_cache_read
    FROM all_spans JOIN events_k ON record_id = CAST(event_id AS VARCHAR)""",
)
def flatten_trycast(spark, location):
    return flat.numeric_attributes(traces.raw_events(spark, location))


@entry(
    "flatten_array_index_key",
    "SELECT validation_error, COUNT(*) AS n FROM spans WHERE validation_error IS NOT NULL GROUP BY validation_error",
)
def flatten_array_index_key(spark, location):
    kept = flat.span_view(traces.raw_events(spark, location), traces.AGENT).where(F.col("validation_error").isNotNull())
    return kept.groupBy("validation_error").agg(F.count(F.lit(1)).alias("n"))


_ATTRIBUTES = [c for c in fv.SPAN_COLUMNS if c in fv.TEXT_ATTRIBUTES or c in fv.NUMBER_ATTRIBUTES]


@entry(
    "flatten_profile",
    " UNION ALL ".join(
        f"SELECT span_name, '{c}' AS attribute, COUNT({c}) AS occurrences FROM spans GROUP BY span_name" for c in _ATTRIBUTES
    ),
)
def flatten_profile(spark, location):
    return flat.attribute_profile(traces.spans(spark, location))


# -- volume and latency ------------------------------------------------------


@entry(
    "turns_per_day",
    "SELECT event_date, COUNT(DISTINCT trace_id) AS turns FROM recent_spans GROUP BY event_date",
)
def turns_per_day(spark, location):
    return observe.turns_per_day(traces.spans(spark, location), AS_OF)


def _histogram_sql(hit: str, name: str) -> str:
    return f"""
    SELECT {name}, COUNT(*) AS traces
    FROM (SELECT trace_id, COUNT(*) FILTER ({hit}) AS {name} FROM spans GROUP BY trace_id) GROUP BY {name}"""


@entry("sql_fanout_distribution", _histogram_sql(f"span_name = '{fv.SQL_SPAN}'", "sql_calls"))
def sql_fanout(spark, location):
    return observe.sql_fanout_distribution(traces.spans(spark, location), AS_OF, ALL)


@entry("planning_steps_distribution", _histogram_sql(f"span_name LIKE '{fv.PLANNING_PREFIX}%'", "planning_steps"))
def planning_steps(spark, location):
    return observe.planning_steps_distribution(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "turn_duration_percentiles",
    f"""
    SELECT {fix('MEDIAN(duration_ms) / 1000.0', 1)} AS p50_s, {fix('QUANTILE_CONT(duration_ms, 0.95) / 1000.0', 1)} AS p95_s,
           {fix('MAX(duration_ms) / 1000.0', 1)} AS max_s, COUNT(*) AS turns
    FROM spans WHERE span_name = 'Agent'""",
)
def turn_durations(spark, location):
    return observe.turn_duration_percentiles(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "turn_duration_percentiles_approx",
    # the sketch keeps 10,000 values, more than there are turns here: then it is exact
    f"""
    SELECT {fix('QUANTILE_DISC(duration_ms, 0.5) / 1000.0', 1)} AS p50_s, {fix('QUANTILE_DISC(duration_ms, 0.95) / 1000.0', 1)} AS p95_s,
           {fix('MAX(duration_ms) / 1000.0', 1)} AS max_s, COUNT(*) AS turns
    FROM spans WHERE span_name = 'Agent'""",
)
def turn_durations_approx(spark, location):
    return observe.turn_duration_percentiles(traces.spans(spark, location), AS_OF, ALL, approximate=True)


_LATENCY = f"""
    SELECT {fix('MEDIAN(a.duration_ms)', 0)} AS median_agent_ms, {fix('MEDIAN(COALESCE(s.ms, 0))', 0)} AS median_sql_ms,
           {fix('MEDIAN(a.duration_ms - COALESCE(s.ms, 0))', 0)} AS median_other_ms, COUNT(*) AS turns
    FROM (SELECT trace_id, duration_ms FROM spans WHERE span_name = 'Agent') a
    LEFT JOIN (SELECT trace_id, SUM(duration_ms) AS ms FROM sql_spans GROUP BY trace_id) s USING (trace_id)"""


@entry("latency_breakdown", _LATENCY)
def latency_breakdown(spark, location):
    return observe.latency_breakdown(traces.spans(spark, location), AS_OF, ALL)


def _concurrency_sql(grain: str) -> str:
    return f"""
    SELECT DATE_TRUNC('{grain}', start_ts) AS sec, COUNT(*) AS sql_starts FROM sql_spans
    GROUP BY sec HAVING COUNT(*) > 1 ORDER BY sql_starts DESC, sec LIMIT 200"""


@entry("concurrency_timeline", _concurrency_sql("second"))
def concurrency(spark, location):
    return observe.concurrency_timeline(traces.spans(spark, location), AS_OF, ALL)


@entry("concurrency_timeline_minute", _concurrency_sql("minute"))
def concurrency_minute(spark, location):
    return observe.concurrency_timeline(traces.spans(spark, location), AS_OF, ALL, grain="minute")


@entry(
    "span_breakdown",
    f"""
    SELECT span_name, COUNT(*) AS ct, COUNT(DISTINCT trace_id) AS traces FROM spans
    WHERE event_date = DATE '{AS_OF}' GROUP BY span_name""",
)
def span_breakdown(spark, location):
    return observe.span_breakdown(traces.spans(spark, location), AS_OF)


# -- questions and threads ---------------------------------------------------


@entry(
    "multi_turn_threads",
    """
    SELECT thread_id, COUNT(DISTINCT trace_id) AS turns, MIN(start_ts) AS thread_start, MAX(end_ts) AS thread_end
    FROM spans WHERE thread_id <> '0' GROUP BY thread_id HAVING COUNT(DISTINCT trace_id) >= 2""",
)
def multi_turn_threads(spark, location):
    return observe.multi_turn_threads(traces.spans(spark, location))


@entry(
    "thread_messages",
    """
    SELECT start_ts, question, response_text, status, status_description FROM turn_spans
    WHERE thread_id = (SELECT MIN(thread_id) FROM turn_spans WHERE thread_id <> '0')""",
)
def thread_messages(spark, location):
    rows = traces.spans(spark, location)
    known = (F.col("span_name") == fv.TURN_SPAN) & (F.col("thread_id") != fv.NO_THREAD)
    return observe.thread_messages(rows, rows.where(known).agg(F.min("thread_id")).scalar())


@entry(
    "thread_messages_conversations",
    """
    SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(c.conv_id AS INTEGER)) + to_minutes(c.turn) AS start_ts, c.text AS question, a.text AS response_text,
           CASE WHEN a.text IS NULL THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
           CASE WHEN length(a.text) > 1000 THEN 'SLOW' END AS status_description
    FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
    WHERE c.role = 'user' AND c.conv_id = (SELECT MIN(conv_id) FROM conversations)""",
)
def thread_messages_conversations(spark, location):
    rows = traces.threads(spark, location)
    first = rows.agg(F.min_by("thread_id", F.substring("thread_id", 2, 20).cast("long"))).scalar()
    return observe.thread_messages(rows, first)


@entry(
    "top_questions",
    """
    SELECT question, COUNT(*) AS ct FROM turn_spans WHERE question IS NOT NULL
    GROUP BY question ORDER BY ct DESC, question LIMIT 10""",
)
def top_questions(spark, location):
    return observe.top_questions(traces.spans(spark, location), AS_OF, ALL)


_PICKER = """
    SELECT trace_id, LEFT(question, 80) AS question, start_ts, duration_ms FROM turn_spans
    WHERE question IS NOT NULL ORDER BY start_ts DESC, trace_id LIMIT 60"""


@entry("turn_picker", _PICKER)
def turn_picker(spark, location):
    return observe.turn_picker(traces.spans(spark, location), AS_OF, ALL)


# -- reliability -------------------------------------------------------------


def _success_sql(source: str, where: str = "TRUE") -> str:
    good = "COUNT(*) FILTER (status = 'SUCCESS')"
    return f"""
    SELECT COUNT(*) AS total_turns, {good} AS succeeded, COUNT(*) FILTER (status_description = 'SLOW') AS flagged_slow,
           {ratio(good, 'COUNT(*)', 1, 100)} AS success_pct FROM {source} WHERE {where}"""


@entry("success_rate", _success_sql("turn_spans", f"event_date >= DATE '{AS_OF}' - 7"))
def success_rate(spark, location):
    return observe.success_rate(traces.spans(spark, location), AS_OF)


@entry("success_rate_all_time", _success_sql("turn_spans"))
def success_rate_all(spark, location):
    return observe.success_rate(traces.spans(spark, location), AS_OF, ALL)


@entry("failed_turns", "SELECT trace_id, question, status, start_ts FROM turn_spans WHERE status <> 'SUCCESS'")
def failed_turns(spark, location):
    return observe.failed_turns(traces.spans(spark, location), AS_OF, ALL)


_OK = f"COUNT(*) FILTER (span_name = '{fv.SQL_SPAN}' AND sql_status = 'SUCCESS')"
_ERR = f"COUNT(*) FILTER (span_name = '{fv.SQL_SPAN}' AND sql_status = 'ERROR')"
_HIT = "COUNT(DISTINCT trace_id) FILTER (sql_status = 'ERROR')"
_RELIABILITY = f"""
    SELECT {_OK} + {_ERR} AS sql_calls, {_OK} AS sql_ok, {_ERR} AS sql_err, {ratio(_OK, f'({_OK} + {_ERR})', 1, 100)} AS sql_success_pct,
           COUNT(DISTINCT trace_id) AS total_turns, {_HIT} AS turns_with_error,
           {ratio(_HIT, 'COUNT(DISTINCT trace_id)', 1, 100)} AS turns_with_error_pct FROM spans"""


@entry("sql_reliability", _RELIABILITY)
def sql_reliability(spark, location):
    return observe.sql_reliability(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "hallucinated_columns",
    """
    SELECT NULLIF(regexp_extract(sql_error, 'invalid identifier ''([^'']+)''', 1), '') AS bad_identifier,
           COUNT(*) AS occurrences, COUNT(DISTINCT trace_id) AS turns_affected
    FROM sql_spans WHERE sql_status = 'ERROR' AND sql_error ILIKE '%invalid identifier%'
    GROUP BY 1 HAVING bad_identifier IS NOT NULL ORDER BY occurrences DESC, bad_identifier LIMIT 15""",
)
def hallucinated_columns(spark, location):
    return observe.hallucinated_columns(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "error_taxonomy",
    """
    SELECT COALESCE(NULLIF(regexp_extract(sql_error, 'error code (\\d+)', 1), ''), 'other') AS error_code,
           COUNT(*) AS occurrences, COUNT(DISTINCT trace_id) AS turns_affected
    FROM sql_spans WHERE sql_status = 'ERROR' GROUP BY 1""",
)
def error_taxonomy(spark, location):
    return observe.error_taxonomy(traces.spans(spark, location), AS_OF, ALL)


_CORRECTION = """
    SELECT failures, COUNT(*) AS turns, COUNT(*) FILTER (successes > 0) AS recovered
    FROM (SELECT trace_id, COUNT(*) FILTER (sql_status = 'ERROR') AS failures, COUNT(*) FILTER (sql_status = 'SUCCESS') AS successes
          FROM sql_spans WHERE sql_status IS NOT NULL GROUP BY trace_id) GROUP BY failures"""


@entry("self_correction", _CORRECTION)
def self_correction(spark, location):
    return observe.self_correction(traces.spans(spark, location), AS_OF, ALL)


# -- tokens and warehouse ----------------------------------------------------

_TOKENS = f"""
    SELECT {big('SUM(tokens_total)')} AS total_tokens, {big('SUM(tokens_input)')} AS input_tokens,
           {big('SUM(tokens_output)')} AS output_tokens, {big('SUM(tokens_cache_read)')} AS cache_read_tokens,
           {ratio('SUM(tokens_cache_read)', 'SUM(tokens_input)', 1, 100)} AS cache_pct, COUNT(DISTINCT trace_id) AS turns,
           {ratio('SUM(tokens_total)', 'COUNT(DISTINCT trace_id)', 0)} AS tokens_per_turn, MAX(tokens_total) AS max_span_tokens
    FROM spans WHERE tokens_total IS NOT NULL"""


@entry("token_economics", _TOKENS)
def token_economics(spark, location):
    return observe.token_economics(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "tokens_per_turn",
    f"""
    WITH p AS (SELECT trace_id, SUM(tokens_total) AS tokens, SUM(tokens_output) AS out_tokens FROM spans
               WHERE tokens_total IS NOT NULL GROUP BY trace_id),
    q AS (SELECT trace_id, MAX(question) AS question FROM turn_spans GROUP BY trace_id)
    SELECT {big('tokens')} AS tokens, {big('out_tokens')} AS out_tokens, LEFT(COALESCE(question, '(unknown)'), 90) AS question
    FROM p LEFT JOIN q USING (trace_id) ORDER BY p.tokens DESC, p.out_tokens DESC NULLS FIRST, trace_id LIMIT 15""",
)
def tokens_per_turn(spark, location):
    return observe.tokens_per_turn(traces.spans(spark, location), AS_OF, ALL)


_WAREHOUSE = f"""
    SELECT COUNT(*) AS matched_queries, {ratio('SUM(compilation_time)', 'COUNT(compilation_time)', 0)} AS avg_compile_ms,
           {ratio('SUM(execution_time)', 'COUNT(execution_time)', 0)} AS avg_exec_ms,
           {fix('CAST(SUM(bytes_scanned) AS DOUBLE) / 1073741824.0', 2)} AS gb_scanned,
           {fix('100.0 - CAST(SUM(partitions_scanned) AS DOUBLE) / NULLIF(CAST(SUM(partitions_total) AS DOUBLE), 0) * 100.0', 1)} AS pct_pruned,
           {big('SUM(rows_produced)')} AS rows_produced, COUNT(DISTINCT warehouse_name) AS warehouses
    FROM query_history WHERE query_id IN (SELECT query_id FROM spans WHERE query_id IS NOT NULL)"""


@entry("warehouse_truth", _WAREHOUSE)
def warehouse_truth(spark, location):
    return observe.warehouse_truth(traces.spans(spark, location), history.query_history(spark, location), AS_OF, ALL)


# -- single traces -----------------------------------------------------------

_OFFSETS = """
    SELECT s.trace_id, span_name, date_diff('millisecond', t0, start_ts) AS offset_ms, duration_ms, sql_status, tokens_total
    FROM spans s JOIN (SELECT trace_id, MIN(start_ts) AS t0 FROM spans GROUP BY trace_id) b ON b.trace_id = s.trace_id"""


def picked(rows):
    return rows.where(F.col("span_name") == fv.SQL_SPAN).agg(F.min("trace_id")).scalar()


@entry(
    "trace_waterfall",
    f"SELECT span_name, offset_ms, duration_ms, sql_status, tokens_total FROM ({_OFFSETS}) WHERE trace_id = (SELECT id FROM picked)",
)
def trace_waterfall(spark, location):
    rows = traces.spans(spark, location)
    return observe.trace_waterfall(rows, picked(rows))


@entry("trace_waterfall_all", _OFFSETS)
def trace_waterfall_all(spark, location):
    return observe.trace_waterfall_all(traces.spans(spark, location))


_SQL_COLUMNS = "final_sql, sql_status, sql_num_rows, query_id, sql_error, verified_query_used"


@entry(
    "generated_sql",
    f"SELECT {_SQL_COLUMNS} FROM spans WHERE trace_id = (SELECT id FROM picked) AND final_sql IS NOT NULL",
)
def generated_sql(spark, location):
    rows = traces.spans(spark, location)
    return observe.generated_sql(rows, picked(rows))


@entry("generated_sql_all", f"SELECT trace_id, start_ts, {_SQL_COLUMNS} FROM sql_spans WHERE final_sql IS NOT NULL")
def generated_sql_all(spark, location):
    return observe.generated_sql(traces.spans(spark, location), pin_span=True)


# -- headline figures --------------------------------------------------------


@entry(
    "kpi_fanout",
    f"""
    SELECT {big('SUM(traces)')} AS total_traces, {ratio('SUM(sql_calls * traces)', 'SUM(traces)', 1)} AS avg_sql_calls,
           MAX(sql_calls) AS max_sql_calls
    FROM ({_histogram_sql(f"span_name = '{fv.SQL_SPAN}'", "sql_calls")})""",
)
def kpi_fanout(spark, location):
    return kpi.fanout(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "kpi_latency_share",
    f"""
    SELECT {fix('median_agent_ms / 1000.0', 1)} AS median_turn_s, {fix('median_sql_ms / 1000.0', 1)} AS sql_s,
           {fix('median_other_ms / 1000.0', 1)} AS orchestration_s,
           CASE WHEN median_agent_ms = 0 THEN 0.0 ELSE {ratio('median_sql_ms', 'median_agent_ms', 1, 100)} END AS sql_share_pct, turns
    FROM ({_LATENCY})""",
)
def kpi_latency(spark, location):
    return kpi.latency_share(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "kpi_peak_concurrency",
    "SELECT MAX(n) AS peak_sql_starts FROM (SELECT COUNT(*) AS n FROM sql_spans GROUP BY DATE_TRUNC('second', start_ts) HAVING COUNT(*) > 1)",
)
def kpi_peak(spark, location):
    return kpi.peak_concurrency(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "kpi_reliability",
    f"""
    SELECT success_pct AS turn_success_pct, sql_success_pct, sql_err AS failed_calls, {fix('100.0 - sql_success_pct', 1)} AS failed_pct,
           turns_with_error, turns_with_error_pct, flagged_slow
    FROM ({_RELIABILITY}), ({_success_sql('turn_spans')})""",
)
def kpi_reliability(spark, location):
    return kpi.reliability(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "kpi_never_recovered",
    f"""
    SELECT failures, {big('SUM(turns)')} AS turns, {big('SUM(recovered)')} AS recovered, {big('SUM(turns - recovered)')} AS never_recovered
    FROM ({_CORRECTION}) GROUP BY ROLLUP (failures)""",
)
def kpi_never_recovered(spark, location):
    return kpi.never_recovered(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "kpi_token_mix",
    f"""
    WITH t AS ({_TOKENS}), r AS (SELECT *, {ratio('input_tokens', 'greatest(output_tokens, 1)', 0)} AS x FROM t)
    SELECT x AS input_per_output, 'Input (fresh)' AS part, input_tokens - cache_read_tokens AS tokens FROM r
    UNION ALL SELECT x, 'Input (cache read)', cache_read_tokens FROM r
    UNION ALL SELECT x, 'Output', output_tokens FROM r""",
)
def kpi_token_mix(spark, location):
    return kpi.token_mix(traces.spans(spark, location), AS_OF, ALL)


@entry(
    "kpi_compile_share",
    f"""
    SELECT matched_queries, avg_compile_ms, avg_exec_ms, {ratio('avg_compile_ms', '(avg_compile_ms + avg_exec_ms)', 0, 100)} AS compile_pct
    FROM ({_WAREHOUSE})""",
)
def kpi_compile(spark, location):
    return kpi.compile_share(traces.spans(spark, location), history.query_history(spark, location), AS_OF, ALL)


@entry(
    "kpi_wall_clock",
    f"""
    SELECT trace_id, COUNT(*) AS spans, MAX(offset_ms) + MAX(duration_ms) AS upper_bound_ms, MAX(offset_ms + duration_ms) AS wall_clock_ms
    FROM ({_OFFSETS}) GROUP BY trace_id""",
)
def kpi_wall_clock(spark, location):
    return kpi.wall_clock(traces.spans(spark, location))


@entry(
    "kpi_waterfall_labels",
    f"""
    SELECT lpad(CAST(ROW_NUMBER() OVER (ORDER BY offset_ms, duration_ms DESC, span_name) - 1 AS VARCHAR), 2, '0') || ' ' || LEFT(span_name, 38) AS label,
           offset_ms, duration_ms
    FROM ({_OFFSETS}) WHERE trace_id = (SELECT id FROM picked)""",
)
def kpi_labels(spark, location):
    rows = traces.spans(spark, location)
    return kpi.waterfall_labels(rows, picked(rows))


@entry(
    "kpi_turn_label",
    f"""
    SELECT trace_id, strftime(start_ts, '%Y-%m-%d %H:%M') || ' (' || printf('%.1f', {fix('duration_ms / 1000.0', 1)}) || 's) -- ' || question AS label
    FROM ({_PICKER})""",
)
def kpi_turn_label(spark, location):
    return kpi.turn_labels(traces.spans(spark, location), AS_OF, ALL)
