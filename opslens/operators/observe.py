"""Questions over the span table.

Every function takes the span table (see ``flatten_spans``) and returns a DataFrame; ``since_days``
counts back from ``as_of`` (default today, ``ALL_TIME`` for no limit).  SQL calls are counted on the
execution span only, because the tool span carries the same attributes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.functions.columns import as_date, fixed, match_group, millis_between, ratio, since
from opslens.functions.quantiles import percentiles

DateLike = dt.date | str | None

ALL_TIME = None


def recent(spans: DataFrame, as_of: DateLike, since_days: int | None) -> DataFrame:
    """Spans of the last days; all of them, those without a date included, for ``ALL_TIME``."""
    return spans if since_days is None else spans.where(F.col("event_date") >= since(as_of, since_days))


def _sql_calls(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("span_name") == fv.SQL_SPAN)


def _turns(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("span_name") == fv.TURN_SPAN)


# -- volume and latency ------------------------------------------------------


def turns_per_day(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    return (
        recent(spans, as_of, since_days)
        .groupBy("event_date")
        .agg(F.count_distinct("trace_id").alias("turns"))
        .orderBy("event_date")
    )


def _histogram(spans: DataFrame, hit: Column, name: str) -> DataFrame:
    """Traces by how many of their spans match, traces without a match included."""
    per_trace = spans.groupBy("trace_id").agg(F.count_if(hit).alias(name))
    return per_trace.groupBy(name).agg(F.count(F.lit(1)).alias("traces")).orderBy(name)


def sql_fanout_distribution(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """How many SQL calls a trace makes, as a histogram."""
    return _histogram(recent(spans, as_of, since_days), F.col("span_name") == fv.SQL_SPAN, "sql_calls")


def planning_steps_distribution(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """How many planning steps a trace takes, as a histogram."""
    hit = F.col("span_name").startswith(fv.PLANNING_PREFIX)
    return _histogram(recent(spans, as_of, since_days), hit, "planning_steps")


def turn_duration_percentiles(
    spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7, approximate: bool = False
) -> DataFrame:
    """Median, 95th percentile and longest turn in seconds."""
    agents = recent(spans, as_of, since_days).where(F.col("span_name") == fv.AGENT_SPAN)
    row = percentiles(
        agents,
        {"p50": ("duration_ms", 0.5), "p95": ("duration_ms", 0.95)},
        largest={"longest": "duration_ms"},
        count_as="turns",
        approximate=approximate,
    )
    return row.select(
        fixed(F.col("p50") / 1000.0, 1).alias("p50_s"),
        fixed(F.col("p95") / 1000.0, 1).alias("p95_s"),
        fixed(F.col("longest") / 1000.0, 1).alias("max_s"),
        "turns",
    )


def latency_breakdown(
    spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7, approximate: bool = False
) -> DataFrame:
    """Median turn time, the part spent in SQL and the rest, in milliseconds."""
    kept = recent(spans, as_of, since_days)
    agent = kept.where(F.col("span_name") == fv.AGENT_SPAN).select("trace_id", F.col("duration_ms").alias("agent_ms"))
    sql = _sql_calls(kept).groupBy("trace_id").agg(F.sum("duration_ms").alias("sql_ms"))
    split = agent.join(sql, "trace_id", "left").select(
        "agent_ms", F.coalesce("sql_ms", F.lit(0)).alias("sql_ms")
    ).withColumn("other_ms", F.col("agent_ms") - F.col("sql_ms"))
    row = percentiles(
        split,
        {"a": ("agent_ms", 0.5), "s": ("sql_ms", 0.5), "o": ("other_ms", 0.5)},
        count_as="turns",
        approximate=approximate,
    )
    return row.select(
        fixed(F.col("a"), 0).alias("median_agent_ms"),
        fixed(F.col("s"), 0).alias("median_sql_ms"),
        fixed(F.col("o"), 0).alias("median_other_ms"),
        "turns",
    )


def concurrency_timeline(
    spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7, limit: int | None = 200, grain: str = "second"
) -> DataFrame:
    """SQL starts per second (or other grain) where more than one began, busiest first."""
    starts = (
        _sql_calls(recent(spans, as_of, since_days))
        .groupBy(F.date_trunc(grain, F.col("start_ts")).alias("sec"))
        .agg(F.count(F.lit(1)).alias("sql_starts"))
        .where(F.col("sql_starts") > 1)
    )
    ordered = starts.orderBy(F.desc("sql_starts"), "sec")
    return ordered if limit is None else ordered.limit(limit)


def span_breakdown(spans: DataFrame, day: DateLike = None) -> DataFrame:
    """Spans and traces by span name on one day."""
    return (
        spans.where(F.col("event_date") == F.lit(as_date(day)))
        .groupBy("span_name")
        .agg(F.count(F.lit(1)).alias("ct"), F.count_distinct("trace_id").alias("traces"))
        .orderBy(F.desc("ct"), "span_name")
    )


# -- questions and threads ---------------------------------------------------


def multi_turn_threads(spans: DataFrame, min_turns: int = 2) -> DataFrame:
    """Threads with several turns; '0' stands for "no thread"."""
    return (
        spans.where(F.col("thread_id").isNotNull() & (F.col("thread_id") != fv.NO_THREAD))
        .groupBy("thread_id")
        .agg(
            F.count_distinct("trace_id").alias("turns"),
            F.min("start_ts").alias("thread_start"),
            F.max("end_ts").alias("thread_end"),
        )
        .where(F.col("turns") >= min_turns)
        .orderBy(F.desc_nulls_first("thread_start"), "thread_id")
    )


def thread_messages(spans: DataFrame, thread_id: str | Column) -> DataFrame:
    """The turns of one thread in order."""
    return (
        _turns(spans)
        .where(F.col("thread_id") == thread_id)
        .select("start_ts", "question", "response_text", "status", "status_description")
        .orderBy(F.asc_nulls_last("start_ts"), F.asc_nulls_last("question"))
    )


def top_questions(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7, limit: int = 10) -> DataFrame:
    """Most-asked questions by exact text."""
    return (
        _turns(recent(spans, as_of, since_days))
        .where(F.col("question").isNotNull())
        .groupBy("question")
        .agg(F.count(F.lit(1)).alias("ct"))
        .orderBy(F.desc("ct"), "question")
        .limit(limit)
    )


def turn_picker(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7, limit: int = 60) -> DataFrame:
    """The latest turns, question cut to 80 characters."""
    return (
        _turns(recent(spans, as_of, since_days))
        .where(F.col("question").isNotNull())
        .select("trace_id", F.left("question", F.lit(80)).alias("question"), "start_ts", "duration_ms")
        .orderBy(F.desc_nulls_first("start_ts"), "trace_id")
        .limit(limit)
    )


# -- reliability -------------------------------------------------------------


def success_rate(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    total, good = F.count(F.lit(1)), F.count_if(F.col("status") == "SUCCESS")
    return _turns(recent(spans, as_of, since_days)).agg(
        total.alias("total_turns"),
        good.alias("succeeded"),
        F.count_if(F.col("status_description") == "SLOW").alias("flagged_slow"),
        ratio(good, total, 1, 100).alias("success_pct"),
    )


def failed_turns(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """Turns with a status other than SUCCESS; a missing status is not a failure."""
    return (
        _turns(recent(spans, as_of, since_days))
        .where(F.col("status") != "SUCCESS")
        .select("trace_id", "question", "status", "start_ts")
        .orderBy(F.desc_nulls_first("start_ts"), "trace_id")
    )


def sql_reliability(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """SQL calls by outcome next to turns with any failed call, as one row.

    Traces are reduced first, so both distinct counts become plain sums over one row per trace.
    """
    call = F.col("span_name") == fv.SQL_SPAN
    failed = F.col("sql_status") == "ERROR"
    per_trace = recent(spans, as_of, since_days).groupBy("trace_id").agg(
        F.count_if(call & (F.col("sql_status") == "SUCCESS")).alias("ok"),
        F.count_if(call & failed).alias("err"),
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("hit"),
    )
    known = F.col("trace_id").isNotNull()
    total = per_trace.agg(
        F.coalesce(F.sum("ok"), F.lit(0)).alias("sql_ok"),
        F.coalesce(F.sum("err"), F.lit(0)).alias("sql_err"),
        F.count_if(known).alias("total_turns"),
        F.count_if(known & F.col("hit")).alias("turns_with_error"),
    )
    calls = F.col("sql_ok") + F.col("sql_err")
    return total.select(
        calls.alias("sql_calls"),
        "sql_ok",
        "sql_err",
        ratio(F.col("sql_ok"), calls, 1, 100).alias("sql_success_pct"),
        "total_turns",
        "turns_with_error",
        ratio(F.col("turns_with_error"), F.col("total_turns"), 1, 100).alias("turns_with_error_pct"),
    )


def _errors_by(spans: DataFrame, key: Column, name: str) -> DataFrame:
    return spans.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("occurrences"), F.count_distinct("trace_id").alias("turns_affected")
    )


def hallucinated_columns(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7, limit: int = 15) -> DataFrame:
    """Column names that do not exist, read from the error text."""
    failed = _sql_calls(recent(spans, as_of, since_days)).where(
        (F.col("sql_status") == "ERROR") & F.col("sql_error").ilike("%invalid identifier%")
    )
    named = _errors_by(failed, match_group(F.col("sql_error"), fv.IDENTIFIER_PATTERN), "bad_identifier")
    return named.where(F.col("bad_identifier").isNotNull()).orderBy(F.desc("occurrences"), "bad_identifier").limit(limit)


def error_taxonomy(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """SQL errors by error code, 'other' without one."""
    failed = _sql_calls(recent(spans, as_of, since_days)).where(F.col("sql_status") == "ERROR")
    key = F.coalesce(match_group(F.col("sql_error"), fv.ERROR_CODE_PATTERN), F.lit("other"))
    return _errors_by(failed, key, "error_code").orderBy(F.desc("occurrences"), "error_code")


def self_correction(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """Turns by number of failed calls, and how many of them also had a good one."""
    per_trace = (
        _sql_calls(recent(spans, as_of, since_days))
        .where(F.col("sql_status").isNotNull())
        .groupBy("trace_id")
        .agg(
            F.count_if(F.col("sql_status") == "ERROR").alias("failures"),
            F.count_if(F.col("sql_status") == "SUCCESS").alias("successes"),
        )
    )
    return (
        per_trace.groupBy("failures")
        .agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("successes") > 0).alias("recovered"))
        .orderBy("failures")
    )


# -- tokens and warehouse ----------------------------------------------------


def token_economics(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """Token totals, cache share and tokens per turn, as one row."""
    kept = recent(spans, as_of, since_days).where(F.col("tokens_total").isNotNull())
    turns = F.count_distinct("trace_id")
    return kept.agg(
        F.sum("tokens_total").alias("total_tokens"),
        F.sum("tokens_input").alias("input_tokens"),
        F.sum("tokens_output").alias("output_tokens"),
        F.sum("tokens_cache_read").alias("cache_read_tokens"),
        turns.alias("turns"),
        F.max("tokens_total").alias("max_span_tokens"),
    ).select(
        "total_tokens", "input_tokens", "output_tokens", "cache_read_tokens",
        ratio(F.col("cache_read_tokens"), F.col("input_tokens"), 1, 100).alias("cache_pct"),
        "turns",
        ratio(F.col("total_tokens"), F.col("turns"), 0).alias("tokens_per_turn"),
        "max_span_tokens",
    )


def tokens_per_turn(spans: DataFrame, as_of: DateLike = None, since_days: int | None = 7, limit: int = 15) -> DataFrame:
    """Costliest traces with their question.

    One conditional aggregate per trace reads the spans once, in place of two aggregates and a join.
    """
    per_trace = recent(spans, as_of, since_days).groupBy("trace_id").agg(
        F.sum("tokens_total").alias("tokens"),
        F.sum(F.when(F.col("tokens_total").isNotNull(), F.col("tokens_output"))).alias("out_tokens"),
        F.max(F.when(F.col("span_name") == fv.TURN_SPAN, F.col("question"))).alias("_question"),
    )
    return (
        per_trace.where(F.col("tokens").isNotNull())
        .orderBy(F.desc("tokens"), F.desc_nulls_first("out_tokens"), "trace_id")
        .limit(limit)
        .select("tokens", "out_tokens", F.left(F.coalesce("_question", F.lit("(unknown)")), F.lit(90)).alias("question"))
    )


def warehouse_truth(spans: DataFrame, history: DataFrame, as_of: DateLike = None, since_days: int | None = 7) -> DataFrame:
    """Warehouse metrics of the statements the traces ran, as one row.

    A semi-join on query_id: no list of ids is shipped and no id is left out.
    """
    ran = recent(spans, as_of, since_days).where(F.col("query_id").isNotNull()).select("query_id")
    matched = history.join(ran, "query_id", "left_semi")
    return matched.agg(
        F.count(F.lit(1)).alias("matched_queries"),
        ratio(F.sum("compilation_time"), F.count("compilation_time"), 0).alias("avg_compile_ms"),
        ratio(F.sum("execution_time"), F.count("execution_time"), 0).alias("avg_exec_ms"),
        fixed(F.sum("bytes_scanned").cast("double") / F.lit(float(1024**3)), 2).alias("gb_scanned"),
        fixed(
            F.lit(100.0)
            - F.sum("partitions_scanned").cast("double")
            / F.nullif(F.sum("partitions_total").cast("double"), F.lit(0.0))
            * 100.0,
            1,
        ).alias("pct_pruned"),
        F.sum("rows_produced").alias("rows_produced"),
        F.count_distinct("warehouse_name").alias("warehouses"),
    )


# -- single traces -----------------------------------------------------------

_WATERFALL = ("span_name", "offset_ms", "duration_ms", "sql_status", "tokens_total")


def trace_waterfall_all(spans: DataFrame) -> DataFrame:
    """Offset of every span from the start of its trace, for all traces.

    The start is aggregated and joined back, not taken over a window: a window would hold a whole
    trace in one task, a join lets a very long trace be split.
    """
    starts = spans.groupBy("trace_id").agg(F.min("start_ts").alias("_t0"))
    return (
        spans.select("trace_id", "start_ts", "span_name", "duration_ms", "sql_status", "tokens_total")
        .join(starts, "trace_id")
        .withColumn("offset_ms", millis_between(F.col("_t0"), F.col("start_ts")))
        .select("trace_id", *_WATERFALL)
    )


def trace_waterfall(spans: DataFrame, trace_id: str | Column) -> DataFrame:
    """Offsets of one trace's spans from its start, in order."""
    one = spans.where(F.col("trace_id") == trace_id)
    return (
        trace_waterfall_all(one)
        .select(*_WATERFALL)
        .orderBy(F.asc_nulls_last("offset_ms"), F.desc_nulls_first("duration_ms"), "span_name")
    )


def generated_sql(spans: DataFrame, trace_id: str | Column | None = None, pin_span: bool = False) -> DataFrame:
    """Statements of one trace (or all) in order; ``pin_span`` keeps one span per statement."""
    kept = spans.where(F.col("final_sql").isNotNull())
    kept = kept.where(F.col("trace_id") == trace_id) if trace_id is not None else kept
    kept = _sql_calls(kept) if pin_span else kept
    columns = ("final_sql", "sql_status", "sql_num_rows", "query_id", "sql_error", "verified_query_used")
    if trace_id is None:
        return kept.select("trace_id", "start_ts", *columns)
    return kept.orderBy(F.asc_nulls_last("start_ts"), "query_id").select(*columns)
