"""Headline figures computed from the span questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.columns import fixed, ratio
from opslens.functions.scans import number_rows
from opslens.operators import observe
from opslens.operators.observe import DateLike


def fanout(spans: DataFrame, as_of: DateLike = None, since_days: int = 7) -> DataFrame:
    """Traces, mean SQL calls per trace and the worst fan-out."""
    histogram = observe.sql_fanout_distribution(spans, as_of, since_days)
    return histogram.agg(
        F.coalesce(F.sum("traces"), F.lit(0)).alias("total_traces"),
        ratio(F.sum(F.col("sql_calls") * F.col("traces")), F.sum("traces"), 1).alias("avg_sql_calls"),
        F.coalesce(F.max("sql_calls"), F.lit(0)).alias("max_sql_calls"),
    )


def latency_share(spans: DataFrame, as_of: DateLike = None, since_days: int = 7) -> DataFrame:
    """Median turn, its SQL part and the rest in seconds, and the SQL share in percent."""
    row = observe.latency_breakdown(spans, as_of, since_days)
    agent, sql, other = F.col("median_agent_ms"), F.col("median_sql_ms"), F.col("median_other_ms")
    share = F.when(agent == 0, F.lit(0.0)).otherwise(ratio(sql, agent, 1, 100))
    return row.select(
        fixed(agent / 1000.0, 1).alias("median_turn_s"),
        fixed(sql / 1000.0, 1).alias("sql_s"),
        fixed(other / 1000.0, 1).alias("orchestration_s"),
        share.alias("sql_share_pct"),
        "turns",
    )


def peak_concurrency(
    spans: DataFrame, as_of: DateLike = None, since_days: int = 7, grain: str = "second"
) -> DataFrame:
    """Most SQL starts in one second (or other grain); NULL when no two coincide."""
    timeline = observe.concurrency_timeline(spans, as_of, since_days, limit=None, grain=grain)
    return timeline.agg(F.max("sql_starts").alias("peak_sql_starts"))


def reliability(spans: DataFrame, as_of: DateLike = None, since_days: int = 7) -> DataFrame:
    """Turn-level success beside statement-level success, one row from one pass."""
    sql = observe.sql_reliability(spans, as_of, since_days)
    turns = observe.success_rate(spans, as_of, since_days)
    both = sql.select(F.struct("*").alias("s"), F.lit(None).cast(turns.schema).alias("t")).unionAll(
        turns.select(F.lit(None).cast(sql.schema).alias("s"), F.struct("*").alias("t"))
    )
    row = both.agg(F.first("s", ignorenulls=True).alias("s"), F.first("t", ignorenulls=True).alias("t"))
    return row.select(
        F.col("t.success_pct").alias("turn_success_pct"),
        F.col("s.sql_success_pct").alias("sql_success_pct"),
        F.col("s.sql_err").alias("failed_calls"),
        F.when(F.col("s.sql_calls") > 0, fixed(F.lit(100.0) - F.col("s.sql_success_pct"), 1)).alias("failed_pct"),
        F.col("s.turns_with_error").alias("turns_with_error"),
        F.col("s.turns_with_error_pct").alias("turns_with_error_pct"),
        F.col("t.flagged_slow").alias("flagged_slow"),
    )


def never_recovered(spans: DataFrame, as_of: DateLike = None, since_days: int = 7) -> DataFrame:
    """Turns without any good statement per number of failures, and their total (failures NULL)."""
    buckets = observe.self_correction(spans, as_of, since_days).withColumn(
        "never_recovered", F.col("turns") - F.col("recovered")
    )
    return buckets.rollup("failures").agg(
        F.sum("turns").alias("turns"),
        F.sum("recovered").alias("recovered"),
        F.sum("never_recovered").alias("never_recovered"),
    )


def token_mix(spans: DataFrame, as_of: DateLike = None, since_days: int = 7) -> DataFrame:
    """Fresh input, cache reads and output, each with the input-to-output ratio."""
    row = observe.token_economics(spans, as_of, since_days)
    per_output = ratio(F.col("input_tokens"), F.greatest(F.col("output_tokens"), F.lit(1)), 0)
    parts = F.array(
        F.struct(F.lit("Input (fresh)").alias("part"), (F.col("input_tokens") - F.col("cache_read_tokens")).alias("tokens")),
        F.struct(F.lit("Input (cache read)").alias("part"), F.col("cache_read_tokens").alias("tokens")),
        F.struct(F.lit("Output").alias("part"), F.col("output_tokens").alias("tokens")),
    )
    return row.select(per_output.alias("input_per_output"), F.inline(parts))


def compile_share(spans: DataFrame, history: DataFrame, as_of: DateLike = None, since_days: int = 7) -> DataFrame:
    """Compile time as a share of warehouse time, in percent."""
    row = observe.warehouse_truth(spans, history, as_of, since_days)
    both = F.col("avg_compile_ms") + F.col("avg_exec_ms")
    return row.select("matched_queries", "avg_compile_ms", "avg_exec_ms", ratio(F.col("avg_compile_ms"), both, 0, 100).alias("compile_pct"))


def wall_clock(spans: DataFrame) -> DataFrame:
    """Wall clock per trace: latest start plus longest span (an upper bound), and the true end."""
    rows = observe.trace_waterfall_all(spans)
    return rows.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"),
        (F.max("offset_ms") + F.max("duration_ms")).alias("upper_bound_ms"),
        F.max(F.col("offset_ms") + F.col("duration_ms")).alias("wall_clock_ms"),
    )


def waterfall_labels(spans: DataFrame, trace_id: str | Column) -> DataFrame:
    """Numbered labels of one trace's spans in waterfall order, names cut to 38 characters."""
    rows = observe.trace_waterfall_all(spans.where(F.col("trace_id") == trace_id))
    order = [F.asc_nulls_last("offset_ms"), F.desc_nulls_first("duration_ms"), F.asc("span_name")]
    numbered = number_rows(rows, ["trace_id"], "offset_ms", order, "_row", chunk=60_000)
    text = F.col("_row").cast("string")
    padded = F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0"))
    return numbered.select(
        F.concat(padded, F.lit(" "), F.left("span_name", F.lit(38))).alias("label"), "offset_ms", "duration_ms"
    ).orderBy("offset_ms", "label")


def turn_labels(spans: DataFrame, as_of: DateLike = None, since_days: int = 7, limit: int = 60) -> DataFrame:
    """Display label of recent turns: minute, seconds taken, question."""
    turns = observe.turn_picker(spans, as_of, since_days, limit)
    seconds = F.format_string("%.1f", fixed(F.col("duration_ms") / 1000.0, 1))
    label = F.concat(
        F.date_format("start_ts", "yyyy-MM-dd HH:mm"), F.lit(" ("), seconds, F.lit("s) -- "), F.col("question")
    )
    return turns.select("trace_id", label.alias("label"))
