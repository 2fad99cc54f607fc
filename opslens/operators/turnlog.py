"""Turn logs: folding event streams into turn records, and summaries over the records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.functions.columns import fixed, ratio
from opslens.functions.quantiles import percentiles
from opslens.functions.scans import carry_forward

# -- from events to turns ----------------------------------------------------


def decode_events(events: DataFrame) -> DataFrame:
    """Read the payload of every event once: what each kind of event contributes to its turn.

    ``decoded`` is false for text that is no JSON; such an event counts as seen but says nothing.
    """
    parsed = events.withColumn("_v", F.try_parse_json("data"))

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col("_v"), path, kind)

    event = F.col("event")
    of_tool = at("$.type") == fv.SQL_TOOL_TYPE
    listed = F.transform(
        at("$.content", "array<struct<json: struct<query_id: string>>>"), lambda item: item["json"]["query_id"]
    )
    ids = (
        F.when((event == "response.tool_result") & of_tool, listed)
        .when(event == "response.table", F.array(at("$.query_id")))
        .when(event == "response.tool_result.analyst.delta", F.array(at("$.delta.query_id")))
    )
    decoded = F.col("_v").isNotNull()
    usage = "$.metadata.usage.tokens_consumed[0]"
    done = event == "response"
    return parsed.select(
        "turn_id", "seq", "event", "t", "started",
        decoded.alias("decoded"),
        (event.isin("response", "error") & decoded).alias("ends"),
        ((event == "response.tool_use") & of_tool).alias("sql_use"),
        ids.alias("ids"),
        F.when(event == "response.tool_result.analyst.delta", at("$.delta.verified_query_used", "boolean")).alias("verified"),
        F.when(event == "response.text", F.length(at("$.text"))).alias("chars"),
        F.when(event == "error", at("$.message")).alias("message"),
        F.when(done, at("$.metadata.thread_id", "long")).alias("thread"),
        F.when(done, at("$.metadata.assistant_message_id", "long")).alias("reply"),
        F.when(done, at(f"{usage}.input_tokens.total", "long")).alias("input"),
        F.when(done, at(f"{usage}.output_tokens.total", "long")).alias("output"),
    )


def until_end(decoded: DataFrame) -> DataFrame:
    """Events up to and including the first one that ends their turn.

    The end is aggregated per turn and joined back: a window would hold a whole turn in one task.
    """
    ends = decoded.where("ends").groupBy("turn_id").agg(F.min("seq").alias("_end"))
    return (
        decoded.join(ends, "turn_id", "left")
        .where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")))
        .drop("_end")
    )


def turn_query_ids(events: DataFrame) -> DataFrame:
    """Distinct query ids per turn with the place each was first seen.

    Ordering by (first_seq, first_pos) gives first-seen order; rows are keyed by turn and id, so a turn
    with very many ids is spread over the cluster.
    """
    kept = until_end(decode_events(events))
    seen = kept.select("turn_id", "seq", F.posexplode("ids").alias("_pos", "query_id"))
    return (
        seen.where(F.coalesce(F.col("query_id"), F.lit("")) != "")
        .groupBy("turn_id", "query_id")
        .agg(F.min(F.struct("seq", "_pos")).alias("_first"))
        .select(
            "turn_id", "query_id", F.col("_first.seq").alias("first_seq"), F.col("_first._pos").alias("first_pos")
        )
    )


def fold_turns(events: DataFrame) -> DataFrame:
    """One record per turn: calls, ids, answer length, times and tokens up to the ending event.

    One pass in two levels.  Every event gives one row for itself and one per query id it names; rows
    are combined by (turn, id) first, which spreads a very long turn over the cluster, and the few
    rows left are combined by turn.
    """
    named = until_end(decode_events(events)).select(
        "*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("ids", F.array().cast("array<string>")))).alias("_pos", "_id")
    )
    own = F.col("_pos") == 0

    def once(value: Column) -> Column:
        return F.when(own, value)

    by_id = (
        named.where(own | (F.coalesce(F.col("_id"), F.lit("")) != ""))
        .groupBy("turn_id", "_id")
        .agg(
            F.max(once(F.col("message"))).alias("message"),
            F.min("started").alias("started"),
            F.min("t").alias("first_t"),
            F.max("t").alias("last_t"),
            F.count_if(own & F.col("sql_use")).alias("uses"),
            F.bool_or(once(F.col("verified"))).alias("verified"),
            F.sum(once(F.col("chars"))).alias("chars"),
            F.max("input").alias("input"),
            F.max("output").alias("output"),
            F.max("thread").alias("thread"),
            F.max("reply").alias("reply"),
        )
    )
    start = F.unix_micros(F.coalesce(F.min("started"), F.min("first_t")))
    return by_id.groupBy("turn_id").agg(
        F.max("message").alias("error"),
        fixed((F.unix_micros(F.max("last_t")) - start) / 1e6, 1).alias("total_s"),
        fixed((F.unix_micros(F.min("first_t")) - start) / 1e6, 2).alias("first_event_s"),
        F.sum("uses").alias("sql_tool_uses"),
        F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified_query_used"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("answer_chars"),
        F.max("input").alias("input_tokens"),
        F.max("output").alias("output_tokens"),
        F.max("thread").alias("thread_id"),
        F.max("reply").alias("assistant_message_id"),
        F.count("_id").alias("query_id_count"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """How often each event name occurs in a turn, the ending event included."""
    return until_end(decode_events(events)).groupBy("turn_id", "event").agg(F.count(F.lit(1)).alias("n"))


def progress_counts(events: DataFrame) -> DataFrame:
    """Status and thinking events per turn, zero where a turn has none."""
    counts = event_counts(events)
    return counts.groupBy("turn_id").agg(
        F.sum(F.when(F.col("event") == "response.status", F.col("n")).otherwise(0)).alias("status_events"),
        F.sum(F.when(F.col("event") == "response.thinking.delta", F.col("n")).otherwise(0)).alias("thinking_deltas"),
    )


# -- over turn records -------------------------------------------------------


def succeeded() -> Column:
    """HTTP 200 and no error text."""
    no_error = F.coalesce(F.col("error"), F.lit("")) == ""
    return F.coalesce((F.col("http_status") == 200) & no_error, F.lit(False))


def ids_by_tier(turns: DataFrame) -> DataFrame:
    """Turns and captured query ids per tier."""
    return turns.groupBy(F.coalesce("tier", F.lit("unknown")).alias("tier")).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(F.coalesce(F.size("query_ids"), F.lit(0)).cast("long")).alias("query_ids"),
    )


def query_stats(turns: DataFrame, history: DataFrame, approximate: bool = False) -> DataFrame:
    """Execution times and bytes of the captured queries, by warehouse."""
    captured = turns.select(F.explode("query_ids").alias("query_id"))
    matched = history.join(captured, "query_id", "left_semi")
    totals = matched.groupBy("warehouse_name").agg(
        F.count(F.lit(1)).alias("queries"),
        ratio(F.sum("execution_time"), F.count("execution_time"), 0).alias("avg_exec_ms"),
        F.sum("bytes_scanned").alias("total_bytes_scanned"),
    )
    times = percentiles(
        matched,
        {"p50": ("execution_time", 0.5), "p95": ("execution_time", 0.95)},
        by=["warehouse_name"],
        approximate=approximate,
    )
    same = totals["warehouse_name"].eqNullSafe(times["warehouse_name"])
    return totals.join(times, same, "left").select(
        totals["warehouse_name"],
        "queries",
        "avg_exec_ms",
        fixed(F.col("p50"), 0).alias("p50_exec_ms"),
        fixed(F.col("p95"), 0).alias("p95_exec_ms"),
        "total_bytes_scanned",
    ).orderBy(F.desc("queries"), "warehouse_name")


_MEDIANS = ("median_total_s", "median_first_event_s", "median_input_tokens", "median_output_tokens")
_COUNTS = ("calls", "succeeded", "total_sql_calls", "vqr_hits", "empty_answers")


def latency_summary(turns: DataFrame, label: str | None = None) -> DataFrame:
    """Medians and counts per label (or for one).

    Medians use good runs after the first, or all good runs of a label that has no later one.
    """
    rows = turns if label is None else turns.where(F.col("label") == label)
    good = succeeded()
    counts = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(good).alias("succeeded"),
        F.coalesce(F.sum(F.when(good, F.col("sql_tool_uses"))), F.lit(0)).alias("total_sql_calls"),
        F.count_if(good & F.coalesce("verified_query_used", F.lit(False))).alias("vqr_hits"),
        F.count_if(good & (F.coalesce("answer_chars", F.lit(0)) == 0)).alias("empty_answers"),
        F.count_if(good & (F.col("run") > 1)).alias("_later"),
    )
    # every median twice, over later runs and over all: one pass, and no row is joined to its label
    values = {
        "total_s": F.col("total_s"),
        **{c: F.nullif(F.col(c), F.lit(0).cast(t)) for c, t in (("first_event_s", "double"), ("input_tokens", "long"), ("output_tokens", "long"))},
    }
    later = {f"{c}_later": F.when(F.col("run") > 1, v) for c, v in values.items()}
    measured = rows.where(good).select("label", *[v.alias(c) for c, v in {**values, **later}.items()])
    middle = percentiles(measured, {f"median_{c}": (c, 0.5) for c in measured.columns[1:]}, by=["label"])
    chosen = {m: F.when(F.col("_later") > 0, F.col(f"{m}_later")).otherwise(F.col(m)) for m in _MEDIANS}
    same = counts["label"].eqNullSafe(middle["label"])
    return counts.join(middle, same, "left").select(
        counts["label"],
        "calls",
        "succeeded",
        fixed(chosen["median_total_s"], 1).alias("median_total_s"),
        fixed(chosen["median_first_event_s"], 2).alias("median_first_event_s"),
        chosen["median_input_tokens"].cast("long").alias("median_input_tokens"),
        chosen["median_output_tokens"].cast("long").alias("median_output_tokens"),
        "total_sql_calls",
        "vqr_hits",
        "empty_answers",
    )


def latency_compare(turns: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every summary figure for two labels side by side, with the change."""
    first, second = labels
    summary = latency_summary(turns.where(F.col("label").isin(first, second)))
    figures = [*_COUNTS, *_MEDIANS]
    long = summary.select("label", *[F.col(c).cast("double").alias(c) for c in figures]).unpivot(
        "label", figures, "figure", "value"
    )
    return (
        long.groupBy("figure")
        .pivot("label", [first, second])
        .agg(F.first("value"))
        .withColumn("change", F.col(second) - F.col(first))
    )


def batch_summary(turns: DataFrame) -> DataFrame:
    """Turns, good turns, their SQL calls and questions per tier, and in total (tier NULL)."""
    good = succeeded()
    kept = turns.withColumn("tier", F.coalesce("tier", F.lit("unknown")))
    return kept.rollup("tier").agg(
        F.count_if(F.col("turn_index") == 0).alias("questions"),
        F.count(F.lit(1)).alias("turns"),
        F.count_if(good).alias("ok_turns"),
        F.coalesce(F.sum(F.when(good, F.col("sql_tool_uses"))), F.lit(0)).alias("sql_calls"),
    )


def fanout_vs_expected(turns: DataFrame) -> DataFrame:
    """Questions whose SQL calls fall below, inside or above the expected range, by tier."""
    calls = turns.groupBy("thread_id", "tier", "expected_lo", "expected_hi").agg(
        F.coalesce(F.sum("sql_tool_uses"), F.lit(0)).alias("_calls")
    )
    n = F.col("_calls")
    return calls.groupBy("tier").agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum("_calls").alias("sql_calls"),
        F.count_if(n < F.col("expected_lo")).alias("below"),
        F.count_if((n >= F.col("expected_lo")) & (n <= F.col("expected_hi"))).alias("within"),
        F.count_if(n > F.col("expected_hi")).alias("above"),
    )


def chain_check(turns: DataFrame) -> DataFrame:
    """The parent each turn must have: the last good reply before it in its thread.

    An opening turn has parent 0.  A follow-up without any earlier reply should not exist: ``linked``
    is false for it.
    """
    kept = turns.where(F.col("thread_id").isNotNull()).select("thread_id", "turn_index", "assistant_message_id")
    opening = kept.groupBy("thread_id").agg(F.min("turn_index").alias("_opening"))
    chained = carry_forward(kept, ["thread_id"], "turn_index", F.col("assistant_message_id"), "_parent")
    first = F.col("turn_index") == F.col("_opening")
    return chained.join(opening, "thread_id").select(
        "thread_id",
        "turn_index",
        "assistant_message_id",
        F.when(first, F.lit(0)).otherwise(F.col("_parent")).alias("parent_message_id"),
        (first | F.col("_parent").isNotNull()).alias("linked"),
    )
