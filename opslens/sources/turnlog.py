"""Turn event logs over ``events`` and turn records over ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.functions.columns import by_position
from opslens.sources.tables import instant, read_table
from opslens.sources.traces import event_number


def turn_event_log(spark: SparkSession, location: str) -> DataFrame:
    """Events of a user's day as one turn, numbered by event id (which follows the time)."""
    events = read_table(spark, location, "events").withColumn("k", event_number(F.col("props")))
    kind, k = F.col("event_type"), F.col("k")
    event = (
        F.when(kind == "purchase", "response")
        .when(kind == "error", "error")
        .when(kind == "click", "response.tool_use")
        .when((kind == "view") & (k % 5 == 0), "response.table")
        .when((kind == "view") & (k % 5 == 1), "response.tool_result.analyst.delta")
        .when(kind == "view", "response.tool_result")
        .when(k % 7 == 0, "response.status")
        .when(k % 7 == 1, "response.thinking.delta")
        .otherwise("response.text")
    )
    return events.select(
        F.concat_ws("-", "user_id", F.to_date("ts")).alias("turn_id"),
        F.col("event_id").alias("seq"),
        event.alias("event"),
        instant(F.col("ts")).alias("t"),
        F.when(k % 13 == 0, "{not json").otherwise(_payload(k)).alias("data"),
        F.to_date("ts").cast("timestamp").alias("started"),
    )


def _payload(k: Column) -> Column:
    kind = F.col("event_type")
    q = F.concat(F.lit("q"), k.cast("string"))
    q_next = F.concat(F.lit("q"), (k + 1).cast("string"))
    done = F.format_string(
        '{"metadata": {"thread_id": %d, "assistant_message_id": %d, "usage": {"tokens_consumed": '
        '[{"input_tokens": {"total": %d}, "output_tokens": {"total": %d}}]}}}',
        F.col("user_id"), F.col("event_id"), k * 100, k * 7,
    )
    delta = F.concat(F.lit('{"delta": {"query_id": "'), q, F.lit('", "verified_query_used": '),
                     F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}}"))
    found = F.concat(
        F.lit('{"type": "'), F.when(k % 4 == 3, "other_tool").otherwise(fv.SQL_TOOL_TYPE),
        F.lit('", "content": [{"json": {"query_id": "'), q, F.lit('"}}, {"json": {"query_id": "'), q_next,
        F.lit('"}}, {"text": "note"}, {"json": {"query_id": ""}}]}'),
    )
    return (
        F.when(kind == "purchase", F.when(k % 8 == 0, "{}").otherwise(done))
        .when(kind == "error", F.concat(F.lit('{"message": "failed '), k.cast("string"), F.lit('"}')))
        .when(kind == "click", F.concat(F.lit('{"type": "'), F.when(k % 4 == 0, "other_tool").otherwise(fv.SQL_TOOL_TYPE), F.lit('"}')))
        .when((kind == "view") & (k % 5 == 0), F.concat(F.lit('{"query_id": "'), q, F.lit('"}')))
        .when((kind == "view") & (k % 5 == 1), delta)
        .when(kind == "view", found)
        .otherwise(F.concat(F.lit('{"text": "'), F.repeat(F.lit("x"), (k % 50).cast("int")), F.lit('"}')))
    )


def turn_log(spark: SparkSession, location: str) -> DataFrame:
    """One record per user turn of a conversation."""
    said = read_table(spark, location, "conversations")
    replies = said.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("_reply")
    )
    turns = said.where(F.col("role") == "user").join(replies, ["conv_id", "turn"], "left")
    conv, turn, size = F.col("conv_id"), F.col("turn"), F.length("text").cast("long")
    both = conv + turn
    failed = both % 17 == 0
    tier = conv % 6
    lows = [str(fv.EXPECTED_CALLS[t][0]) for t in fv.TIERS]
    highs = [str(fv.EXPECTED_CALLS[t][1]) for t in fv.TIERS]
    first_id = conv * 40 + turn * 4
    ids = F.transform(
        F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (both % 4).cast("int")),
        lambda i: F.concat(F.lit("q"), (first_id + i).cast("string")),
    )
    return turns.select(
        F.col("text").alias("question"),
        F.when(conv % 29 != 0, by_position(tier, fv.TIERS)).alias("tier"),
        F.when((conv * 7 + turn) % 23 == 0, 500).otherwise(200).alias("http_status"),
        F.when(failed, "turn failed").alias("error"),
        (size % 400 / F.lit(10.0)).alias("total_s"),
        F.when(turn % 5 != 4, size % 300 / F.lit(100.0)).alias("first_event_s"),
        (both % 6).cast("int").alias("sql_tool_uses"),
        ids.alias("query_ids"),
        (conv % 3 == 0).alias("verified_query_used"),
        F.coalesce("_reply", F.lit(0).cast("long")).alias("answer_chars"),
        F.when(~failed, size + 1000).alias("input_tokens"),
        F.when(~failed, size % 500).alias("output_tokens"),
        conv.alias("thread_id"),
        F.when(~failed & F.col("_reply").isNotNull(), conv * 1000 + turn).alias("assistant_message_id"),
        F.floor(turn / 2).cast("int").alias("turn_index"),
        by_position(tier, lows, "int").alias("expected_lo"),
        by_position(tier, highs, "int").alias("expected_hi"),
        F.array(by_position(conv % 4, ("daily_sales", "inventory", "returns", "products"))).alias("clause_tables"),
        F.when(conv % 2 == 0, "baseline").otherwise("optimized").alias("label"),
        (F.floor(conv / 2) % 2 + 1).cast("int").alias("run"),
    )
