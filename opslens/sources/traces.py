"""Agent event rows over the ``events`` table, and thread messages over ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.functions.columns import by_position, millis_between, whole_number
from opslens.operators.spans import AgentFilter, attribute_key, flatten_spans
from opslens.sources.tables import instant, parse_attributes, read_table

AGENT = AgentFilter(database="RETAIL", agent_name="OPS_ASSISTANT", agent_type="Agent")
SPAN_NAMES = {
    "purchase": fv.AGENT_SPAN,
    "click": fv.SQL_SPAN,
    "error": fv.SQL_TOOL_SPAN,
    "signup": fv.TURN_SPAN,
}
MODELS = ("model-a", "model-b", "model-c")


def event_number(props: Column) -> Column:
    """The ``k`` of an event's properties."""
    return F.get_json_object(props, "$.k").cast("long")


def event_attributes() -> dict[str, Column]:
    """Text of every attribute an event carries, by span column; NULL attributes are left out."""
    k, kind, event_id = F.col("_k"), F.col("event_type"), F.col("event_id").cast("string")
    is_sql = kind.isin("click", "error")
    failed = is_sql & (k % 3 == 0)
    planned = (kind == "view") & (k % 9 != 0)
    turn = kind == "signup"
    user = F.col("user_id")
    other = user % 10 == 9
    third = F.floor(k / 3) % 3
    error = (
        F.when(third == 0, F.concat(F.lit("error code 000904: invalid identifier 'T.COL_"), (k % 7).cast("string"), F.lit("'")))
        .when(third == 1, F.lit("error code 001003: syntax error"))
        .otherwise(F.lit("statement timed out"))
    )
    return {
        "record_id": event_id,
        "thread_id": F.when(user % 5 == 0, fv.NO_THREAD).when(user % 7 != 0, F.concat(F.lit("t"), user.cast("string"))),
        "message_id": F.concat(F.lit("m"), event_id),
        "parent_message_id": F.when(k % 2 == 0, F.concat(F.lit("m"), (F.col("event_id") - 1).cast("string"))),
        "agent_name": F.when(other, "OTHER_ASSISTANT").otherwise(AGENT.agent_name),
        "agent_type": F.lit(AGENT.agent_type),
        "database_name": F.lit(AGENT.database),
        "question": F.when(turn & (k % 11 != 0), F.concat(F.lit("Question "), (k % 5).cast("string"))),
        "response_text": F.when(turn, F.concat(F.lit("Answer "), event_id)),
        "status": F.when(turn & (k % 19 != 0), F.when(k % 17 == 0, "FAILURE").otherwise("SUCCESS")),
        "status_description": F.when(turn & (F.col("value") > 150), "SLOW"),
        "sql_status": F.when(is_sql, F.when(failed, "ERROR").otherwise("SUCCESS")),
        "sql_error": F.when(failed, error),
        "query_id": F.when(is_sql, F.concat(F.lit("q"), event_id)),
        "final_sql": F.when(is_sql, F.concat(F.lit("SELECT "), k.cast("string"), F.lit(" AS n"))),
        "sql_warehouse": F.when(is_sql, F.concat(F.lit("WH_"), (k % 3).cast("string"))),
        "sql_num_rows": F.when(is_sql, F.when(k % 13 == 0, "n/a").otherwise((k * 10).cast("string"))),
        "verified_query_used": F.when(is_sql, F.when(k % 4 == 0, "true").otherwise("false")),
        "validation_error": F.when(failed & (k % 2 == 0), F.concat(F.lit("check failed at "), k.cast("string"))),
        "model": F.when(kind == "view", by_position(k % 3, MODELS)),
        "planning_step": F.when(kind == "view", (k % 4).cast("string")),
        "tokens_total": F.when(planned, F.when(k % 10 == 0, "12.7").otherwise((k * 23 + 1200).cast("string"))),
        "tokens_input": F.when(planned, (k * 20 + 1000).cast("string")),
        "tokens_output": F.when(planned, (k * 3 + 200).cast("string")),
        "tokens_cache_read": F.when(planned, (k * 14 + 700).cast("string")),
        "chart_status": F.when(turn & (k % 6 == 0), "SUCCESS"),
    }


def raw_event_json(spark: SparkSession, location: str) -> DataFrame:
    """Event rows as stored: attributes in JSON text under dotted keys."""
    return event_json(read_table(spark, location, "events"))


def _span_name() -> Column:
    name = F.concat(F.lit(f"{fv.PLANNING_PREFIX}-"), (F.col("_k") % 4).cast("string"))
    for kind, span in SPAN_NAMES.items():
        name = F.when(F.col("event_type") == kind, span).otherwise(name)
    return name


def _end() -> Column:
    return F.timestamp_micros(F.unix_micros(instant(F.col("ts"))) + F.round(F.col("value") * 100).cast("long") * 1000)


def _trace_id() -> Column:
    return F.concat_ws("-", "user_id", F.to_date("ts"))


def _user_name() -> Column:
    return F.concat(F.lit("user"), F.col("user_id").cast("string"))


def event_json(events: DataFrame) -> DataFrame:
    """The event-row shape of an ``events`` DataFrame, batch or streaming."""
    keyed = events.withColumn("_k", event_number(F.col("props")))
    attributes = F.struct(*[v.alias(attribute_key(c)) for c, v in event_attributes().items()])
    return keyed.select(
        instant(F.col("ts")).alias("start_timestamp"),
        _end().alias("timestamp"),
        F.to_json(F.struct(_trace_id().alias("trace_id"))).alias("trace"),
        F.to_json(F.struct(_span_name().alias("name"))).alias("record"),
        F.lit("SPAN").alias("record_type"),
        F.to_json(attributes).alias("record_attributes"),
        F.to_json(F.struct(_user_name().alias(fv.USER_NAME_KEY))).alias("resource_attributes"),
    )


def raw_events(spark: SparkSession, location: str) -> DataFrame:
    """Event rows with VARIANT attributes."""
    return parse_attributes(raw_event_json(spark, location))


def flattened(spark: SparkSession, location: str) -> DataFrame:
    """The span table, extracted from the VARIANT attributes."""
    return flatten_spans(raw_events(spark, location), AGENT)


def spans(spark: SparkSession, location: str) -> DataFrame:
    """The span table as the questions read it: typed columns, already flat.

    Same rows as ``flattened``, without the way through JSON; a question then reads only the columns
    it uses, as it would from a stored span table.
    """
    return spans_of(read_table(spark, location, "events"))


def spans_of(events: DataFrame) -> DataFrame:
    """Span rows of an ``events`` DataFrame, batch or streaming."""
    keyed = events.where(F.col("user_id") % 10 != 9).withColumn("_k", event_number(F.col("props")))
    start, end = instant(F.col("ts")), _end()
    made = {
        **event_attributes(),
        "trace_id": _trace_id(),
        "span_name": _span_name(),
        "record_type": F.lit("SPAN"),
        "start_ts": start,
        "end_ts": end,
        "event_date": F.to_date(end),
        "duration_ms": millis_between(start, end),
        "user_name": _user_name(),
    }
    numbers = {c: whole_number(made[c]) for c in fv.NUMBER_ATTRIBUTES}
    return keyed.select(*[{**made, **numbers}[c].alias(c) for c in fv.SPAN_COLUMNS])


def threads(spark: SparkSession, location: str) -> DataFrame:
    """One row per user turn of a conversation with the reply that follows it."""
    turns = read_table(spark, location, "conversations")
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response_text")
    )
    asked = turns.where(F.col("role") == "user").join(replies, ["conv_id", "turn"], "left")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    offset = F.col("conv_id") * F.lit(3_600_000_000) + F.col("turn") * F.lit(60_000_000)
    return asked.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("thread_id"),
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("trace_id"),
        F.timestamp_micros(start + offset).alias("start_ts"),
        F.lit(fv.TURN_SPAN).alias("span_name"),
        F.col("text").alias("question"),
        "response_text",
        F.when(F.col("response_text").isNull(), "FAILURE").otherwise("SUCCESS").alias("status"),
        F.when(F.length("response_text") > 1000, "SLOW").alias("status_description"),
    )
