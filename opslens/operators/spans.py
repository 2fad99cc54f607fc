"""Agent events to the flat span table.

The same projection serves batch reads, an always-current view and a stream (see
``opslens.streaming``), so a stream and a batch run cannot drift apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import fixed_values as fv
from opslens.functions.columns import attribute, millis_between, whole_number


@dataclass(frozen=True)
class AgentFilter:
    """Which agent's events to keep: three literal attribute values."""

    database: str
    agent_name: str
    agent_type: str


def attribute_key(column: str, namespace: str = fv.ATTRIBUTE_NAMESPACE) -> str:
    """The attribute key behind a span column."""
    known = {**fv.TEXT_ATTRIBUTES, **fv.NUMBER_ATTRIBUTES}
    return fv.RECORD_ID_KEY if column == "record_id" else f"{namespace}.{known[column]}"


def keep_agent(events: DataFrame, agent: AgentFilter, namespace: str = fv.ATTRIBUTE_NAMESPACE) -> DataFrame:
    """Rows of one agent, before anything else is extracted.

    The three values are read as one struct and compared as one, so the attributes are opened once
    per row for the filter, however many keys it tests.
    """
    wanted = {"database_name": agent.database, "agent_name": agent.agent_name, "agent_type": agent.agent_type}
    keys = {c: attribute_key(c, namespace) for c in wanted}
    fields = ", ".join(f"`{keys[c]}`: string" for c in wanted)
    found = F.try_variant_get(F.col("record_attributes"), "$", f"struct<{fields}>")
    return events.where(found == F.struct(*[F.lit(v).alias(keys[c]) for c, v in wanted.items()]))


def _span_columns(value: dict[str, Column]) -> dict[str, Column]:
    """All span columns in table order, given the text of each attribute."""
    made = {
        **value,
        "trace_id": attribute(F.col("trace"), "trace_id"),
        "span_name": attribute(F.col("record"), "name"),
        "record_type": F.col("record_type").cast("string"),
        "start_ts": F.col("start_timestamp"),
        "end_ts": F.col("timestamp"),
        "event_date": F.to_date("timestamp"),
        "duration_ms": millis_between(F.col("start_timestamp"), F.col("timestamp")),
        "user_name": attribute(F.col("resource_attributes"), fv.USER_NAME_KEY),
        **{column: whole_number(value[column]) for column in fv.NUMBER_ATTRIBUTES},
    }
    return {column: made[column] for column in fv.SPAN_COLUMNS}


ATTRIBUTE_COLUMNS = ("record_id", *fv.TEXT_ATTRIBUTES, *fv.NUMBER_ATTRIBUTES)


def span_columns(namespace: str = fv.ATTRIBUTE_NAMESPACE) -> dict[str, Column]:
    """Every span column as an expression of its own, so unused ones are pruned."""
    attributes = F.col("record_attributes")
    return _span_columns({c: attribute(attributes, attribute_key(c, namespace)) for c in ATTRIBUTE_COLUMNS})


def _select(columns: dict[str, Column], events: DataFrame) -> DataFrame:
    return events.select(*[expression.alias(name) for name, expression in columns.items()])


def flatten_spans(
    events: DataFrame, agent: AgentFilter | None = None, namespace: str = fv.ATTRIBUTE_NAMESPACE
) -> DataFrame:
    """The 34-column span table of an event table with VARIANT attributes.

    All attributes are read in one pass over the variant, as one struct: about half the time of
    one lookup per column, and generated code small enough to be compiled.
    """
    kept = keep_agent(events, agent, namespace) if agent else events
    fields = ", ".join(f"`{attribute_key(c, namespace)}`: string" for c in ATTRIBUTE_COLUMNS)
    opened = kept.withColumn("_attributes", F.try_variant_get(F.col("record_attributes"), "$", f"struct<{fields}>"))
    found = {c: F.col("_attributes").getField(attribute_key(c, namespace)) for c in ATTRIBUTE_COLUMNS}
    return _select(_span_columns(found), opened)


def span_view(
    events: DataFrame, agent: AgentFilter | None = None, namespace: str = fv.ATTRIBUTE_NAMESPACE
) -> DataFrame:
    """The same table for readers of a few columns: one lookup per column, unused ones never made."""
    kept = keep_agent(events, agent, namespace) if agent else events
    return _select(span_columns(namespace), kept)


def span_durations(events: DataFrame) -> DataFrame:
    """Derived duration and date per record."""
    made = span_columns()
    wanted = ("record_id", "trace_id", "start_ts", "end_ts", "event_date", "duration_ms")
    return events.select(*[made[c].alias(c) for c in wanted])


def numeric_attributes(events: DataFrame, namespace: str = fv.ATTRIBUTE_NAMESPACE) -> DataFrame:
    """Each numeric attribute as text and as a number, NULL where the text is none."""
    attributes = F.col("record_attributes")
    columns = [attribute(attributes, fv.RECORD_ID_KEY).alias("record_id")]
    for column in fv.NUMBER_ATTRIBUTES:
        text = attribute(attributes, attribute_key(column, namespace))
        columns += [text.alias(f"{column}_text"), whole_number(text).alias(column)]
    return events.select(*columns)


def attribute_profile(spans: DataFrame) -> DataFrame:
    """How many rows of each span name carry each attribute."""
    attributes = [c for c in spans.columns if c in fv.TEXT_ATTRIBUTES or c in fv.NUMBER_ATTRIBUTES]
    counts = spans.groupBy("span_name").agg(*[F.count(c).alias(c) for c in attributes])
    return counts.unpivot("span_name", attributes, "attribute", "occurrences")
