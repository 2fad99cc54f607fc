"""The query catalog: one entry per operator, with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.catalog.sqltext import oracle
from opslens.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
BODIES: dict[str, str] = {}


def oracles() -> dict[str, str]:
    """Complete oracle SQL per query, with the table expressions of all catalog modules."""
    return {name: oracle(body) for name, body in BODIES.items()}


def exported(rows: DataFrame) -> DataFrame:
    """Decimals leave the catalog as doubles, so both engines hand over the same number type."""
    decimals = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return rows.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else rows


def entry(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle body."""

    def register(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, location: str) -> DataFrame:
            return exported(query(configure(spark), location))

        QUERIES[name] = run
        if sql is not None:
            BODIES[name] = sql
        return query

    return register
