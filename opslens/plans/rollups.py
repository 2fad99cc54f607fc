"""Stored rollups of metric queries: additive measures by a few dimensions, and the smallest one that answers a query.

A rollup holds the measures of one base table's metrics, summed by dimensions of that table or of tables it leads to.
It answers every query whose metrics, dimensions and conditions it covers, with the rows that the base gives, since sums
and counts may be summed again.  A catalog of one row per rollup is stored beside them, so later sessions find them.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.plans.model import RETAIL_MODEL, Dimension, Metric, Model, Tables
from opslens.plans.query import Where, aggregate_base, find_dimension, find_metric, semantic_query
from opslens.sources.tables import is_folder

_CATALOG = "base string, metrics array<string>, dimensions array<string>, version string, size long, path string"


@dataclass(frozen=True)
class Rollup:
    """``dimensions`` are ``table.name``; ``version`` is the state of the base it was made from."""

    base: str
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...]
    version: str
    size: int
    path: str


def _full(dimension: Dimension) -> str:
    return f"{dimension.table}.{dimension.name}"


class RollupStore:
    """Rollups under one folder.

    ``versions`` given to a query name the present state of each base table: any text that changes with the rows of
    the base or of a dimension it joins, such as the last batch of a merged refresh or a snapshot's id.  A rollup of
    another version is stale and never read; neither is any rollup of a base without a version.
    """

    def __init__(self, spark: SparkSession, folder: str, model: Model = RETAIL_MODEL) -> None:
        self.spark, self.folder, self.model = spark, folder.rstrip("/"), model

    def rollups(self) -> list[Rollup]:
        """The catalog, one row per rollup that was built."""
        if not is_folder(self.spark, f"{self.folder}/catalog"):
            return []
        rows = self.spark.read.schema(_CATALOG).parquet(f"{self.folder}/catalog").collect()
        return [Rollup(r["base"], tuple(r["metrics"]), tuple(r["dimensions"]), r["version"], r["size"], r["path"]) for r in rows]

    def build(self, tables: Tables, metrics: Sequence[str], dimensions: Sequence[str], version: str) -> Rollup:
        """Store the metrics of one base table by the dimensions.  The catalog names it only when its rows are complete."""
        wanted = [find_metric(m, self.model) for m in metrics]
        groups = [find_dimension(d, self.model) for d in dimensions]
        bases = {m.table for m in wanted}
        if len(bases) != 1 or None in bases:
            raise ValueError(f"a rollup has metrics of one base table, not of {sorted(map(str, bases))}")
        (base,) = bases
        path = f"{self.folder}/{base}-{uuid.uuid4().hex[:12]}"
        aggregate_base(tables, base, wanted, groups, [], self.model).write.parquet(path)
        size = self.spark.read.parquet(path).count()
        made = Rollup(base, tuple(m.name for m in wanted), tuple(map(_full, groups)), version, size, path)
        self.spark.createDataFrame([asdict(made)], _CATALOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/catalog")
        return made

    def smallest(self, base: str, metrics: Sequence[str], dimensions: Sequence[str], version: str | None) -> Rollup | None:
        """The fresh rollup with the fewest rows that has these metrics and dimensions (``table.name``), or none."""
        fit = [
            r for r in self.rollups()
            if r.base == base and r.version == version and set(metrics) <= set(r.metrics) and set(dimensions) <= set(r.dimensions)
        ]
        return min(fit, key=lambda r: (r.size, r.path), default=None)

    def query(
        self,
        tables: Tables,
        versions: Mapping[str, str],
        metrics: Sequence[str],
        dimensions: Sequence[str] = (),
        where: Sequence[Where] = (),
        order_by: Sequence[str] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """``semantic_query`` that reads, for each base table, a rollup where a fresh one covers what is asked."""

        def block(
            tables: Tables, base: str, metrics: Sequence[Metric], groups: Sequence[Dimension],
            tests: Sequence[tuple[Dimension, Where]], model: Model,
        ) -> DataFrame:
            asked = [_full(d) for d in [*groups, *[d for d, _ in tests]]]
            found = self.smallest(base, [m.name for m in metrics], asked, versions.get(base))
            rows = self.spark.read.parquet(found.path) if found else None
            if rows is None or any(d.table != base and self._takes_missing(rows, d, w) for d, w in tests):
                return aggregate_base(tables, base, metrics, groups, tests, model)
            if tests:
                rows = rows.where(reduce(lambda a, b: a & b, [w.on(F.col(d.name)) for d, w in tests]))
            sums = [F.sum(f"{m.name}__{n}").alias(f"{m.name}__{n}") for m in metrics for n in m.measures]
            names = [g.name for g in groups]
            return rows.groupBy(*names).agg(*sums) if names else rows.agg(*sums)

        return semantic_query(tables, metrics, dimensions, where, order_by, limit, self.model, block)

    def _takes_missing(self, rows: DataFrame, dimension: Dimension, test: Where) -> bool:
        """Whether a condition holds for a missing value: a rollup can't tell a missing attribute from a missing parent row."""
        kind = rows.schema[dimension.name].dataType
        return bool(self.spark.sql("SELECT NULL AS v").select(test.on(F.col("v").cast(kind))).first()[0])
