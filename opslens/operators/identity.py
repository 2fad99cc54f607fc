"""Tables laid out by id: bucketed and sorted by a long key, for lookups of one bucket and joins without a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.columns import ratio
from opslens.functions.joins import join_dimension
from opslens.sources.sinks import create_table_as, work_folder

BUCKETS, IDS_A_BUCKET = 16, 500_000


@dataclass(frozen=True)
class KeyedTables:
    """The names of tables bucketed by one long key, and the ids behind the keys."""

    spark: SparkSession
    key: str
    ids: DataFrame
    names: dict[str, str]

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def key_of(self, value) -> int | None:
        """The key of an id; one small row, found by the sort order of the stored ids."""
        found = self.ids.where(F.col(self.ids.columns[0]) == value).select(self.key).first()
        return found[0] if found else None


def write_keyed(tables: dict[str, DataFrame], id_column: str, key: str, buckets: int | None = None) -> KeyedTables:
    """Store tables that share an id bucketed and sorted by a long ``key``, one file a bucket.

    Keys are numbers given to the distinct ids of all tables once and stored, so text ids are compared only while the tables
    are written.  ``buckets`` should make files of some hundred MB; without it there is one for every ``IDS_A_BUCKET`` rows of
    the first table, which should be the largest, so a task that sorts or reads a bucket needs no more memory on larger tables.
    Rows without an id keep a NULL key.
    """
    first = next(iter(tables.values()))
    spark = first.sparkSession
    buckets = buckets or max(BUCKETS, -(-first.count() // IDS_A_BUCKET))
    every = None
    for rows in tables.values():
        own = rows.select(id_column).where(F.col(id_column).isNotNull())
        every = own if every is None else every.unionAll(own)
    # sorted by id, so that footers lead to the file of an id
    distinct = every.distinct().repartitionByRange(buckets, id_column).sortWithinPartitions(id_column)
    ids = create_table_as(distinct.withColumn(key, F.monotonically_increasing_id()), work_folder(spark, f"{key}-ids"))
    names = {}
    for name, rows in tables.items():
        keyed = rows.join(ids, id_column, "left")
        names[name] = f"{name}_by_{key}_{uuid.uuid4().hex[:12]}"
        writer = keyed.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        writer.option("path", work_folder(spark, names[name])).saveAsTable(names[name])
    return KeyedTables(spark, key, ids, names)


def lookup_by_key(table: DataFrame, key: str, value: int) -> DataFrame:
    """Rows of one key: Spark opens the bucket that can hold it and no other file."""
    return table.where(F.col(key) == F.lit(value).cast("long"))


def return_rate_by_category(sales: DataFrame, returns: DataFrame, products: DataFrame, key: str = "sale_key") -> DataFrame:
    """Distinct returns per distinct sale by category, over tables bucketed by sale.

    Aggregates and the join by sale use the buckets as they are; what travels is one row per task and category.
    """
    returned = returns.groupBy(key).agg(F.count_distinct("return_id").alias("_returns"))
    sold = sales.groupBy(key, "product_id").agg(F.lit(1).alias("_one")).join(returned, key, "left")
    named = join_dimension(sold, products.select("product_id", "category"), "product_id")
    per_sale = named.groupBy(key, "category").agg(F.max("_returns").alias("_returns"))
    counted = per_sale.groupBy("category").agg(F.coalesce(F.sum("_returns"), F.lit(0)).alias("return_count"), F.count(F.lit(1)).alias("transaction_count"))
    rate = ratio(F.col("return_count"), F.col("transaction_count"), 2, 100)
    return counted.withColumn("return_rate_pct", rate).orderBy(F.desc_nulls_first("return_rate_pct"), "category")


def exchanges(rows: DataFrame) -> Sequence[str]:
    """The shuffles of a plan as Spark describes them; for tests and reports."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]
