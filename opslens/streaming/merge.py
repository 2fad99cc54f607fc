"""A derived table kept right while rows arrive late, twice or corrected.

Each batch of a stream is merged: its rows go to a store of all versions, and only the partitions it touches are
summarised anew, from the latest version of every row, and replaced.  A ledger names the batches that are done.

Every step may be repeated: a batch writes the same partitions again until the ledger has its number, so a run that stops
anywhere is finished by the next one, and a batch that comes twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.sources.sinks import delete_folder
from opslens.sources.tables import is_folder

_GONE, _BATCH = "_gone", "_batch"
_LEDGER = "batch_id long, rows long, partitions long"


@dataclass(frozen=True)
class MergedTable:
    """A summary by ``partition``, refreshed from rows with a ``key`` and a ``version``.

    ``summarise`` turns the current rows of whole partitions into the derived rows, which must keep the partition column.
    The latest version of a key counts; of equal versions the one of the later batch, and of those in one batch the largest
    row.  A version may move its key to another partition: the old one then gets a mark that the key is gone.  Rows without a key or
    partition are left out.
    """

    spark: SparkSession
    folder: str
    schema: str
    key: str
    version: str
    partition: str
    summarise: Callable[[DataFrame], DataFrame]

    def _path(self, part: str) -> str:
        return f"{self.folder.rstrip('/')}/{part}"

    def versions(self) -> DataFrame:
        """All versions of all rows, stored by partition and batch."""
        schema = f"{self.schema}, {_GONE} boolean, {_BATCH} long"
        if not is_folder(self.spark, self._path("versions")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path("versions"))

    def ledger(self) -> DataFrame:
        """One row per batch that is merged."""
        if not is_folder(self.spark, self._path("ledger")):
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(self._path("ledger"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self._path("table"))

    def _latest(self, rows: DataFrame, by: Sequence[str]) -> DataFrame:
        """The current row of each key, as an aggregate that is combined in the map tasks."""
        fields = [c for c in rows.columns if c not in (self.version, _BATCH, _GONE)]
        newest = F.max(F.struct(self.version, _BATCH, _GONE, *fields)).alias("_row")
        return rows.groupBy(*by).agg(newest).select("_row.*")

    def _marks(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """A mark for every partition, other than that of its current version, in which a key of the batch has ever been.

        Only keys, versions and partitions of the store are read.
        """
        place = [self.key, self.version, F.lit(batch_id).cast("long").alias(_BATCH), self.partition]
        mine = rows.select(*place)
        keys = rows.select(self.key).distinct()
        older = self.versions().where((F.col(_BATCH) != batch_id) & ~F.col(_GONE)).join(keys, self.key, "left_semi")
        known = mine.unionByName(older.select(self.key, self.version, _BATCH, self.partition))
        newest = known.groupBy(self.key).agg(F.max(F.struct(self.version, _BATCH, self.partition)).alias("_now"))
        places = known.select(self.key, self.partition).distinct().join(newest, self.key)
        left = places.where(F.col(self.partition) != F.col(f"_now.{self.partition}"))
        return left.select(self.key, F.col(f"_now.{self.version}").alias(self.version), self.partition, F.lit(True).alias(_GONE))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one batch; nothing happens for a batch that the ledger has."""
        if self.ledger().where(F.col("batch_id") == batch_id).take(1):
            return
        rows = batch.where(F.col(self.key).isNotNull() & F.col(self.partition).isNotNull()).withColumn(_GONE, F.lit(False))
        marked = rows.unionByName(self._marks(rows, batch_id), allowMissingColumns=True)
        stamped = marked.withColumn(_BATCH, F.lit(batch_id).cast("long"))
        self._replace(stamped, "versions", self.partition, _BATCH)

        mine = self.versions().where(F.col(_BATCH) == batch_id).groupBy(self.partition)
        touched = mine.agg(F.count_if(~F.col(_GONE)).alias("n"), F.count_if(_GONE).alias("gone")).collect()
        if touched:
            values = [r[0] for r in touched]
            whole = self._latest(self.versions().where(F.col(self.partition).isin(values)), [self.partition, self.key]).where(~F.col(_GONE))
            self._replace(self.summarise(whole.drop(_GONE, _BATCH)), "table", self.partition)
            # only a partition that rows have left may have lost its last one
            left = [r[0] for r in touched if r["gone"]]
            places = self.versions().where(F.col(self.partition).isin(left)).select(self.partition, self.key, self.version, _BATCH, _GONE)
            alive = self._latest(places, [self.partition, self.key]).where(~F.col(_GONE))
            kept = {r[0] for r in alive.select(self.partition).distinct().collect()} if left else set()
            for value in set(left) - kept:
                delete_folder(self.spark, self._path(f"table/{self.partition}={value}"))
        done = self.spark.createDataFrame([(batch_id, sum(r["n"] for r in touched), len(touched))], _LEDGER)
        done.coalesce(1).write.mode("append").parquet(self._path("ledger"))

    def _replace(self, rows: DataFrame, part: str, *by: str) -> None:
        """Replace the partitions the rows belong to and leave the others.

        Rows are gathered by the first partition column, a large partition over several tasks, so that files stay few.
        """
        writer = rows.hint("rebalance", by[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(self._path(part))

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Merge everything a stream has now; returns the table."""
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return self.read()
