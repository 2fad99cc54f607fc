"""The corpus pipeline: documents through the training-data operators, one stage after the other.

Rejected toxic documents go, one document of each near-duplicate group stays, passages of earlier documents and
secrets are cut out of the texts, and what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.minhash import near_duplicates
from opslens.llm.packing import pack
from opslens.llm.secret_scan import mask_secrets, secret_findings
from opslens.llm.ship import ship
from opslens.llm.store import cut, passing, release, table
from opslens.llm.substring import remove_repeats
from opslens.llm.toxicity import toxicity
from opslens.session import configure

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _ready(docs: DataFrame) -> DataFrame:
    ship(configure(docs.sparkSession))
    return docs.select(*COLUMNS)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of each row, stored, so that rows without an id of their own can be told apart."""
    return cut(_ready(docs).withColumn("row", F.monotonically_increasing_id()), "numbered-documents")


def _without(docs: DataFrame, rows: DataFrame, purpose: str) -> DataFrame:
    """Documents whose row is not among the ``rows``; those are stored first, so that what led to them can be freed."""
    gone = cut(rows.select("row"), purpose, lasting=True)
    release(docs.sparkSession)
    return docs.join(gone, "row", "left_anti").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic, each row by its own text."""
    docs = _numbered(docs)
    with passing(spark):
        return _without(docs, toxicity(docs, table(spark, sf_dir, "labels"), carry=("row",)).where("predicted = 1"), "toxic-rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id, a null id being the largest.

    Every row is a document of its own, whatever its id.  Rows without a word are no copies of each other, but those
    that are equal in all columns count once.
    """
    docs = _numbered(docs)
    with passing(spark):
        found = near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), percent=80)
        found = found.select(F.col("doc_id").alias("row"), "component_id", "n_shingles")
        thin = docs.select("row", "doc_id", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(None)).otherwise(F.struct(*COLUMNS)).alias("blank"))
        group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
        held = cut(thin.join(found, "row").select("row", "doc_id", group.alias("component"), "blank"), "near-groups")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"]
        kept = held.groupBy("component", "blank").agg(first.alias("row"))
        return _without(docs, held.join(kept, "row", "left_anti"), "duplicate-rows")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text as it is; every document stays, also one without a word left."""
    done = remove_repeats(_ready(docs), carry=("lang", "source"), layout=True)
    return _sized(done.select("doc_id", F.col("left_text").alias("text"), "lang", "source"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    docs = _ready(docs)
    return _sized(mask_secrets(docs, secret_findings(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(_ready(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

# learned scores, hashed sketches and token ids are no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
