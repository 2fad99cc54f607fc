"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.ship import ship
from opslens.llm.store import table
from opslens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def prepared(spark: SparkSession, location: str) -> DataFrame:
        return run(ship(configure(spark)), location)

    QUERIES[run.__name__] = prepared
    return run


@query
def op2_substring_dedup(spark: SparkSession, location: str) -> DataFrame:
    """What the word windows of smaller documents leave of every document."""
    from opslens.llm.substring import remove_repeats

    out = remove_repeats(table(spark, location, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_embedding_near_dedup(spark: SparkSession, location: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    from opslens.llm.embedding_dedup import near_vectors

    return near_vectors(table(spark, location, "embeddings"), 0.95)


@query
def op4_best_fit_packing(spark: SparkSession, location: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 2048 tokens."""
    import public_tokenizers
    from opslens.llm.packing import pack

    return pack(table(spark, location, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_toxicity(spark: SparkSession, location: str) -> DataFrame:
    """A toxicity score for every document."""
    from opslens.llm.toxicity import toxicity

    return toxicity(table(spark, location, "documents"), table(spark, location, "labels"))


@query
def op6_byte_bpe(spark: SparkSession, location: str) -> DataFrame:
    """Encoding and decoding of every document."""
    import public_tokenizers
    from opslens.llm.bpe import encode

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encode(table(spark, location, "documents"), path, pattern)


@query
def op7_nearest_neighbours(spark: SparkSession, location: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    from opslens.llm.nearest import nearest_vectors

    return nearest_vectors(table(spark, location, "embeddings"), every=20, nearest=20)


@query
def op8_secret_scan(spark: SparkSession, location: str) -> DataFrame:
    """Every candidate of every document with the forest's score."""
    from opslens.llm.secret_scan import secret_findings

    found = secret_findings(table(spark, location, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query
def op9_html_extraction(spark: SparkSession, location: str) -> DataFrame:
    """The main text of every page."""
    from opslens.llm.html_text import extract_text

    return extract_text(table(spark, location, "pages"))


@query
def op10_minhash_near_dedup(spark: SparkSession, location: str) -> DataFrame:
    """Components of near-duplicate documents at a similarity of 0.85."""
    from opslens.llm.minhash import near_duplicates

    return near_duplicates(table(spark, location, "documents"), percent=85)


@query
def op11_warc(spark: SparkSession, location: str) -> DataFrame:
    """Every page as a record of an archive that is written, committed and read back."""
    from opslens.llm.warc import read_warc, write_warc
    from opslens.sources.sinks import work_folder

    folder = work_folder(spark, "warc")
    write_warc(table(spark, location, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op12_collocations(spark: SparkSession, location: str) -> DataFrame:
    """The first 2000 phrases of two and three words of every language."""
    from opslens.llm.collocations import collocations

    return collocations(table(spark, location, "documents"))


@query
def op13_whitening(spark: SparkSession, location: str) -> DataFrame:
    """Sixteen whitened components of every vector."""
    from opslens.llm.whitening import whiten

    out = whiten(table(spark, location, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


@query
def op1_chat_format(spark: SparkSession, location: str) -> DataFrame:
    """Rendered turns of all maximal conversations."""
    from opslens.llm.chat import format_chats

    return format_chats(table(spark, location, "conversations"))


def _oracles() -> dict[str, str]:
    from opslens.llm import chat, collocations, warc

    return {"op1_chat_format": chat.ORACLE, "op11_warc": warc.ORACLE, "op12_collocations": collocations.ORACLE}


ORACLES.update(_oracles())
