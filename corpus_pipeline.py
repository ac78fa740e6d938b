"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next.

Rejected texts go, one document of each group of near duplicates stays, personal data is masked, sources are mixed to
their target weights and the rest is packed into sequences. All stages but the last return the columns of documents, in
their order and with further columns, whatever their names. Null and empty texts go in the first stage; the others take
them too: null text has no words, no personal data and one token. Null and repeated doc_ids, ties and very long texts are
rows like others; an empty table gives none at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import cascade, golay, mixing, packing, semicrf
from tessera.session import remove, scratch, swept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects; null and empty texts have no words and go, repeated rows stay together."""
    return cascade.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, nulls last; null and empty texts are one group."""
    return golay.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked; null text stays null, every row stays."""
    return semicrf.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them; a null source is one of its own, each of equal rows has its draw."""
    return mixing.emit(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence; null and empty texts pack their end id alone, rows of one doc_id each their own."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: No SQL: fingerprints, the learned spans and the tokenizer are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents table below sf_dir; tables that no later stage reads are deleted on the way."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
