"""A training corpus from raw documents: filter, deduplicate, redact, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossmill.llm import jaccard, mixing, packing, quality, secrets, simhash
from glossmill.llm.common import drop_table, settled, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on the labelled documents, does not reject."""
    return quality.accepted(docs, quality.trained(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that share 80 % of their five-word shingles: SimHash groups, verified and completed."""
    return simhash.one_of_each(docs, jaccard.near_duplicates)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.take_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its text, its bin and its place there; a bin's pieces in order are a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the components and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again.

    What a stage has stored on its way goes when its result is written, and so does the result once the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if before:
            drop_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
