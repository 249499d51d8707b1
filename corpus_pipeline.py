"""From raw documents to packed sequences, in five stages that each use one of the text operators.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet and hands what
it reads back to the next stage. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlab.llm.exact_dedup import drop_exact_duplicates
from embedlab.llm.language import keep_identified
from embedlab.llm.near_dedup import drop_near_duplicates
from embedlab.llm.packing import pack_documents
from embedlab.llm.privacy import redact_documents
from embedlab.llm.rows import kept
from embedlab.sources.tables import read_table


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; learns from the labels of ``docs``."""

    return keep_identified(docs)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest id."""

    return drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class keep the smallest id."""

    return drop_near_duplicates(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows the new text."""

    return redact_documents(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut into tokens and pack into sequences."""

    return pack_documents(docs)


STAGES = [
    ("language", identified_language),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed_sequences),
]

#: the classifiers and the packing have no SQL form; the tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
