"""The corpus pipeline: toxic documents go, then repeated lines, near duplicates and repeated passages; what stays is packed.

Every stage reads the table that the one before wrote and decides on all of it. Rows with empty texts stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placewright.llm import bwt_repeats, line_dedup, packing, toxicity, weighted_minhash
from placewright.llm.queries import vocabulary
from placewright.llm.staging import staged, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of ``docs``' rows outside the held-out fold."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals, or nearly, are taken out of the texts."""
    return line_dedup.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate documents the one with the least doc_id stays."""
    return weighted_minhash.one_of_each(docs, threshold=0.8, size=5)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that stand anywhere else too are taken out of the texts."""
    return bwt_repeats.drop_repeats(docs, length=200)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary(), capacity=1024, end_id=2)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("suffix_dedup", without_repeated_passages),
    ("packing", packed),
]

#: No SQL can say what a stage keeps (trained weights, byte-pair merges): the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each over everything that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
