"""From raw documents to packed sequences: quality classifier, exact deduplication, near-deduplication, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mutaspark.llm import exact_dedup, mixing, near_dedup, packing, quality
from mutaspark.llm.shared import Scratch, table

#: The classifier rejects what scores less. A filter should keep clean documents, so it cuts lower than the label 1 is predicted.
LEAST_QUALITY = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject."""
    return quality.accepted(docs, quality.learn(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    return exact_dedup.without_copies(docs, Scratch(spark, "exact"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or through others, the one with the smallest doc_id."""
    return near_dedup.without_near_copies(docs, Scratch(spark, "near"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs, Scratch(spark, "mix"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row a piece of a document, with its ids."""
    return packing.pack(docs, packing.Tokens("byte_bpe_50k.json"), Scratch(spark, "pack"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_exact_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed_to_weights),
    ("packing", packed),
]

#: SQL expresses neither the network nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
