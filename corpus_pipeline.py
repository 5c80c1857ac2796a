"""The corpus pipeline: quality rules, quality classifier, near duplicates, benchmark text, pieces.

Each stage takes (spark, docs, sf_dir), works on everything the stage before it kept, and returns
the columns of documents, except the last, which returns the encoded documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motionloom.llm.common import drop, fold_of, materialise, table
from motionloom.llm.decontaminate import clean_of
from motionloom.llm.near_dup import keep_one
from motionloom.llm.piece_codec import encode_pieces
from motionloom.llm.quality_model import keep_predicted
from motionloom.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the threshold table."""
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees call good; fitted on the labelled ones outside the held-out fifth."""
    return keep_predicted(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, one with the least id, of each class of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces and decoded text of every document that is left."""
    # The workers serve other stages too, so nothing is remembered beyond a task.
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), cache_size=150_000, pair_size=100_000, keep=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: The classifier and the near duplicates are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop(before)  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
