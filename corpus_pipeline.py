"""A training-corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor
kept; :func:`run` writes each stage's result to the shared folder and reads it back
as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrace.llm.common import materialize, table
from terrace.llm.exact_dedup import exact_dedup
from terrace.llm.near_text import drop_near_duplicates
from terrace.llm.packing import pack_documents
from terrace.llm.substring_dedup import remove_repeats
from terrace.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash finds candidates, five-word shingles with a Jaccard similarity of 0.8 or more decide."""
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long passages that repeat are cut out; every document stays, with what is left of it."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2,048 ids: one row per piece."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packing)]

#: Toxicity is a trained model, packing needs a tokenizer: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
