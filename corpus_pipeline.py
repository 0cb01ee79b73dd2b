"""Corpus pipeline: every stage works on the documents that the one before it kept.

Quality classifier, line dedup, near-duplicate removal, suffix-array dedup, packing. All stages
but the last return the columns of documents; a stage's result is written as Parquet and read
again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stintwise.llm import jaccard, linededup, packing, quality, suffixes
from stintwise.llm.common import read_table, stored_table
from stintwise.llm.queries import LEAST, QUALITY_HELD_OUT, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it learns from the labelled ones among them."""
    labels = read_table(spark, sf_dir, "labels").selectExpr("doc_id", "quality as label")
    model = quality.learnt(quality.stored_features(docs), labels, QUALITY_HELD_OUT)
    return quality.accepted(docs, model, LEAST)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of every class of lines within two edits."""
    return linededup.without_repeated_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of every group of near copies."""
    return jaccard.deduplicated(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out strings of 100 bytes that start earlier."""
    return suffixes.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenization, the classifier and edit distances have no SQL form; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
