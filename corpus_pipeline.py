"""From raw documents to token ids: five stages over the whole table, each on all that its predecessor kept.

Every stage's result is written as Parquet in the shared folder and read again as the next one's documents. Stages keep all
columns of documents but the last. An empty table passes through as an empty one; rows with a null or repeated doc_id are
judged as rows, except where a stage says otherwise; null and empty texts are kept by every filter but the first, which
judges them as it does others. Texts are worked on whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from regionpairs.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from regionpairs.llm.common import table, through_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go, each row by its own text."""
    return quality.keep_good(docs)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left. Rows that repeat a document (id and text) share its result; null ids come first."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays, with all its rows. Rows with a null doc_id stay."""
    return jaccard_join.one_of_each(docs, k=5, pct=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, one row per row."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality_filter), ("line_dedup", line_runs), ("near_duplicates", near_duplicates), ("decontamination", benchmark_free), ("bpe", token_ids)]

# Expectation-maximisation, a trained scorer and a tokenizer aren't SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = through_table(stage(spark, docs, sf_dir), name)
    return docs
