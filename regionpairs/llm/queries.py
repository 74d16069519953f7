"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown_lm, centroids, conversations, decontaminate, jaccard_join, line_dedup, media, oracles, packing, quality, token_files, toxicity, url_filter
from .common import table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.inspect(media.pack(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes", "declared"])
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "sniffed", "corrected", "embedded")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)
    return token_files.digests(spark, folder)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), k=3, pct=90)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_media, op2_quality, op3_url_filter, op4_brown_lm, op5_token_files, op6_jaccard_join, op7_decontaminate, op8_line_dedup, op9_bpe, op10_toxicity, op11_centroids, op12_packing, op13_conversations)}
ORACLE_SQL: dict[str, str] = {"op3_url_filter": url_filter.ORACLE, "op6_jaccard_join": oracles.JACCARD, "op7_decontaminate": oracles.DECONTAMINATION, "op11_centroids": centroids.ORACLE, "op13_conversations": conversations.ORACLE}
