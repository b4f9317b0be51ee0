"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, cascade, chat, decontam, piecescan, pii, tokencount, toxicity, urlrules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op3_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archive_and_merge(_table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.judge_quality(_table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecescan.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def url_parts_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op2_url_rules`` fixes: host, path and explicit rule of every page."""
    parts = urlrules.with_parts(_table(spark, sf_dir, "pages"))
    return parts.select("page_id", "host", "path", urlrules.explicit_rule(F.col("host"), F.col("path"), urlrules.RULES)[0].alias("rule"))


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op5_personal_data`` fixes: the base spans of every document."""
    return pii.base_personal_data(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_chat_perspectives,
    op2_url_rules,
    op3_warc_merge,
    op4_quality_cascade,
    op5_personal_data,
    op6_bag_minhash,
    op7_decontamination,
    op8_toxicity,
    op9_token_counts,
    op10_piece_scan,
    url_parts_and_rules,
    base_personal_data,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_perspectives": chat.ORACLE_SQL,
        "op3_warc_merge": warc.ORACLE_SQL,
        "op4_quality_cascade": cascade.ORACLE_SQL,
        "url_parts_and_rules": urlrules.PARTS_SQL,
        "base_personal_data": pii.BASE_SQL,
    }
