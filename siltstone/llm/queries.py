"""The queries of this subpackage: opN_<name> -> a function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, chat, decontam, langid, line_dedup, media, ngram_join, pii, quality, toxicity
from siltstone.tables import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents")).drop("class_id", "body", "group_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_query(table(spark, sf_dir, "documents"))


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_ngram_join, op3_pii, op4_toxicity, op5_bpe, op6_line_dedup, op7_chat_rotation, op8_quality, op9_media_chunks, op10_decontamination]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_rotation": chat.ROTATE_SQL}
