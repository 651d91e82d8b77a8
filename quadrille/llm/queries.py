"""Queries of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, language_id, license_scan, media, near_dedup, packing, quality, source_mix, url_filter
from .common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_all(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "finish", "copies")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labels(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_all(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_format.digests(chat_format.format_chats(chat_format.with_hard_case(spark, rows)))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_source_mix": op4_source_mix,
    "op5_near_dedup": op5_near_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat_format": op9_chat_format,
    "op10_media_columns": op10_media_columns,
}
