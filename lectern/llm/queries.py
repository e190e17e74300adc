"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import images, lines, mixing, passages, pieces, private, quality, vectors, warc
from lectern.llm.common import table
from lectern.llm.simhash import simhash_components


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.checked(table(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.report(table(spark, sf_dir, "documents"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.search_rendered(table(spark, sf_dir, "embeddings"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeated_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").alias("n_dropped"), F.sha2(F.array_join(F.col("dropped").cast("array<string>"), ","), 256).alias("dropped_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).selectExpr("row_id AS page_id", "payload_bytes", "payload_digest", "type AS record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_passages": op2_passages,
    "op3_private": op3_private,
    "op4_vectors": op4_vectors,
    "op5_quality": op5_quality,
    "op6_images": op6_images,
    "op7_lines": op7_lines,
    "op8_warc": op8_warc,
    "op9_pieces": op9_pieces,
    "op10_mix": op10_mix,
}

SQL: dict[str, str] = {
    "op4_vectors": vectors.SQL,
    "op8_warc": warc.SQL,
    "op10_mix": mixing.SQL,
}
