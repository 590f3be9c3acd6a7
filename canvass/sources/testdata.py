"""The driver's tables as tables of the domain: documents are comments, their language the docket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions import text as X

MODEL, VERSION, SOURCE = "embeddings-64", "v1", "detail_comment_text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed comments: ``comment_id, docket_id, source, raw_text, normalized_text, text_hash, char_count, token_estimate``."""
    docs = table(spark, sf_dir, "documents")
    normalized = X.normalize(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("string").alias("comment_id"), F.col("lang").alias("docket_id"), "source",
        F.col("text").alias("raw_text"), normalized.alias("normalized_text"), X.text_hash(normalized).alias("text_hash"),
        X.char_count(F.col("text")).alias("char_count"), X.token_estimate(F.col("text")).alias("token_estimate"),
        (F.col("doc_id") % 3 == 0).alias("has_attachments"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment embeddings: ``comment_id, docket_id, v`` (array of double)."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("comment_id"), F.lit("all").alias("docket_id"), F.col("embedding").cast("array<double>").alias("v"))
