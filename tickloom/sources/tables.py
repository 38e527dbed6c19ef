"""Readers for the given tables; column pruning and filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_request_log(table(spark, sf_dir, "events"))


def as_request_log(events: DataFrame) -> DataFrame:
    """Requests per user: label, latency in seconds, outcome, cache hit; for a table or a stream."""
    return events.select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("key"),
        F.col("ts"),
        F.col("event_type").alias("label"),
        (F.col("value") / 50.0).alias("latency_s"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("event_id") % 3 == 0).alias("from_cache"),
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model training runs per ticker with status, error and training date."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "ready")
        .when(F.col("o_orderstatus") == "O", "training")
        .otherwise("failed")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("ticker"),
        F.col("o_orderkey").alias("run_id"),
        status.alias("status"),
        F.col("o_totalprice").alias("rmse"),
        F.col("o_orderdate").cast("date").alias("trained_at"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts per source; a higher id is a more recent text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), F.col("source").alias("grp"), F.col("lang"), F.col("text")
    )
