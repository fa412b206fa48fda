"""Feedback export: rated model calls, newest first, as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.constants import FEEDBACK_EXPORT_CAP

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
EXPORT_COLUMNS = ("question", "answer", "verdict", "retrieved_keys", "kind", "provider",
                  "created_at")


def newest_rated(calls: DataFrame, cap: int = FEEDBACK_EXPORT_CAP) -> DataFrame:
    """The report keeps the ``cap`` newest rated calls (a top-k, planned as one)."""
    rated = calls.where(F.col("verdict").isNotNull())
    return rated.orderBy(F.desc("created_at"), F.desc("stream_id")).limit(cap)


def export_feedback(calls: DataFrame, path: str, cap: int = FEEDBACK_EXPORT_CAP) -> str:
    (newest_rated(calls, cap).withColumnRenamed("source_keys", "retrieved_keys")
     .select("stream_id", *EXPORT_COLUMNS).coalesce(1)
     .write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(path))
    return path


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(
        "stream_id bigint, question string, answer string, verdict string, "
        "retrieved_keys string, kind string, provider string, created_at timestamp")
        .option("timestampFormat", TIME_FORMAT).json(path))
