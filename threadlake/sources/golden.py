"""Golden retrieval set: JSON with questions and their anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("items array<struct<question:string,"
          "expect:array<struct<room:string,contains:string,kind:string>>>>")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, anchor_id, room, contains, kind), one row per anchor."""
    items = spark.read.schema(SCHEMA).option("multiLine", "true").json(path).select(
        F.posexplode("items").alias("query_id", "_item"))
    return items.select("query_id", F.col("_item.question").alias("question"),
                        F.posexplode("_item.expect").alias("anchor_id", "_e")).select(
        "query_id", "question", "anchor_id", "_e.room", "_e.contains", "_e.kind")
