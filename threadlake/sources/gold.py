"""Gold: table writer with an observed row count, catalog views, row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from threadlake.schemas import GOLD, GOLD_TABLES
from threadlake.session import materialize

_PARTITIONED = {"fact_message": "date_key", "fact_ai_call": "date_key",
                "fact_room_activity_daily": "date_key"}


def write_gold(df: DataFrame, root: str, name: str) -> int:
    """Replace one gold table; the row count is observed while writing, not by a second job.

    Facts are laid out by day. Rows are clustered by day first so that a task writes few
    files; AQE splits a day that is too large for one task (REBALANCE).
    """
    seen = Observation(f"gold_{name}")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer_input = observed
    if name in _PARTITIONED:
        writer_input = observed.hint("rebalance", _PARTITIONED[name])
    writer = writer_input.write.mode("overwrite")
    if name in _PARTITIONED:
        writer = writer.partitionBy(_PARTITIONED[name])
    writer.parquet(f"{root}/{name}")
    return seen.get["rows"]


def replace_days(df: DataFrame, root: str, name: str, days: list[int]) -> None:
    """Replace some days of a fact; the folders of other days are not touched.

    ``df`` holds all that these days shall have. A day that has nothing any more loses its folder.
    """
    spark, day = df.sparkSession, _PARTITIONED[name]
    staged = materialize(df.where(F.col(day).isin(days)), f"days_{name}")  # it may read the table itself
    staged.hint("rebalance", day).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{root}/{name}")
    left = {r[0] for r in staged.select(day).distinct().collect()}  # at most the days given
    for gone in set(days) - left:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{day}={gone}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_gold(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One gold table. A table without rows has no files to take a schema from."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.read.schema(GOLD[name]).parquet(f"{root}/{name}")


def register_gold(spark: SparkSession, root: str) -> list[str]:
    """Temp views for the gold tables that exist, in catalog order; the rest are skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in GOLD_TABLES:
        path = hadoop(f"{root}/{name}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            read_gold(spark, root, name).createOrReplaceTempView(name)
            found.append(name)
    return found


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of every table; counts come from file footers where possible."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
