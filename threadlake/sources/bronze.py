"""Bronze: incremental extraction, flattening, append-merge, reading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.constants import SECRET_COLUMNS
from threadlake.functions.scalar import iso_utc
from threadlake.schemas import bronze_schema, conform


def read_bronze(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One collection. The explicit schema fills columns that older files lack with null."""
    return spark.read.schema(bronze_schema(name)).parquet(f"{root}/{name}")


def project_out_secrets(df: DataFrame, collection: str) -> DataFrame:
    return df.drop(*SECRET_COLUMNS.get(collection, ()))


def assert_no_secrets(df: DataFrame, collection: str) -> DataFrame:
    leaked = set(SECRET_COLUMNS.get(collection, ())) & set(df.columns)
    if leaked:
        raise ValueError(f"{collection} would expose {sorted(leaked)}")
    return df


def flatten(df: DataFrame) -> DataFrame:
    """Flat bronze columns: ``_id`` becomes a string ``id``, times ISO-8601 UTC text, and
    arrays, structs and maps compact JSON text."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.name == "_id":
            out.append(col.cast("string").alias("id"))
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(iso_utc(col.cast("timestamp")).alias(field.name))
        elif isinstance(field.dataType, T.DateType):
            out.append(iso_utc(col.cast("timestamp")).alias(field.name))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out.append(F.to_json(col, {"ignoreNullFields": "false"}).alias(field.name))
        else:
            out.append(col)
    return df.select(*out)


def changed_since(df: DataFrame, column: str, watermark, inclusive: bool = False) -> DataFrame:
    """Rows updated after the watermark; everything when there is none.

    The strict comparison loses a later row whose stamp equals the watermark. ``inclusive``
    re-reads the boundary instead, which is safe because the gold layer keeps the latest
    version per id anyway. The comparison is a plain column predicate, so it reaches the scan.
    """
    if watermark is None:
        return df
    bound = F.lit(watermark)
    return df.where(F.col(column) >= bound if inclusive else F.col(column) > bound)


def next_watermark(changed: DataFrame, column: str, previous) -> DataFrame:
    """One row: the new watermark (unchanged when nothing came) and the rows extracted."""
    return changed.agg(
        F.coalesce(F.max(column), F.lit(previous)).alias("watermark"),
        F.count(F.lit(1)).alias("extracted"),
    )


def append_merge(existing: DataFrame, slice_: DataFrame) -> DataFrame:
    """Old rows and new rows, the union of their columns, missing values null."""
    return existing.unionByName(slice_, allowMissingColumns=True)


@dataclass(frozen=True)
class ExtractResult:
    rows: int
    watermark: object


class WatermarkTable:
    """Per-collection watermarks as a small append-only Parquet table.

    A missing table means a full extract; a table that cannot be read is an error. The mark
    saved last counts, also where it is lower than one before.
    """

    SCHEMA = "collection string, watermark timestamp, saved_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> dict[str, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        latest = self.spark.read.schema(self.SCHEMA).parquet(self.path).groupBy(
            "collection").agg(F.max_by("watermark", F.struct("saved_at", "watermark"))
                              .alias("watermark"))
        return {r["collection"]: r["watermark"] for r in latest.collect()}

    def save(self, marks: dict[str, object]) -> None:
        if marks:
            rows = self.spark.createDataFrame(list(marks.items()),
                                              "collection string, watermark timestamp")
            (rows.withColumn("saved_at", F.current_timestamp()).coalesce(1)
             .write.mode("append").parquet(self.path))


def extract_collection(source: DataFrame, name: str, root: str, marks: dict[str, object],
                       full_refresh: bool = False, inclusive: bool = False) -> ExtractResult:
    """Append one collection's changed rows to bronze and move its watermark.

    Appending writes only the new slice; history stays in place and the gold layer
    de-duplicates. The row count and the watermark come from one observation of the write.
    """
    previous = None if full_refresh else marks.get(name)
    clean = project_out_secrets(source, name)
    changed = changed_since(clean, "updatedAt", previous, inclusive)
    if previous is None and changed.isEmpty():
        return ExtractResult(0, marks.get(name))  # an empty source leaves bronze as it is
    seen = Observation(f"extract_{name}")
    flat = flatten(changed.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.max("updatedAt").alias("high")))
    assert_no_secrets(flat, name)
    flat = conform(flat, bronze_schema(name))
    mode = "append" if previous is not None else "overwrite"
    flat.write.mode(mode).parquet(f"{root}/{name}")
    stats = seen.get
    if stats["high"] is not None:
        marks[name] = stats["high"]
    return ExtractResult(stats["rows"], marks.get(name))
