"""Registry of queries and their reference SQL.

A query is a function ``(spark, sf_dir) -> DataFrame``. Its reference SQL is plain DuckDB
text over the Parquet tables; the common table expressions it names are added in front.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.plans.oracle_views import with_views
from threadlake.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# the same SQL before the views are put in front, for queries that share it
PLAIN_SQL: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that results compare equal across engines and zones."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd").alias(field.name)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        out.append(col)
    return df.select(*out)


def query(key: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(use_utc(spark), sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle is not None:
            PLAIN_SQL[key] = oracle
            ORACLES[key] = with_views(oracle)
        return fn

    return register
