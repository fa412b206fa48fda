"""What several operators share: table access, stable keys, running totals over hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.session import materialize  # noqa: F401  (for the operators)

# Words are maximal runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def running_before(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str],
                   values: dict[str, str], slices: int = 4096) -> DataFrame:
    """For each row the sum of ``values`` over the earlier rows of its group.

    ``key`` is a uniformly random hexadecimal text, so cutting its range into ``slices`` equal
    parts is a range partitioning that needs no sampling: a group that holds a third of all rows
    is cut into as many pieces as any other. Each (group, slice) is sorted and summed by itself,
    and the totals of the earlier slices (one row per group and slice) are added. ``df`` should be
    a stored, narrow table: it is read twice. Rows equal in ``key`` and ``ties`` are adjacent in
    any order. Output names are the keys of ``values``; group columns must not be null.
    """
    cut = df.withColumn("_slice", F.floor(
        F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") * slices / F.lit(2 ** 32)
    ).cast("int"))
    here = [*group, "_slice"]
    inside = (Window.partitionBy(*here).orderBy(key, *ties)
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = (Window.partitionBy(*group).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    local = cut.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{n}")
                              for n, v in values.items()])
    totals = cut.groupBy(*here).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    offsets = totals.select(*here, *[
        F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}")
        for n in values])
    return local.join(offsets, here).select(
        *df.columns, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(n) for n in values])
