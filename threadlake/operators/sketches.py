"""Percentiles from mergeable quantile sketches (KLL), one a day and group.

A day's sketch is made once from the day's facts; any range of days is answered from the sketches
alone, however many facts there were. The rank of what comes out differs from the asked one by about
``RANK_ERROR`` at most (99 in 100 cases by the sketch's design); ``ordered.nearest_rank`` is the exact
form and the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, RANK_ERROR = 400, 0.01


def daily_sketches(rows: DataFrame, keys: Sequence[str], day: str, value: str,
                   size: int = SIZE) -> DataFrame:
    """``keys, day, sketch, n``: the values of every group and day; nulls are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, day).agg(
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), size).alias("sketch"),
        F.count(F.lit(1)).alias("n"))


def merged_percentiles(sketches: DataFrame, keys: Sequence[str],
                       percents: dict[str, int]) -> DataFrame:
    """``keys, n`` and a column for each percent, over all days of ``sketches``."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"),
                                         F.sum("n").alias("n"))
    return merged.select(*keys, "n", *[
        F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias(name)
        for name, p in percents.items()])


def rank_error(rows: DataFrame, keys: Sequence[str], value: str, found: DataFrame,
               percents: dict[str, int]) -> DataFrame:
    """``keys`` and for each percent how far the rank of what was found lies from the asked one.

    The rank of a value is the range of shares from those below it to those not above it; 0 if the
    asked one lies within.
    """
    held = rows.where(F.col(value).isNotNull()).join(found, list(keys))
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[
        c for name in percents for c in (F.count_if(F.col(value) < F.col(name)).alias(f"_lt_{name}"),
                                         F.count_if(F.col(value) <= F.col(name)).alias(f"_le_{name}"))])
    return counts.select(*keys, *[F.greatest(
        F.lit(0.0), F.col(f"_lt_{name}") / F.col("_n") - p / 100,
        F.lit(p / 100) - F.col(f"_le_{name}") / F.col("_n")).alias(name) for name, p in percents.items()])
