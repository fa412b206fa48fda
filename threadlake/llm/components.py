"""Connected components of a link table, without holding any part of it outside Spark.

Alternating star contraction: in a large step every node passes its least neighbour to its greater
neighbours, in a small step to its smaller ones, until all links point at the least node of their
component. Least neighbours are aggregates, so a node with very many links is combined on the map
side, and the join back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.session import materialize

MAX_ROUNDS = 100


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1] or 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: one row per linked node, root being the least node of its component.

    Links may come in either order and repeated; links of a node to itself are ignored.
    """
    now = materialize(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            roots = now.select("v").distinct().select(F.col("v").alias("node"),
                                                      F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError("components did not settle")
