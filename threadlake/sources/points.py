"""Point table: vectors keyed by a deterministic point id, in append-only Parquet.

Every upsert or delete writes one folder ``seq=<n>`` and nothing else; the newest row of a
point id is the current one. Cost follows the batch and not the table, a retried batch
overwrites its own folder, and a replayed message changes nothing. ``compact`` folds the
history into a fresh table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.ordered import top_within


def newest_version(batch: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the greatest in ``order`` (when it was edited). Only versions equal in
    it, or all of them where no order is named, are told apart by their other columns."""
    rest = [F.col(c).desc_nulls_last() for c in
            [*order, *sorted(c for c in batch.columns
                             if c not in keys and c not in order and c != "vector")]]
    return top_within(batch, keys, rest or keys, 1, "_v").drop("_v")


def merge_points(stored: DataFrame, batch: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Stored points with the batch's points in place of those of the same id.

    Replays change nothing. Within a batch the newest version of a point wins.
    """
    latest = newest_version(batch, ["point_id"], order)
    kept = stored.join(latest.select("point_id"), "point_id", "left_anti")
    return kept.unionByName(latest)


def delete_by(points: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Points whose ``column`` (room_id or doc_id) is not in the delete list."""
    return points.join(gone.select(column).distinct(), column, "left_anti")


def count_points(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("points"))


class PointTable:
    """Rows keyed by ``keys``; ``schema`` is DDL and includes them."""

    def __init__(self, spark: SparkSession, root: str, schema: str,
                 keys: tuple[str, ...] = ("point_id",), order: tuple[str, ...] = ()):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.keys, self.order = list(keys), tuple(order)

    def _history(self) -> DataFrame:
        ddl = f"{self.schema}, deleted boolean, seq bigint"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(self.root)

    def read(self) -> DataFrame:
        """Current points."""
        latest = top_within(self._history(), self.keys, [F.desc("seq")], 1, "_v")
        return latest.where(~F.coalesce("deleted", F.lit(False))).drop("_v", "seq", "deleted")

    def next_seq(self) -> int:
        """One more than the highest sequence number in use."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return 1 + max((int(n[4:]) for n in names if n.startswith("seq=")), default=-1)

    def _append(self, rows: DataFrame, seq: int | None) -> None:
        seq = self.next_seq() if seq is None else seq
        rows.write.mode("overwrite").parquet(f"{self.root}/seq={seq}")

    def upsert(self, batch: DataFrame, seq: int | None = None) -> None:
        """Add a batch, by default as the newest; an empty batch writes nothing.

        A stream passes its own numbers, so that a repeated batch replaces itself.
        """
        if batch.isEmpty():
            return
        one = newest_version(batch, self.keys, self.order)
        self._append(one.withColumn("deleted", F.lit(False)), seq)

    def delete_by(self, column: str, gone: DataFrame, seq: int | None = None) -> None:
        """Tombstones for the points of the listed rooms or documents."""
        doomed = self.read().join(gone.select(column).distinct(), column, "left_semi")
        self._append(doomed.withColumn("deleted", F.lit(True)), seq)

    def compact(self, root: str) -> PointTable:
        """The current points as the first entry of a new table."""
        self.read().withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(
            f"{root}/seq=0")
        return PointTable(self.spark, root, self.schema, tuple(self.keys), self.order)
