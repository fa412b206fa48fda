"""Running streams: a session of their own, finite runs, keyed result tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlake.session import scratch_path, use_utc
from threadlake.sources.points import PointTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session whose settings fit keyed state, leaving the caller's settings alone.

    State lives in RocksDB, off the heap, so it may outgrow executor memory. The number of
    state partitions is fixed for the life of a checkpoint: one per core by default.
    """
    own = use_utc(spark.newSession())
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.shuffle.partitions",
                 str(state_partitions or spark.sparkContext.defaultParallelism))
    return own


def run_to_table(stream: DataFrame, label: str, checkpoint: str | None = None,
                 out: str | None = None) -> str:
    """Process what is available and append it to a Parquet table; returns its path."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-ckpt"))
             .option("path", out).trigger(availableNow=True).start())
    query.awaitTermination()
    return out


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], label: str,
                checkpoint: str | None = None, mode: str = "append") -> None:
    """Process what is available, one micro-batch after the other.

    ``handle`` must be idempotent per batch id: a batch is repeated after a failure.
    """
    spark = stream.sparkSession
    query = (stream.writeStream.foreachBatch(handle).outputMode(mode)
             .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-ckpt"))
             .trigger(availableNow=True).start())
    query.awaitTermination()


def first_number(spark: SparkSession, checkpoint: str | None, following: int) -> int:
    """Number of the first batch that a stream writes to a table of numbered batches.

    It is kept beside the checkpoint, so a stream that goes on after a restart, and repeats the batch
    it was at, gives that batch the number it had. ``following`` is the table's next free number.
    """
    if checkpoint is None:
        return following
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}.first")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, False)
        out.writeLong(following)
        out.close()
        return following
    data = fs.open(path)
    try:
        return data.readLong()
    finally:
        data.close()


def keep_latest(stream: DataFrame, keys: tuple[str, ...], label: str,
                root: str | None = None, checkpoint: str | None = None) -> PointTable:
    """Run an updating aggregate; each batch writes only the groups that changed."""
    spark = stream.sparkSession
    ddl = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    table = PointTable(spark, root or scratch_path(spark, label), ddl, keys)
    first = first_number(spark, checkpoint, table.next_seq())
    run_batches(stream, lambda batch, n: table.upsert(batch, first + n), label, checkpoint,
                mode="update")
    return table
