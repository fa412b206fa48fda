"""Ingestion streams: messages and documents to points, first sends, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.constants import DOCUMENT_ATTEMPTS, EMBED_DIMS, MESSAGE_ATTEMPTS
from threadlake.functions.embedding import embed
from threadlake.functions.scalar import doc_key, message_key, point_id
from threadlake.operators.chunking import chunk_documents
from threadlake.operators.scope import knowledge_filter, memory_gate
from threadlake.operators.validate import row_validation
from threadlake.operators.ordered import windowed
from threadlake.session import materialize
from threadlake.sources.points import PointTable
from threadlake.sources.postings import PostingTable
from threadlake.streaming.runtime import first_number, run_batches

MESSAGE_POINTS = ("point_id string, room_id bigint, message_id bigint, sender_id bigint, "
                  "text string, created_at timestamp, vector array<double>")
DOC_POINTS = ("point_id string, room_id bigint, doc_id bigint, chunk_index int, page int, "
              "filename string, text string, vector array<double>")
DOC_STATUS = "doc_id bigint, status string, chunk_count int, error string"


def message_point_rows(messages: DataFrame, rooms: DataFrame,
                       dims: int = EMBED_DIMS) -> DataFrame:
    """Points of knowledge messages; works on a stream with the rooms as the static side."""
    kept = knowledge_filter(messages, rooms)
    return kept.select(
        point_id(F.concat(F.lit("msg:"), F.col("message_id").cast("string")))
        .alias("point_id"), "room_id", "message_id", "sender_id",
        F.col("body").alias("text"), "created_at", embed(F.col("body"), dims).alias("vector"))


def stream_ingest(messages: DataFrame, rooms: DataFrame, root: str,
                  checkpoint: str | None = None) -> PointTable:
    """Messages to points. Ids derive from the message, so redelivery changes nothing."""
    table = PointTable(messages.sparkSession, root, MESSAGE_POINTS)
    first = first_number(messages.sparkSession, checkpoint, table.next_seq())
    run_batches(message_point_rows(messages, rooms),
                lambda batch, n: table.upsert(batch, first + n), "ingest", checkpoint)
    return table


def stream_index(messages: DataFrame, rooms: DataFrame, root: str,
                 checkpoint: str | None = None) -> PostingTable:
    """Knowledge messages to the inverted index; an edited message takes the place of the old one.

    Of several versions of a message in one batch the last edited (``created_at``) counts.
    """
    spark = messages.sparkSession
    index = PostingTable(spark, root)
    first = first_number(spark, checkpoint, index.next_batch())

    def handle(batch: DataFrame, n: int) -> None:
        newest = batch.groupBy("message_id").agg(
            F.max(F.struct("created_at", "body", "room_id")).alias("m"))
        index.add(newest.select(message_key(F.col("message_id")).alias("doc_id"), "m.room_id",
                                F.col("m.body").alias("text")), first + n)

    run_batches(knowledge_filter(messages, rooms), handle, "index", checkpoint)
    return index


def stream_doc_ingest(docs: DataFrame, root: str, dims: int = EMBED_DIMS,
                      checkpoint: str | None = None) -> tuple[PointTable, PointTable]:
    """Documents to chunk points and a status per document.

    A document without text fails with a reason of at most 500 characters; the rest is ready
    with its number of chunks. Both tables are keyed, so a repeated batch settles. Documents of
    rooms with memory off are ingested too: searches leave them out while the switch is off.
    """
    spark = docs.sparkSession
    points = PointTable(spark, f"{root}/points", DOC_POINTS)
    status = PointTable(spark, f"{root}/status", DOC_STATUS, ("doc_id",))
    first = first_number(spark, checkpoint, max(points.next_seq(), status.next_seq()))

    def handle(batch: DataFrame, batch_id: int) -> None:
        n = first + batch_id
        chunks = chunk_documents(batch.where(F.col("text").isNotNull()))
        points.upsert(chunks.select(
            point_id(doc_key(F.col("doc_id"), F.col("chunk_index"))).alias("point_id"),
            "room_id", "doc_id", "chunk_index", "page", "filename", "text",
            embed(F.col("text"), dims).alias("vector")), n)
        counts = spark.read.schema("doc_id bigint").parquet(f"{root}/points/seq={n}").groupBy(
            "doc_id").agg(F.count(F.lit(1)).cast("int").alias("_n")) if _exists(
            spark, f"{root}/points/seq={n}") else spark.createDataFrame(
            [], "doc_id bigint, _n int")
        failed = F.col("text").isNull()
        status.upsert(batch.select("doc_id", "text").join(
            counts, "doc_id", "left").select(
            "doc_id", F.when(failed, "failed").otherwise("ready").alias("status"),
            F.coalesce("_n", F.lit(0)).alias("chunk_count"),
            F.when(failed, F.substring(F.lit("document has no text"), 1, 500))
            .alias("error")), n)

    run_batches(docs, handle, "docs", checkpoint)
    return points, status


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stream_dedup_send(messages: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First send per (sender, client id). State is kept for ``watermark`` after a send; a
    retry later than that counts as new, rows that late are dropped."""
    return messages.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(
        ["sender_id", "client_msg_id"])


def daily_usage(calls: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tokens per user and UTC day as an updating aggregate over tumbling windows."""
    return (calls.withWatermark("created_at", watermark)
            .groupBy("user_id", F.window("created_at", "1 day"))
            .agg(F.sum(F.greatest(F.lit(0), F.col("tokens")).cast("bigint")).alias("used"))
            .select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"),
                    "used"))


def cursor_maximum(receipts: DataFrame) -> DataFrame:
    """Furthest read message per (user, room) as an updating aggregate."""
    return receipts.groupBy("user_id", "room_id").agg(
        F.max("last_read_message_id").alias("last_read_message_id"))


def heartbeat_sessions(beats: DataFrame, ttl: str = "30 seconds") -> DataFrame:
    """Online spans from heartbeats: a span ends when none came within the time to live."""
    return beats.groupBy("user_id", F.session_window("ts", ttl)).agg(
        F.count(F.lit(1)).alias("beats")).select(
        "user_id", F.col("session_window.start").alias("online_at"),
        F.col("session_window.end").alias("offline_at"), "beats")


def retry_or_bury(failures: DataFrame, kind: str = "message") -> tuple[DataFrame, DataFrame]:
    """Failed rows with ``attempts`` so far: those to try again, and those to dead-letter."""
    limit = MESSAGE_ATTEMPTS if kind == "message" else DOCUMENT_ATTEMPTS
    tried = failures.withColumn("attempts", F.col("attempts") + 1)
    return tried.where(F.col("attempts") < limit), tried.where(F.col("attempts") >= limit)


class RetryTable:
    """Rows that wait for another attempt, those done and those given up, by round.

    A round is a micro-batch or, when no new rows come, a drain after one. Its folders are named by
    both numbers; it reads what the round before left waiting and replaces its own folders, so a
    repeated round changes nothing.
    """

    def __init__(self, spark, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _rounds(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str, round_: str | None = None) -> DataFrame:
        """Rows ``done``, ``dead`` or ``waiting``, of one round or all, with their ``attempts``."""
        found = [round_] if round_ else self._rounds(name)
        columns = T.StructType([*self.schema.fields, T.StructField("attempts", T.IntegerType()),
                                T.StructField("error", T.StringType())])
        if not found:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*[f"{self.root}/{name}/{r}" for r in found])

    def waiting(self, before: str = "~") -> DataFrame:
        """What the last round before this one left waiting."""
        earlier = [r for r in self._rounds("waiting") if r < before]
        return self.read("waiting", earlier[-1]) if earlier else self.read("waiting").limit(0)

    def run(self, new: DataFrame | None, attempt: Callable[[DataFrame], DataFrame], limit: int,
            batch: int, drain: int = 0) -> None:
        """One round: try the waiting and the new rows; sort what came out."""
        round_ = f"{batch:012d}-{drain:04d}"
        rows = self.waiting(round_).drop("error")
        if new is not None:
            rows = rows.unionByName(new.withColumn("attempts", F.lit(0)))
        tried = materialize(attempt(rows).withColumn("attempts", F.col("attempts") + 1), "tried")
        failed = F.col("error").isNotNull()
        columns = [*self.schema.names, "attempts", "error"]
        for name, some in (("done", ~failed), ("dead", failed & (F.col("attempts") >= limit)),
                           ("waiting", failed & (F.col("attempts") < limit))):
            tried.where(some).select(*columns).write.mode("overwrite").parquet(
                f"{self.root}/{name}/{round_}")


def stream_with_retries(rows: DataFrame, attempt: Callable[[DataFrame], DataFrame], root: str,
                        kind: str = "message", checkpoint: str | None = None) -> RetryTable:
    """Process a stream with ``attempt``, which adds ``error`` (null where it worked) to its rows.

    A failed row waits in a table that the next micro-batch reads back, and is tried up to 5 times
    (messages) or 3 times (documents), counted over batches; after the last attempt it is in the
    dead-letter table, once. When the input is consumed the waiting rows are tried to the end.
    """
    limit = MESSAGE_ATTEMPTS if kind == "message" else DOCUMENT_ATTEMPTS
    table, last = RetryTable(rows.sparkSession, root, rows.schema), [-1]

    def handle(batch: DataFrame, n: int) -> None:
        table.run(batch, attempt, limit, n)
        last[0] = n

    run_batches(rows, handle, "retries", checkpoint)
    rounds = table._rounds("waiting")
    batch = int(rounds[-1].split("-")[0]) if rounds else last[0]
    drain = int(rounds[-1].split("-")[1]) if rounds else 0
    while not table.waiting().isEmpty():
        drain += 1
        table.run(None, attempt, limit, batch, drain)
    return table


def split_stream(rows: DataFrame, rules: list[tuple[str, Column]], good_root: str,
                 bad_root: str, checkpoint: str | None = None) -> None:
    """Valid rows to one table, the rest with the failed rule to the dead-letter table."""
    checked = row_validation(rows, rules, "reason")

    def handle(batch: DataFrame, n: int) -> None:
        batch.where(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(
            f"{good_root}/batch={n}")
        batch.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(
            f"{bad_root}/batch={n}")

    run_batches(checked, handle, "split", checkpoint)


def memory_switch_asof(messages: DataFrame, switches: DataFrame, **split) -> DataFrame:
    """Messages with the switch state when they were sent and the state now.

    ``switches(room_id, switched_at, switch_id, enabled)``; a room without a switch is on.
    ``ingested``: memory was on when the message came. ``visible``: and it is on now. An as-of
    join by one ordered pass: switches and messages share a timeline, and the newest switch so
    far is a running maximum.
    """
    mark = F.struct("switched_at", "switch_id", "enabled")
    timeline = messages.select(
        "room_id", F.col("created_at").alias("_at"), F.lit(1).alias("_side"),
        F.col("message_id").alias("_id"),
        F.lit(None).cast("struct<switched_at:timestamp,switch_id:bigint,enabled:boolean>")
        .alias("_mark")).unionByName(switches.select(
            "room_id", F.col("switched_at").alias("_at"), F.lit(0).alias("_side"),
            F.col("switch_id").alias("_id"), mark.alias("_mark")))
    run = windowed(timeline, ["room_id"], ["_at", "_side", "_id"],
                   {"_latest": ("max", "_mark")}, **split)
    now = switches.groupBy("room_id").agg(F.max(mark).alias("_now"))
    on = F.lit(True)
    ingested = F.coalesce(F.col("_latest")["enabled"], on)
    return run.where("_side = 1").join(now, "room_id", "left").select(
        F.col("_id").alias("message_id"), "room_id", ingested.alias("ingested"),
        (ingested & F.coalesce(F.col("_now")["enabled"], on)).alias("visible"))
