"""The domain's entities derived from the TPC-H-like test tables.

``oracle_views`` holds the same definitions as SQL. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.constants import PRICES
from threadlake.functions.scalar import iso_utc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def json_items(count) -> F.Column:
    """JSON text of ``count`` items, count in 0..6. All items have the same width."""
    items = [f'{{"index":{i}}}' for i in range(1, 7)]
    width = len(items[0]) + 1
    shown = F.substring(F.lit(",".join(items)), F.lit(1),
                        F.greatest(count * width - 1, F.lit(0)))
    return F.concat(F.lit("["), shown, F.lit("]"))


def rooms(spark, sf) -> DataFrame:
    key = F.col("r_regionkey").cast("bigint")
    return table(spark, sf, "region").select(
        key.alias("room_id"), F.col("r_name").alias("name"), F.lower("r_name").alias("slug"),
        (key == 4).alias("is_dm"),
        F.when(key == 3, F.lit(False)).when(key == 2, F.lit(None)).otherwise(F.lit(True))
        .alias("ai_enabled"),
        F.when(key != 0, key).alias("creator_id"),
    )


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same table as a stream, whether it is one file or a folder of files.

    A pattern, as a stream takes a plain path for a folder.
    """
    return (spark.readStream.schema(table(spark, sf, name).schema)
            .option("maxBytesPerTrigger", str(64 << 30)).parquet(f"{sf}/{name}[.]parquet"))


def messages(spark, sf, events: DataFrame | None = None) -> DataFrame:
    """Chat messages: one per event. Ids grow with time."""
    ai = F.col("event_type") == "signup"
    return (events or table(spark, sf, "events")).select(
        F.col("event_id").alias("message_id"),
        (F.col("event_id") % 5).alias("room_id"),
        F.col("user_id").alias("sender_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        _k().cast("string").alias("client_msg_id"),
        F.when(ai, F.lit("ai"))
        .when((F.col("event_type") == "view") & (_k() % 10 == 0), F.lit(None))
        .otherwise(F.lit("user")).alias("kind"),
        F.concat_ws(" ", "event_type", "props").alias("body"),
        F.when(ai, json_items(_k() % 4)).alias("citations"),
        F.when(ai, F.concat(F.lit("why "), _k().cast("string"))).alias("ai_question"),
    )


def memberships(spark, sf) -> DataFrame:
    """Current members: the user's last join ('signup') or leave ('error') in a room decides.
    The read cursor is the newest message the user viewed there."""
    events = table(spark, sf, "events").withColumn("room_id", F.col("event_id") % 5)
    action = F.col("event_type").isin("signup", "error")
    return (events.groupBy("user_id", "room_id").agg(
        F.max(F.when(action, F.struct("event_id", "event_type"))).alias("last"),
        F.max(F.when(F.col("event_type") == "view", F.col("event_id")))
        .alias("last_read_message_id"))
        .where(F.col("last.event_type") == "signup")
        .select("user_id", "room_id", "last_read_message_id"))


def bronze_messages(spark, sf) -> DataFrame:
    """Message snapshots, oldest first: purchases also exist as an earlier draft."""
    base = messages(spark, sf).select(
        F.col("message_id").cast("string").alias("id"),
        F.col("room_id").cast("string").alias("roomId"),
        F.col("sender_id").cast("string").alias("senderId"),
        "body", F.col("client_msg_id").alias("clientMsgId"), "kind", "citations",
        F.col("ai_question").alias("aiQuestion"),
        iso_utc(F.col("created_at")).alias("createdAt"),
        iso_utc(F.col("created_at") + F.expr("interval 1 hour")).alias("updatedAt"),
    )
    drafts = base.where(F.col("body").startswith("purchase")).withColumns({
        "body": F.lit("draft"), "kind": F.lit("ai"), "updatedAt": F.col("createdAt")})
    return drafts.unionByName(base)


def bronze_rooms(spark, sf) -> DataFrame:
    return rooms(spark, sf).select(
        F.col("room_id").cast("string").alias("id"), "name", "slug",
        F.when(F.col("room_id") != 1, F.col("is_dm")).alias("isDM"),
        F.col("creator_id").cast("string").alias("creatorId"),
        F.col("ai_enabled").alias("aiEnabled"),
        F.lit("2024-01-01T00:00:00+00:00").alias("createdAt"),
        F.lit("2024-01-01T00:00:00+00:00").alias("updatedAt"),
    )


def bronze_users(spark, sf) -> DataFrame:
    """Customers. Segment BUILDING carries a malformed signup stamp."""
    seen = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    joined = table(spark, sf, "customer").join(
        seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("username"), F.initcap("c_name").alias("displayName"),
        F.col("c_name").alias("avatarSeed"),
        iso_utc(F.col("last").cast("timestamp")).alias("lastSeenAt"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("not a date"))
        .otherwise(iso_utc(F.col("first").cast("timestamp"))).alias("createdAt"),
        iso_utc(F.col("last").cast("timestamp")).alias("updatedAt"),
    )


def ai_calls(spark, sf, events: DataFrame | None = None) -> DataFrame:
    """Model calls: one per event."""
    k = F.col("k")
    kinds = F.create_map(*[F.lit(x) for pair in (
        ("click", "room-ask"), ("view", "global-ask"), ("purchase", "catchup"),
        ("signup", "decisions"), ("error", "room-ask")) for x in pair])
    models = F.array(*[F.lit(m) for m, _, _ in PRICES], F.lit("unlisted"))
    return (events or table(spark, sf, "events")).withColumn("k", _k()).select(
        F.col("event_id").alias("stream_id"), "user_id",
        F.col("ts").cast("timestamp").alias("created_at"),
        kinds[F.col("event_type")].alias("kind"),
        F.concat(F.lit("p"), (k % 2).cast("string")).alias("provider"),
        F.element_at(models, k % 7 + 1).alias("model"),
        (k * 10).alias("tokens_in"), k.alias("tokens_out"),
        F.round(F.col("value") * 100).cast("int").alias("latency_ms"),
        (k % 5 == 0).alias("cached"), (F.col("event_type") != "error").alias("ok"),
        F.when(k % 10 <= 2, F.lit("up")).when(k % 10 == 3, F.lit("down")).alias("verdict"),
        (k % 13).alias("retrieval_hits"), json_items(k % 7).alias("source_keys"),
        F.concat(F.lit("why "), k.cast("string")).alias("question"),
        F.concat_ws(" ", "event_type", "props").alias("answer"),
    )


def bronze_ai_calls(spark, sf) -> DataFrame:
    """Call log snapshots: a verdict arrives as a later version of the same row. Some numbers
    and flags are missing, as in old logs."""
    calls = ai_calls(spark, sf)
    old = F.col("kind") == "decisions"
    rated = calls.select(
        F.col("stream_id").cast("string").alias("id"),
        F.col("stream_id").cast("string").alias("streamId"),
        F.col("user_id").cast("string").alias("userId"),
        "kind", "provider", "model", "question", "answer",
        F.col("source_keys").alias("sourceKeys"),
        F.when(~old, F.col("retrieval_hits")).alias("retrievalHits"),
        F.col("tokens_in").alias("tokensIn"),
        F.when(~old, F.col("tokens_out")).alias("tokensOut"),
        F.col("latency_ms").alias("latencyMs"),
        F.when(~old, F.col("cached")).alias("cached"),
        F.when(~(old & F.col("ok")), F.col("ok")).alias("ok"),
        F.when(~F.col("ok"), F.lit("AI_FAILED")).alias("errorCode"), "verdict",
        iso_utc(F.col("created_at")).alias("createdAt"),
        iso_utc(F.col("created_at") + F.expr("interval 1 hour")).alias("updatedAt"),
    )
    first = rated.where(F.col("verdict").isNotNull()).withColumns({
        "verdict": F.lit(None).cast("string"), "updatedAt": F.col("createdAt")})
    return first.unionByName(rated)


def texts(spark, sf, turns: DataFrame | None = None) -> DataFrame:
    """Messages with real prose: the user and assistant turns of all conversations."""
    message_id = F.col("conv_id") * 100 + F.col("turn")
    turns = turns or table(spark, sf, "conversations")
    return turns.where(F.col("role") != "system").select(
        message_id.alias("message_id"), (F.col("conv_id") % 5).alias("room_id"),
        F.col("conv_id").alias("sender_id"),
        F.when(F.col("role") == "assistant", F.lit("ai")).otherwise(F.lit("user"))
        .alias("kind"),
        F.col("text").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + message_id * 60).alias("created_at"),
    )


def docs(spark, sf, documents: DataFrame | None = None) -> DataFrame:
    """Documents with page starts every 3,000 characters."""
    return (documents or table(spark, sf, "documents")).select(
        "doc_id", (F.col("doc_id") % 5).alias("room_id"), F.col("source").alias("filename"),
        "text",
        F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(3000))
        .alias("page_offsets"))


def questions(spark, sf) -> DataFrame:
    """Every benchmark passage asked as a question by the user of the same number."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("item_id").alias("user_id"),
        F.col("text").alias("question"))
