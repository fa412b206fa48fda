"""Permission scope, memory gate, knowledge filter, enrichment with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.constants import GHOST_DISPLAY_NAME, GHOST_USERNAME
from threadlake.functions.scalar import is_command, slug_base


def enabled_rooms(rooms: DataFrame) -> DataFrame:
    """Ids of rooms whose memory is on; an unset flag means on."""
    return rooms.where(F.coalesce("ai_enabled", F.lit(True))).select("room_id")


def memory_gate(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rows of memory-enabled rooms. One row per room on the right, so a hot room on the left
    is split by AQE or met by a broadcast that AQE sizes at run time."""
    return rows.join(enabled_rooms(rooms), "room_id", "left_semi")


def is_knowledge(kind="kind", body="body") -> F.Column:
    """Not written by the assistant (unknown kind counts as a user's) and not a command."""
    return (F.coalesce(F.col(kind), F.lit("user")) != "ai") & ~is_command(F.col(body))


def knowledge_filter(messages: DataFrame, rooms: DataFrame) -> DataFrame:
    return memory_gate(messages.where(is_knowledge()), rooms)


def permission_scope(askers: DataFrame, memberships: DataFrame,
                     rooms: DataFrame) -> DataFrame:
    """(query_id, room_id) pairs an asker may search: rooms they belong to now, memory on.

    A ``restrict_room`` column narrows the scope to that room or to nothing. Askers without
    rooms have no rows, so everything downstream is empty for them.
    """
    scope = askers.join(memberships.select("user_id", "room_id").distinct(), "user_id")
    if "restrict_room" in askers.columns:
        scope = scope.where(F.col("restrict_room").isNull()
                            | (F.col("restrict_room") == F.col("room_id")))
    return memory_gate(scope.select("query_id", "room_id"), rooms)


def enrich_sender(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Sender identity; senders without an account get the placeholder."""
    known = users.select(F.col("user_id").alias("sender_id"), "username", "display_name")
    return messages.join(known, "sender_id", "left").withColumns({
        "username": F.coalesce("username", F.lit(GHOST_USERNAME)),
        "display_name": F.coalesce("display_name", F.lit(GHOST_DISPLAY_NAME)),
    })


def source_sender(sources: DataFrame, users: DataFrame) -> DataFrame:
    """``sender`` of retrieved sources: the display name, the placeholder for a sender without an
    account, and for a source that nobody sent its file name, if it has one."""
    known = users.select(F.col("user_id").alias("sender_id"), F.col("display_name").alias("_name"))
    return sources.join(known, "sender_id", "left").withColumn("sender", F.coalesce(
        "_name", F.when(F.col("sender_id").isNotNull(), F.lit(GHOST_DISPLAY_NAME)),
        F.col("filename"))).drop("_name")


def enrich_room_name(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    names = rooms.select("room_id", F.col("name").alias("room_name"))
    return rows.join(names, "room_id", "left").withColumn(
        "room_name", F.coalesce("room_name", F.lit("unknown")))


def assign_slugs(rows: DataFrame, row_id: str, name: str) -> DataFrame:
    """Slug per row; the first row with a base keeps it, later ones get a six-digit suffix
    derived from their id."""
    based = rows.select(row_id, slug_base(F.col(name)).alias("_base"))
    first = based.groupBy("_base").agg(F.min(row_id).alias("_first"))
    suffix = F.substring(F.md5(F.col(row_id).cast("string")), 1, 6)
    return based.join(first, "_base").select(row_id, F.when(
        F.col(row_id) == F.col("_first"), F.col("_base")).otherwise(
        F.concat_ws("-", "_base", suffix)).alias("slug"))
