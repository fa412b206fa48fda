"""Read-cursor operators: unread counts, gap sync, catch-up, cursor moves.

The naive forms join every member with every later message of the room. Here each message
gets its position in its room once, each cursor its position among them, and counts follow
by subtraction; rows that are really wanted are then fetched by (room, position).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.constants import CATCHUP_CAP, SYNC_CAP
from threadlake.operators.ordered import rank_within, windowed
from threadlake.operators.scope import is_knowledge


def cursor_positions(messages: DataFrame, cursors: DataFrame, cursor: str,
                     **split) -> DataFrame:
    """Add ``position``: messages of the room at or before the cursor (0 without one)."""
    marks = cursors.where(F.col(cursor).isNotNull())
    timeline = messages.select("room_id", F.col("message_id").alias("_at"),
                               F.lit(0).alias("_mark"), F.lit(None).cast("bigint")
                               .alias("user_id")).unionByName(
        marks.select("room_id", F.col(cursor).alias("_at"), F.lit(1).alias("_mark"),
                     "user_id"))
    timeline = timeline.withColumn("_one", (1 - F.col("_mark")).cast("bigint"))
    run = windowed(timeline, ["room_id"], ["_at", "_mark", "user_id"],
                   {"position": ("sum", "_one")}, **split)
    placed = run.where("_mark = 1").select("user_id", "room_id", "position")
    return cursors.join(placed, ["user_id", "room_id"], "left").withColumn(
        "position", F.coalesce("position", F.lit(0)))


def unread_counts(memberships: DataFrame, messages: DataFrame, **split) -> DataFrame:
    """Messages newer than the member's cursor that the member did not send."""
    cursor = "last_read_message_id"
    placed = cursor_positions(messages, memberships, cursor, **split)
    totals = messages.groupBy("room_id").agg(F.count(F.lit(1)).alias("_total"))
    own = (messages.select("room_id", "message_id", F.col("sender_id").alias("user_id"))
           .join(memberships.select("user_id", "room_id", cursor), ["user_id", "room_id"])
           .where(F.col(cursor).isNull() | (F.col("message_id") > F.col(cursor)))
           .groupBy("user_id", "room_id").agg(F.count(F.lit(1)).alias("_own")))
    return (placed.join(totals, "room_id", "left").join(own, ["user_id", "room_id"], "left")
            .select("user_id", "room_id",
                    (F.coalesce("_total", F.lit(0)) - F.col("position")
                     - F.coalesce("_own", F.lit(0))).alias("unread")))


def sync_since(cursors: DataFrame, memberships: DataFrame, messages: DataFrame,
               cap: int = SYNC_CAP, **split) -> DataFrame:
    """Missed messages per (user, room, last message id) cursor.

    Rooms the user does not belong to are left out. More than ``cap`` missed: one row with
    ``refetch`` and no message. Nothing missed: one row without a message.
    """
    mine = cursors.join(memberships.select("user_id", "room_id"), ["user_id", "room_id"],
                        "left_semi")
    ranked = rank_within(messages.select("room_id", "message_id"), ["room_id"],
                         ["message_id"], "_pos", **split)
    totals = messages.groupBy("room_id").agg(F.count(F.lit(1)).alias("_total"))
    placed = cursor_positions(messages, mine, "last_message_id", **split).join(
        totals, "room_id", "left").withColumn(
        "missed", F.coalesce("_total", F.lit(0)) - F.col("position"))
    refetch = F.col("missed") > cap
    wanted = placed.where(~refetch & (F.col("missed") > 0)).select(
        "user_id", "room_id",
        F.explode(F.sequence(F.col("position") + 1, F.col("_total"))).alias("_pos"))
    rows = wanted.join(ranked, ["room_id", "_pos"]).select(
        "user_id", "room_id", F.lit(False).alias("refetch"), "message_id")
    bare = placed.where(refetch | (F.col("missed") == 0)).select(
        "user_id", "room_id", refetch.alias("refetch"),
        F.lit(None).cast("bigint").alias("message_id"))
    return rows.unionByName(bare)


def catchup_window(memberships: DataFrame, messages: DataFrame, cap: int = CATCHUP_CAP,
                   **split) -> DataFrame:
    """First ``cap`` knowledge messages after the cursor that the member did not send.

    A ``since_message_id`` column overrides the stored cursor. The member's own messages are
    skipped, so the window must reach past them: own message number i after the cursor, at
    position q, has q - cursor - i foreign messages before it, and lies inside the window
    exactly when that is below the cap.
    """
    boundary = F.col("last_read_message_id")
    if "since_message_id" in memberships.columns:
        boundary = F.coalesce("since_message_id", "last_read_message_id")
    members = memberships.withColumn("_cursor", boundary)
    eligible = messages.where(is_knowledge())
    ranked = rank_within(eligible.select("room_id", "message_id", "sender_id"), ["room_id"],
                         ["message_id"], "_pos", **split)
    totals = eligible.groupBy("room_id").agg(F.count(F.lit(1)).alias("_total"))
    placed = cursor_positions(eligible, members.select("user_id", "room_id", "_cursor"),
                              "_cursor", **split).join(totals, "room_id")
    own = ranked.withColumnRenamed("sender_id", "user_id").join(
        placed.select("user_id", "room_id", "position"), ["user_id", "room_id"]).where(
        F.col("_pos") > F.col("position"))
    own = rank_within(own, ["user_id", "room_id"], ["_pos"], "_i", **split)
    inside = own.where(F.col("_pos") - F.col("position") - F.col("_i") < cap).groupBy(
        "user_id", "room_id").agg(F.count(F.lit(1)).alias("_own"))
    reach = F.least("_total", F.col("position") + cap + F.coalesce("_own", F.lit(0)))
    wanted = (placed.join(inside, ["user_id", "room_id"], "left")
              .where(F.col("_total") > F.col("position"))
              .select("user_id", "room_id",
                      F.explode(F.sequence(F.col("position") + 1, reach)).alias("_pos")))
    hits = wanted.join(ranked, ["room_id", "_pos"]).where(
        F.col("sender_id") != F.col("user_id"))
    order = Window.partitionBy("user_id", "room_id").orderBy("_pos")
    return hits.select("user_id", "room_id", "message_id",
                       F.row_number().over(order).alias("position"))


def read_cursor_moves(receipts: DataFrame, **split) -> DataFrame:
    """Receipts that move the (user, room) cursor forward, in arrival order."""
    run = windowed(receipts, ["user_id", "room_id"], ["created_at", "receipt_id"],
                   {"_before": ("max_before", "last_read_message_id")}, **split)
    return run.where(F.col("_before").isNull()
                     | (F.col("last_read_message_id") > F.col("_before"))).drop("_before")


def read_cursor(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("user_id", "room_id").agg(
        F.max("last_read_message_id").alias("last_read_message_id"))
