"""Delivery audit and per-message delivery status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.ordered import rank_within, top_within
from threadlake.session import materialize


# Members that one word of a bitmap stands for.
_WORD = 64


def delivery_audit(messages: DataFrame, members: DataFrame,
                   receipts: DataFrame) -> DataFrame:
    """(message_id, user_id) pairs a member should hold and does not.

    A message of a room of few members is paired with them, at most 64, and the receipts take pairs away. The
    members of larger rooms have ordinals and a word for each 64 of them; where there is no such room, that
    way is not gone.
    """
    members = members.where(F.col("user_id").isNotNull()).select("room_id", "user_id").distinct()
    # a member more than a word has tells a larger room, however large
    rooms = materialize(top_within(members, ["room_id"], ["user_id"], _WORD + 1, "_n").groupBy("room_id").agg(
        F.collect_list("user_id").alias("_users")), "rooms")
    larger = rooms.where(F.size("_users") > _WORD).select("room_id")
    sent = messages.select("message_id", "room_id", "sender_id")
    receipts = receipts.select("message_id", "user_id")
    due = sent.join(rooms.where(F.size("_users") <= _WORD), "room_id").select("message_id", "room_id", F.explode(
        F.expr("filter(_users, u -> NOT u <=> sender_id)")).alias("user_id"))
    out = due.join(receipts, ["message_id", "user_id"], "left_anti").select("message_id", "room_id", "user_id")
    if larger.isEmpty():
        return out
    return out.unionByName(_by_words(sent.join(larger, "room_id", "left_semi"),
                                     members.join(larger, "room_id", "left_semi"), receipts))


def _by_words(sent: DataFrame, members: DataFrame, receipts: DataFrame) -> DataFrame:
    """``delivery_audit`` by bitmaps of 64 members a word.

    What reached a room's members of a message is a bitmap, made where there are receipts. Counts come
    first: a message whose bits are as many as the members other than the sender is complete and is
    looked at no further. Of the others the words are compared with the room's, and only bits not set
    become rows. A message's words are a 64th of its receipts and missing members together, so the work
    follows the receipts and the result, also where one member of a large room is silent.
    """
    spots = materialize(rank_within(members, ["room_id"], ["user_id"], "_n").select(
        "room_id", "user_id", F.expr(f"(_n - 1) DIV {_WORD}").alias("_word"),
        F.pmod(F.col("_n") - 1, F.lit(_WORD)).cast("int").alias("_bit")), "ordinals")
    bit, none = F.expr("shiftleft(1L, _bit)"), F.lit(0).cast("bigint")
    got = materialize(
        receipts.join(sent, "message_id")
        .where(~F.col("user_id").eqNullSafe(F.col("sender_id"))).join(spots, ["room_id", "user_id"])
        .groupBy("message_id", "_word").agg(F.bit_or(bit).alias("_bits")), "got")
    words = spots.groupBy("room_id", "_word").agg(F.bit_or(bit).alias("_all"))
    size = spots.groupBy("room_id").agg(F.count(F.lit(1)).alias("_size"))
    own = spots.select("room_id", F.col("user_id").alias("sender_id"),
                       F.col("_word").alias("_own_word"), bit.alias("_own"))
    held = got.groupBy("message_id").agg(F.sum(F.bit_count("_bits")).alias("_held"))
    incomplete = sent.join(size, "room_id").join(own, ["room_id", "sender_id"], "left").join(
        held, "message_id", "left").where(
        F.coalesce("_held", F.lit(0)) < F.col("_size") - F.col("_own").isNotNull().cast("int")).select(
        "message_id", "room_id", "_own_word", "_own")
    mine = F.when(F.col("_own_word") == F.col("_word"), F.col("_own")).otherwise(none)
    missing = incomplete.join(words, "room_id").join(got, ["message_id", "_word"], "left").select(
        "message_id", "room_id", "_word", F.col("_all").bitwiseAND(F.bitwise_not(
            F.coalesce("_bits", none).bitwiseOR(mine))).alias("_miss"))
    bits = F.explode(F.expr(
        f"filter(sequence(0, {_WORD - 1}), i -> (shiftrightunsigned(_miss, i) & 1) = 1)"))
    return missing.where("_miss <> 0").select("message_id", "room_id", "_word", bits.alias("_bit")).join(
        spots, ["room_id", "_word", "_bit"]).select("message_id", "room_id", "user_id")


def delivery_status(messages: DataFrame, receipts: DataFrame,
                    cursors: DataFrame) -> DataFrame:
    """read, delivered or sent, as the sender sees it: only other members count.

    Per room the two furthest cursors are enough: the second one answers for messages of the
    member who holds the first.
    """
    top = top_within(cursors.where(F.col("last_read_message_id").isNotNull())
                     .select("room_id", "user_id", "last_read_message_id"),
                     ["room_id"], [F.desc("last_read_message_id"), "user_id"], 2, "_n")
    best = top.groupBy("room_id").agg(
        F.max(F.when(F.col("_n") == 1, F.col("user_id"))).alias("_first_user"),
        F.max(F.when(F.col("_n") == 1, F.col("last_read_message_id"))).alias("_first"),
        F.max(F.when(F.col("_n") == 2, F.col("last_read_message_id"))).alias("_second"))
    other = receipts.join(messages.select("message_id", "sender_id"), "message_id").where(
        F.col("user_id") != F.col("sender_id")).select("message_id").distinct().withColumn(
        "_delivered", F.lit(True))
    read_up_to = F.when(F.col("_first_user") == F.col("sender_id"), F.col("_second")) \
        .otherwise(F.col("_first"))
    return (messages.join(other, "message_id", "left").join(best, "room_id", "left")
            .select("message_id", "room_id", "sender_id",
                    F.when(F.coalesce(read_up_to >= F.col("message_id"), F.lit(False)), "read")
                    .when(F.coalesce("_delivered", F.lit(False)), "delivered")
                    .otherwise("sent").alias("status")))
