"""Presence, typing sessions, invite redemption: event logs to intervals and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.constants import (
    MAX_ROOMS_JOINED, ONLINE_SNAPSHOT_CAP, TYPING_EXPIRY_SECONDS,
)
from threadlake.operators.ordered import largest_group, rank_within, windowed
from threadlake.session import materialize

_TIME = ["ts", "event_id"]


def presence_edges(events: DataFrame, **split) -> DataFrame:
    """Moments a user goes online (0 -> 1 connections) or offline (1 -> 0).

    ``delta`` is +1 for a connect and -1 for a disconnect. The counter never goes below
    zero; with S the plain running sum, the floored counter is S - min(0, lowest S so far).
    """
    split.setdefault("largest", largest_group(events, ["user_id"]))
    total = windowed(events, ["user_id"], _TIME, {"_s": ("sum", "delta")}, **split)
    low = windowed(total, ["user_id"], _TIME,
                   {"_low": ("min", "_s"), "_low_before": ("min_before", "_s")}, **split)
    count = F.col("_s") - F.least(F.lit(0), F.col("_low"))
    before = F.col("_s") - F.col("delta") - F.least(
        F.lit(0), F.coalesce("_low_before", F.lit(0)))
    counted = low.withColumns({"connections": count, "_before": before})
    edge = F.when((F.col("_before") == 0) & (F.col("connections") == 1), True).when(
        (F.col("_before") == 1) & (F.col("connections") == 0), False)
    return counted.withColumn("online", edge).where(F.col("online").isNotNull()).select(
        "user_id", "ts", "event_id", "online")


def presence_intervals(events: DataFrame, **split) -> DataFrame:
    """Online intervals; ``offline_at`` is null while the user is still online."""
    split.setdefault("largest", largest_group(events, ["user_id"]))
    edges = presence_edges(events, **split).withColumn("_row", F.struct("ts"))
    paired = windowed(edges, ["user_id"], _TIME, {"_from": ("lag", "_row")}, **split)
    closed = paired.where(~F.col("online")).select(
        "user_id", F.col("_from.ts").alias("online_at"), F.col("ts").alias("offline_at"))
    last = edges.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "online"))
                                        .alias("_last"))
    still = last.where("_last.online").select(
        "user_id", F.col("_last.ts").alias("online_at"),
        F.lit(None).cast("timestamp").alias("offline_at"))
    return closed.unionByName(still)


def online_users(events: DataFrame, at, **split) -> DataFrame:
    """Users online at a moment."""
    moment = F.lit(at).cast("timestamp")
    spans = presence_intervals(events.where(F.col("ts") <= moment), **split)
    return spans.where(F.col("offline_at").isNull()).select("user_id").distinct()


def online_snapshot(events: DataFrame, at, cap: int = ONLINE_SNAPSHOT_CAP) -> DataFrame:
    """The snapshot pushed to a new client shows at most ``cap`` users (lowest ids)."""
    return online_users(events, at).orderBy("user_id").limit(cap)


def online_members(memberships: DataFrame, online: DataFrame) -> DataFrame:
    """Members currently online per room."""
    return memberships.join(online, "user_id", "left_semi").groupBy("room_id").agg(
        F.count(F.lit(1)).alias("online"))


def typing_sessions(events: DataFrame, expiry_seconds: float = TYPING_EXPIRY_SECONDS,
                    keys: tuple[str, ...] = ("user_id",), **split) -> DataFrame:
    """Typing spans from start and stop rows (a sent message is a stop).

    A span ends at the first stop, or ``expiry_seconds`` after its last start.
    """
    keys = list(keys)
    micros = int(expiry_seconds * 1_000_000)
    split.setdefault("largest", largest_group(events, keys))
    rows = events.withColumn("_row", F.struct("ts", "is_stop"))
    prev = windowed(rows, keys, _TIME, {"_prev": ("lag", "_row")}, **split)
    before = F.col("_prev")
    expired = F.unix_micros("ts") - F.unix_micros(before["ts"]) >= micros
    opens = ~F.col("is_stop") & (before.isNull() | before["is_stop"] | expired)
    numbered = windowed(prev.withColumn("_open", opens.cast("bigint")), keys, _TIME,
                        {"session": ("sum", "_open")}, **split)
    spans = numbered.where("session > 0").groupBy(*keys, "session").agg(
        F.min(F.when(~F.col("is_stop"), F.col("ts"))).alias("started_at"),
        F.max(F.when(~F.col("is_stop"), F.col("ts"))).alias("_last"),
        F.min(F.when(F.col("is_stop"), F.col("ts"))).alias("_stop"))
    timeout = F.timestamp_micros(F.unix_micros("_last") + micros)
    return spans.select(*keys, "session", "started_at",
                        F.least(timeout, F.col("_stop")).alias("ended_at"))


def _allocate(wanted: DataFrame, **split) -> DataFrame:
    """The rows of ``wanted`` that get a place when they are served in the order of ``_at``.

    ``wanted(user_id, invite_id, _room, _at, _places, _free)``: a row gets a place if fewer than
    ``_places`` rows of its invite and fewer than ``_free`` rows of its user got one before, and none
    of its user in its room. The two ceilings bind each other, so this is solved by rounds: with
    every open row counted as served, what is under both ceilings is served; with none of them
    counted, what is over one is refused; the rest waits for the next round. The first open row of all
    is always decided, so it ends, in as many rounds as decisions hang on each other.
    """
    rows = materialize(wanted.where("_places > 0 AND _free > 0").withColumn("_served", F.lit(0)),
                       "wanted")
    groups = {"i": ["invite_id"], "u": ["user_id"], "r": ["user_id", "_room"]}
    # rows only ever leave, so what the groups hold at first bounds them in every round
    largest = {name: largest_group(rows, keys) for name, keys in groups.items()}
    while True:
        now = rows.withColumns({"_sure": F.col("_served").cast("bigint"),
                                "_open": (1 - F.col("_served")).cast("bigint")})
        for name, keys in groups.items():
            now = windowed(now, keys, ["_at"], {
                f"_sure_{name}": ("sum_before", "_sure"), f"_open_{name}": ("sum_before", "_open")},
                **{"largest": largest[name], **split})
        count = lambda c: F.coalesce(F.col(c), F.lit(0))
        over = ((count("_sure_i") >= F.col("_places")) | (count("_sure_u") >= F.col("_free"))
                | (count("_sure_r") > 0))
        under = ((count("_sure_i") + count("_open_i") < F.col("_places"))
                 & (count("_sure_u") + count("_open_u") < F.col("_free"))
                 & (count("_sure_r") + count("_open_r") == 0))
        rows = materialize(now.where((F.col("_served") == 1) | ~over).select(
            *[c for c in rows.columns if c != "_served"],
            F.when(F.col("_served") == 1, 1).when(under, 1).otherwise(0).alias("_served")), "served")
        if rows.where("_served = 0").isEmpty():
            return rows.drop("_served")


def invite_redemption(attempts: DataFrame, invites: DataFrame,
                      members: DataFrame | None = None, full_users: DataFrame | None = None,
                      joined: DataFrame | None = None, room_limit: int = MAX_ROOMS_JOINED,
                      **split) -> DataFrame:
    """Outcome of every attempt, in arrival order: accepted, member, room_limit or invalid.

    An attempt is invalid when the invite is revoked, expired or full at that moment: it has
    ``max_redemptions`` places, less ``used`` (a column of ``invites``, none if absent). A member of
    the invite's room stays one and consumes nothing. A user who is in ``room_limit`` rooms, those
    joined in this batch included, is refused and consumes nothing. Rooms are named by a column
    ``room_id`` of ``invites``; without it every invite has its own.

    ``members(invite_id, user_id)`` were in the invite's room before, ``joined(user_id, rooms)`` gives
    the number of rooms a user was in, ``full_users(user_id)`` are in as many as one may join.
    """
    at = F.col("attempted_at")
    open_ = (at < F.col("expires_at")) & (F.col("revoked_at").isNull()
                                          | (at < F.col("revoked_at")))
    used = F.coalesce(F.col("used"), F.lit(0)) if "used" in invites.columns else F.lit(0)
    room = F.col("room_id") if "room_id" in invites.columns else F.col("invite_id")
    terms = invites.select("invite_id", "expires_at", "revoked_at", room.alias("_room"),
                           (F.col("max_redemptions") - used).alias("_places"))
    tried = attempts.select("attempt_id", "invite_id", "user_id", "attempted_at").join(
        terms, "invite_id").withColumns({"_open": open_, "_at": F.struct(at, F.col("attempt_id"))})
    if members is None:
        tried = tried.withColumn("_old", F.lit(False))
    else:
        rooms_of = members.select("invite_id", "user_id").join(terms, "invite_id").select(
            "_room", "user_id").distinct().withColumn("_old", F.lit(True))
        tried = tried.join(rooms_of, ["_room", "user_id"], "left").withColumn(
            "_old", F.coalesce("_old", F.lit(False)))
    tried = materialize(tried, "tried")
    # Ceilings never rise again, so of a user's attempts on one invite only the first can succeed.
    wanted = tried.where("_open AND NOT _old").groupBy(
        "user_id", "invite_id", "_room", "_places").agg(F.min("_at").alias("_at"))
    free = F.lit(room_limit)
    for known, column in ((joined, "rooms"), (full_users, None)):
        if known is not None:
            taken = (F.col(column) if column else F.lit(room_limit)).alias(f"_in_{column}")
            wanted = wanted.join(known.select("user_id", taken).distinct(), "user_id", "left")
            free = free - F.coalesce(f"_in_{column}", F.lit(0))
    served = _allocate(wanted.select("user_id", "invite_id", "_room", "_at", "_places",
                                     free.alias("_free")), **split)
    place = rank_within(served, ["invite_id"], ["_at"], "_place", **split)
    full = place.where(F.col("_place") == F.col("_places")).select(
        "invite_id", F.col("_at").alias("_full_at"))
    entered = served.select("user_id", "_room", F.col("_at").alias("_entered"))
    judged = tried.join(full, "invite_id", "left").join(entered, ["user_id", "_room"], "left").join(
        served.select("user_id", "invite_id", F.col("_at").alias("_won")), ["user_id", "invite_id"], "left")
    outcome = (F.when(~F.col("_open") | (F.col("_places") <= 0), "invalid")
               .when(F.col("_won") == F.col("_at"), "accepted")
               .when(F.col("_full_at").isNotNull() & (F.col("_at") > F.col("_full_at")),
                     "invalid")
               .when(F.col("_old") | (F.col("_entered") < F.col("_at")), "member")
               .otherwise("room_limit"))
    return judged.select("attempt_id", "invite_id", "user_id", outcome.alias("outcome"))
