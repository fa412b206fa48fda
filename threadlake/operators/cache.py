"""Semantic answer cache: newest entries per permission fingerprint, best similar answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.constants import CACHE_ENTRIES, CACHE_SIMILARITY, CACHE_TTL_SECONDS
from threadlake.functions.scalar import dot_product, permission_fingerprint
from threadlake.operators.ordered import top_within, windowed


def scope_fingerprints(scope: DataFrame, kind: str = "global") -> DataFrame:
    """(query_id, fingerprint). A user is in at most a hundred rooms, so the list is short."""
    rooms = scope.groupBy("query_id").agg(
        F.collect_set(F.col("room_id").cast("string")).alias("_rooms"))
    return rooms.select("query_id", permission_fingerprint(F.col("_rooms"), kind)
                        .alias("fingerprint"))


def cache_trim(entries: DataFrame, keep: int = CACHE_ENTRIES) -> DataFrame:
    """The newest ``keep`` entries per fingerprint."""
    return top_within(entries, ["fingerprint"], [F.desc("stored_at"), F.desc("entry_id")],
                      keep, "recency")


def live_entries(entries: DataFrame, as_of, ttl_seconds: int = CACHE_TTL_SECONDS,
                 keep: int = CACHE_ENTRIES) -> DataFrame:
    """Entries a lookup at ``as_of`` can see.

    Every insert renews the whole list of its fingerprint, so the list dies only when the gap
    to the newest insert reaches the time to live; entries from before such a gap are gone.
    Among the newest ``keep`` entries the gaps are visible from neighbour to neighbour.
    """
    from pyspark.sql.window import Window

    moment = F.lit(as_of).cast("timestamp")
    newest = cache_trim(entries.where(F.col("stored_at") <= moment), keep)
    order = Window.partitionBy("fingerprint").orderBy("recency")
    later = F.coalesce(F.lag("stored_at").over(order), moment)
    dead = (F.unix_micros(later) - F.unix_micros("stored_at") >= ttl_seconds * 1_000_000)
    broken = F.max(dead.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("_broken", broken).where("_broken = 0").drop("_broken")


def semantic_cache_lookup(asks: DataFrame, entries: DataFrame,
                          threshold: float = CACHE_SIMILARITY) -> DataFrame:
    """Best cached answer per ask: same fingerprint, similarity at or over the threshold.

    ``asks(query_id, fingerprint, vector)``, ``entries(entry_id, fingerprint, stored_at,
    vector)``. Trimming leaves at most twenty entries per fingerprint, so an ask meets at most
    twenty rows. Misses have a null entry. Ties go to the newer entry.
    """
    held = cache_trim(entries).select("fingerprint", "entry_id", "recency",
                                      F.col("vector").alias("_held"))
    score = F.round(dot_product(F.col("vector"), F.col("_held")), 6)
    hits = asks.join(held, "fingerprint").withColumn("similarity", score).where(
        F.col("similarity") >= threshold)
    best = top_within(hits.select("query_id", "entry_id", "similarity", "recency"),
                      ["query_id"], [F.desc("similarity"), "recency"], 1, "_n")
    return asks.select("query_id", "fingerprint").join(
        best.select("query_id", "entry_id", "similarity"), "query_id", "left")


def semantic_cache_lookup_at(asks: DataFrame, entries: DataFrame,
                             threshold: float = CACHE_SIMILARITY,
                             ttl_seconds: int = CACHE_TTL_SECONDS,
                             keep: int = CACHE_ENTRIES) -> DataFrame:
    """Best cached answer per ask among the entries that were alive when it was asked.

    ``asks(query_id, fingerprint, asked_at, vector)``. An ask sees entries stored before or at its
    moment: the newest ``keep`` of its fingerprint, back to the last pause of at least the time to
    live, and none if that pause lies right before the ask. Entries are numbered per fingerprint
    and an ask takes a range of numbers, so it meets at most ``keep`` rows.
    """
    key, ttl = ["fingerprint"], ttl_seconds * 1_000_000
    order = ["stored_at", "entry_id"]
    numbered = windowed(entries, key, order, {"_n": ("row_number", None),
                                              "_prev": ("lag", "stored_at")})
    pause = F.unix_micros("stored_at") - F.unix_micros("_prev") >= ttl
    held = windowed(
        numbered.withColumn("_start", F.when(F.col("_prev").isNull() | pause, F.col("_n"))),
        key, order, {"_from": ("max", "_start")})
    marks = held.select(
        "fingerprint", F.col("stored_at").alias("_t"), F.lit(0).alias("_is_ask"),
        F.col("entry_id").cast("string").alias("_id"), "_n").unionByName(asks.select(
            "fingerprint", F.col("asked_at").alias("_t"), F.lit(1).alias("_is_ask"),
            F.col("query_id").cast("string").alias("_id"), F.lit(None).cast("bigint").alias("_n")))
    placed = windowed(marks, key, ["_t", "_is_ask", "_id"], {"_last": ("max", "_n")}).where(
        "_is_ask = 1 AND _last IS NOT NULL").select("fingerprint", "_id", "_last")
    ends = held.select("fingerprint", F.col("_n").alias("_last"), "_from",
                       F.col("stored_at").alias("_newest"))
    asked = asks.withColumn("_id", F.col("query_id").cast("string"))
    ranges = asked.join(placed, ["fingerprint", "_id"]).join(ends, ["fingerprint", "_last"]).where(
        F.unix_micros("asked_at") - F.unix_micros("_newest") < ttl)
    first = F.greatest("_from", F.col("_last") - (keep - 1))
    seen = ranges.select("query_id", "fingerprint", "vector", "_last", F.explode(
        F.sequence(first, F.col("_last"))).alias("_n")).join(
        held.select("fingerprint", "_n", "entry_id", F.col("vector").alias("_held")),
        ["fingerprint", "_n"])
    hits = seen.withColumn("similarity", F.round(dot_product(
        F.col("vector"), F.col("_held")), 6)).where(F.col("similarity") >= threshold)
    best = top_within(hits.select("query_id", "entry_id", "similarity", "_n"), ["query_id"],
                      [F.desc("similarity"), F.desc("_n")], 1, "_r")
    return asks.select("query_id", "fingerprint").join(
        best.select("query_id", "entry_id", "similarity"), "query_id", "left")
