"""Keyset pages, bounded recent windows, message grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.constants import DECISIONS_WINDOW, HEADER_GAP_SECONDS
from threadlake.operators.ordered import (
    largest_group, rank_within, top_within, windowed,
)


def next_cursor_text(created_at, message_id) -> F.Column:
    stamp = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(stamp, F.lit("_"), message_id.cast("string"))


def keyset_page(messages: DataFrame, room_id, limit: int = 50,
                cursor: tuple | None = None) -> DataFrame:
    """One page, newest first, strictly older than ``cursor`` (created_at, id).

    One row more than the page is fetched; it shows whether there is a next page. A range
    predicate and a top-k: no offset is skipped over.
    """
    rows = messages.where(F.col("room_id") == F.lit(room_id))
    if cursor is not None:
        at, last_id = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col("created_at") < at)
                          | ((F.col("created_at") == at) & (F.col("message_id") < last_id)))
    return rows.orderBy(F.desc("created_at"), F.desc("message_id")).limit(limit + 1)


def all_pages(rows: DataFrame, keys: list[str], order: list, size: int, cursor,
              row_id: str, **split) -> DataFrame:
    """Every page of every group: first and last id, rows, and the next cursor (null on the
    last page). Pages are groups of at most ``size`` rows whatever the group's size."""
    ranked = rank_within(rows, keys, order, "_n", **split).withColumn(
        "page", F.call_function("div", F.col("_n") - 1, F.lit(size).cast("bigint")))
    pages = ranked.groupBy(*keys, "page").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(row_id, "_n").alias("first_id"), F.max_by(row_id, "_n").alias("last_id"),
        F.max_by(cursor, "_n").alias("_cursor"))
    # the page before every page but the first has a next one
    more = ranked.where((F.col("_n") - 1) % size == 0).where("page > 0").select(
        *keys, (F.col("page") - 1).alias("page"), F.lit(True).alias("_more"))
    return pages.join(more, [*keys, "page"], "left").select(
        *keys, "page", "rows", "first_id", "last_id",
        F.when(F.col("_more"), F.col("_cursor")).alias("next_cursor"))


def id_page(rows: DataFrame, row_id: str, limit: int, cursor=None,
            descending: bool = False) -> DataFrame:
    if cursor is not None:
        bound = F.lit(cursor)
        rows = rows.where(F.col(row_id) < bound if descending else F.col(row_id) > bound)
    return rows.orderBy(F.desc(row_id) if descending else F.asc(row_id)).limit(limit + 1)


def last_n_chronological(messages: DataFrame, n: int = DECISIONS_WINDOW) -> DataFrame:
    """The newest ``n`` messages of every room with their place in time order."""
    newest = top_within(messages, ["room_id"], [F.desc("message_id")], n, "_back").drop("_back")
    return top_within(newest, ["room_id"], ["message_id"], n, "position")


def message_grouping(messages: DataFrame, gap_seconds: int = HEADER_GAP_SECONDS,
                     **split) -> DataFrame:
    """Header and day-break flags per message, and the run each message belongs to.

    A header starts a run: the row or the one before is by the assistant, the day or the
    sender changes, or more than the gap has passed (strictly more).
    """
    split.setdefault("largest", largest_group(messages, ["room_id"]))
    rows = messages.withColumn("_row", F.struct("created_at", "sender_id", "kind"))
    prev = windowed(rows, ["room_id"], ["created_at", "message_id"],
                    {"_prev": ("lag", "_row")}, **split)
    before = F.col("_prev")
    new_day = before.isNull() | (F.to_date(before["created_at"]) != F.to_date("created_at"))
    gap = (F.unix_micros("created_at") - F.unix_micros(before["created_at"])
           > gap_seconds * 1_000_000)
    header = (F.col("kind").eqNullSafe("ai") | before["kind"].eqNullSafe("ai") | new_day
              | ~before["sender_id"].eqNullSafe(F.col("sender_id")) | gap)
    flagged = prev.withColumns({"new_day": new_day, "show_header": header}).withColumn(
        "_start", F.col("show_header").cast("bigint"))
    return windowed(flagged, ["room_id"], ["created_at", "message_id"],
                    {"run_id": ("sum", "_start")}, **split).drop("_row", "_prev", "_start")
