"""De-duplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.scalar import normalize_text
from threadlake.operators.ordered import top_within


def dedup_latest(df: DataFrame, key: str = "id", version: str = "updatedAt") -> DataFrame:
    """One row per key: the greatest version, nulls last.

    Equal versions are settled by the remaining columns, so the result is a function of the
    rows alone. Without a version column any row will do (``dedup_any``).
    """
    if version not in df.columns:
        return dedup_any(df, key)
    rest = [F.col(c).desc_nulls_last() for c in sorted(df.columns) if c not in (key, version)]
    order = [F.col(version).desc_nulls_last(), *rest]
    return top_within(df, [key], order, 1, "_latest").drop("_latest")


def dedup_any(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per key, chosen by value so that a rerun chooses the same row."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.dropDuplicates([key])
    picked = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c)
                           for c in df.columns])


def dedup_send(messages: DataFrame) -> DataFrame:
    """First message per (sender, client id); retries resolve to it."""
    return top_within(messages, ["sender_id", "client_msg_id"], ["message_id"], 1,
                      "_first").drop("_first")


def resolve_retries(messages: DataFrame) -> DataFrame:
    """Every send with the id of the message it resolves to."""
    first = messages.groupBy("sender_id", "client_msg_id").agg(
        F.min("message_id").alias("canonical_id"))
    return messages.join(first, ["sender_id", "client_msg_id"]).withColumn(
        "is_retry", F.col("message_id") != F.col("canonical_id"))


def reconcile_by_either_key(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Merge arriving rows into a stored timeline.

    A row equals a stored one when either its client id or its id matches, inside one room.
    The later arrival replaces the earlier row. Two passes suffice because a client id maps to
    one id once the server has answered: first per client id, then per id. Rows without an id
    are still pending; they are only ever replaced by their client id.
    """
    both = stored.withColumn("_seq", F.lit(0)).unionByName(
        arriving.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    newest = [F.col("_seq").desc(), F.col("message_id").desc_nulls_last(),
              *[F.col(c).desc_nulls_last() for c in ("body",) if c in both.columns]]
    keyed = both.where(F.col("client_msg_id").isNotNull())
    unkeyed = both.where(F.col("client_msg_id").isNull())
    by_client = top_within(keyed, ["room_id", "sender_id", "client_msg_id"], newest, 1,
                           "_pick").drop("_pick").unionByName(unkeyed)
    by_id = top_within(by_client.where(F.col("message_id").isNotNull()),
                       ["room_id", "message_id"],
                       [F.col("_seq").desc(), F.col("client_msg_id").desc_nulls_last()], 1,
                       "_pick").drop("_pick")
    return by_id.unionByName(by_client.where(F.col("message_id").isNull())).drop("_seq")


def near_dup_collapse(ranked: DataFrame, limit: int, query: str = "query_id",
                      rank: str = "fused_rank", text: str = "text") -> DataFrame:
    """Keep the best-ranked source of every distinct normalised text, then re-rank.

    Commands are dropped first: a question is not a source. The lists are already bounded by
    the leg limits, so each query's rows are few.
    """
    from threadlake.functions.scalar import is_command

    clean = ranked.where(~is_command(F.col(text))).withColumn(
        "_norm", normalize_text(F.col(text)))
    first = top_within(clean, [query, "_norm"], [rank], 1, "_dup").drop("_dup", "_norm")
    return top_within(first, [query], [rank], limit, "final_rank")
