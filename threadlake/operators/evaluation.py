"""Retrieval evaluation: anchors to keys, recall at 5, reciprocal rank, misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.scalar import doc_key, message_key
from threadlake.operators.validate import text_contains
from threadlake.session import materialize


def _first_holders(anchors: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, anchor_id, cell): the least ``cell`` of the anchor's room whose text holds it.

    Equal texts of a room are read once, by their least cell, and equal anchors looked for once: with m
    copies of a text there are m anchors and m texts, not their pairs.
    """
    known = anchors.where(F.col("contains").isNotNull() & F.col("room_id").isNotNull())
    texts = cells.where(F.col("text").isNotNull() & F.col("room_id").isNotNull()).groupBy(
        "room_id", "text").agg(F.min("cell").alias("cell")).select(
        F.struct("room_id", "cell").alias("_at"), "room_id", "text")
    wanted = materialize(known.select("room_id", "contains").distinct(), "anchors").withColumn(
        "_needle", F.col("contains"))
    found = text_contains(texts, wanted, "_at", "text", "_needle", "contains", group="room_id")
    first = found.groupBy(F.col("_at.room_id").alias("room_id"), F.col("_needle").alias("contains")).agg(
        F.min("_at.cell").alias("cell"))
    return known.join(first, ["room_id", "contains"]).select("query_id", "anchor_id", "cell")


def resolve_anchors(anchors: DataFrame, messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, anchor_id, key): the first message, or first chunk of the first document, of
    the anchor's room that holds the anchor text.

    ``anchors(query_id, anchor_id, room_id, contains, kind)``.
    """
    said = anchors.where(F.coalesce("kind", F.lit("message")) != "doc")
    written = anchors.where(F.col("kind") == "doc")
    by_message = _first_holders(said, messages.select(
        "room_id", F.col("message_id").alias("cell"), F.col("body").alias("text"))).groupBy(
        "query_id", "anchor_id").agg(message_key(F.min("cell")).alias("key"))
    by_doc = _first_holders(written, chunks.select(
        "room_id", F.struct("doc_id", "chunk_index").alias("cell"), "text")).groupBy(
        "query_id", "anchor_id").agg(F.min("cell").alias("_c")).select(
        "query_id", "anchor_id",
        doc_key(F.col("_c.doc_id"), F.col("_c.chunk_index")).alias("key"))
    return by_message.unionByName(by_doc)


def first_chunk_keys(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, key): per document the first chunk that holds the question's text."""
    cells = chunks.select(F.struct("doc_id", "chunk_index").alias("_chunk"), "text")
    found = text_contains(cells, questions.select("query_id", "question"), "_chunk", "text",
                          "query_id", "question")
    return found.groupBy("query_id", F.col("_chunk.doc_id").alias("doc_id")).agg(
        F.min("_chunk.chunk_index").alias("_first")).select(
        "query_id", doc_key(F.col("doc_id"), F.col("_first")).alias("key"))


def retrieval_eval(questions: DataFrame, expected: DataFrame,
                   ranked: DataFrame) -> DataFrame:
    """Per question: keys expected, found in the top 5, recall at 5, reciprocal rank.

    Recall looks at the first five sources, the reciprocal rank at the whole list. Questions
    without any expected key score 0.
    """
    pairs = expected.select("query_id", "key").join(
        ranked.select("query_id", "key", "rank"), ["query_id", "key"], "left")
    per = pairs.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(F.col("rank") <= 5).alias("found"),
        F.min("rank").alias("_best"))
    zero = F.lit(0).cast("bigint")
    return questions.select("query_id").join(per, "query_id", "left").select(
        "query_id", F.coalesce("expected", zero).alias("expected"),
        F.coalesce("found", zero).alias("found"),
        F.round(F.coalesce(F.try_divide("found", "expected"), F.lit(0.0)), 6)
        .alias("recall_at_5"),
        F.round(F.coalesce(1.0 / F.col("_best"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def eval_summary(per_question: DataFrame) -> DataFrame:
    return per_question.agg(
        F.count(F.lit(1)).alias("questions"),
        F.round(F.avg("recall_at_5"), 4).alias("recall_at_5"),
        F.round(F.avg("reciprocal_rank"), 4).alias("mrr"))


def misses(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """Expected keys that the top five lack."""
    top = ranked.where(F.col("rank") <= 5).select("query_id", "key")
    return expected.select("query_id", "key").join(top, ["query_id", "key"], "left_anti")
