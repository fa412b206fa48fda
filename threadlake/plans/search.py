"""Hybrid retrieval over tables of questions: scope, two legs, fusion, collapse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.constants import EMBED_DIMS, FUSED_LIMIT, LEG_LIMIT
from threadlake.functions.embedding import embed
from threadlake.functions.scalar import doc_key, message_key
from threadlake.operators.dedup import near_dup_collapse
from threadlake.operators.fusion import rrf_fusion
from threadlake.operators.knn import vector_knn
from threadlake.operators.lexical import indexed_leg, lexical_leg
from threadlake.operators.scope import knowledge_filter, memory_gate
from threadlake.session import materialize, spread
from threadlake.sources.postings import PostingTable

SOURCE_COLUMNS = ("key", "kind", "room_id", "text", "sender_id", "filename", "page",
                  "created_at")


def message_points(messages: DataFrame, rooms: DataFrame, dims: int = EMBED_DIMS) -> DataFrame:
    """Knowledge messages as sources with vectors."""
    return spread(message_sources(messages, rooms)).withColumn(
        "vector", embed(F.col("text"), dims))


def chunk_points(chunks: DataFrame, rooms: DataFrame, dims: int = EMBED_DIMS) -> DataFrame:
    """Document chunks of memory-enabled rooms as sources with vectors."""
    return spread(memory_gate(chunks, rooms)).select(
        doc_key(F.col("doc_id"), F.col("chunk_index")).alias("key"), F.lit("doc").alias("kind"),
        "room_id", "text", F.lit(None).cast("bigint").alias("sender_id"), "filename", "page",
        F.lit(None).cast("timestamp").alias("created_at"),
        embed(F.col("text"), dims).alias("vector"))


def vector_leg(questions: DataFrame, points: DataFrame, scope: DataFrame,
               k: int = LEG_LIMIT, dims: int = EMBED_DIMS) -> DataFrame:
    asked = questions.select("query_id", embed(F.col("question"), dims).alias("vector"))
    hits = vector_knn(asked, points.withColumnRenamed("key", "point_id"), scope, k)
    return hits.withColumnRenamed("point_id", "key")


def message_corpus(messages: DataFrame, rooms: DataFrame) -> DataFrame:
    """What the lexical leg searches: ``doc_id, room_id, text`` of the knowledge messages."""
    return knowledge_filter(messages, rooms).select(
        message_key(F.col("message_id")).alias("doc_id"), "room_id",
        F.col("body").alias("text"))


def message_lexical_leg(questions: DataFrame, messages: DataFrame, rooms: DataFrame,
                        scope: DataFrame, k: int = LEG_LIMIT,
                        index: PostingTable | None = None) -> DataFrame:
    """The messages' lexical hits, from the stored index if there is one."""
    found = (indexed_leg(questions, index, scope, k) if index else
             lexical_leg(questions, message_corpus(messages, rooms), scope, k))
    return found.withColumnRenamed("doc_id", "key")


def message_sources(messages: DataFrame, rooms: DataFrame) -> DataFrame:
    """Knowledge messages as sources, without vectors."""
    return knowledge_filter(messages, rooms).select(
        message_key(F.col("message_id")).alias("key"), F.lit("message").alias("kind"),
        "room_id", F.col("body").alias("text"), "sender_id",
        F.lit(None).cast("string").alias("filename"), F.lit(None).cast("int").alias("page"),
        "created_at")


def hybrid_retrieve_sources(questions: DataFrame, points: DataFrame, sources: DataFrame,
                            messages: DataFrame, rooms: DataFrame, scope: DataFrame,
                            limit: int = FUSED_LIMIT,
                            index: PostingTable | None = None) -> DataFrame:
    """``hybrid_retrieve`` where ``sources`` lists further sources, with or without vectors; a
    source also in ``points`` is taken from there."""
    # stored: its size tells whether the texts have to be moved to the hits or the hits to the texts
    fused = materialize(rrf_fusion(
        vector_leg(questions, points, scope),
        message_lexical_leg(questions, messages, rooms, scope, index=index)), "fused")
    hit = fused.select("key").distinct()
    held = points.select(*SOURCE_COLUMNS).join(hit, "key", "left_semi")
    known = held.unionByName(sources.select(*SOURCE_COLUMNS).join(hit, "key", "left_semi").join(
        held.select("key"), "key", "left_anti"))
    ranked = fused.join(known, "key").join(questions.select("query_id", "question"),
                                           "query_id")
    return near_dup_collapse(ranked, limit)


def hybrid_retrieve(questions: DataFrame, points: DataFrame, messages: DataFrame,
                    rooms: DataFrame, scope: DataFrame,
                    limit: int = FUSED_LIMIT, index: PostingTable | None = None) -> DataFrame:
    """Final sources per question with ``final_rank``; both legs see only the scope.

    A message that has no vector yet is found by its words.
    """
    return hybrid_retrieve_sources(questions, points, message_sources(messages, rooms), messages,
                                   rooms, scope, limit, index)
