"""Rank fusion, rerank, budget packing, context, citations, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.constants import (
    CONTEXT_TOKEN_BUDGET, DECISION_PATTERN, DECISIONS_KEEP, DECISIONS_WINDOW, RERANK_KEEP,
    RRF_K, SOURCE_OVERHEAD_TOKENS,
)
from threadlake.functions.scalar import (
    approx_tokens, citation_markers, header_time, snippet, tokenize,
)
from threadlake.operators.ordered import top_within
from threadlake.operators.scope import enrich_sender, is_knowledge


def rrf_fusion(vector_leg: DataFrame, lexical_leg: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse two ranked legs: ``(query_id, key, rank)`` each, ranks from 1.

    A source scores 1 / (k + rank) per leg. Union and sum take the place of a full outer join.
    Equal scores keep the vector leg's order, then the lexical leg's.
    """
    both = vector_leg.select("query_id", "key", F.col("rank").alias("vector_rank"),
                             F.lit(None).cast("int").alias("lexical_rank")).unionByName(
        lexical_leg.select("query_id", "key", F.lit(None).cast("int").alias("vector_rank"),
                           F.col("rank").alias("lexical_rank")))
    fused = both.groupBy("query_id", "key").agg(
        F.min("vector_rank").alias("vector_rank"), F.min("lexical_rank").alias("lexical_rank"))
    part = [F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
            for c in ("vector_rank", "lexical_rank")]
    scored = fused.withColumn("score", part[0] + part[1])
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("vector_rank"), "lexical_rank")
    return scored.withColumn("fused_rank", F.row_number().over(order))


def rerank_overlap(candidates: DataFrame, keep: int = RERANK_KEEP) -> DataFrame:
    """Reorder by the number of text tokens (with repeats) that the question also has.

    Lists of at most ``keep`` sources stay as they are. Expects question, text, final_rank;
    a query has at most a few dozen candidates.
    """
    asked = tokenize(F.col("question"))
    overlap = F.size(F.filter(tokenize(F.col("text")), lambda t: F.array_contains(asked, t)))
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    scored = candidates.withColumns({"overlap": overlap, "_size": size})
    order = [F.desc(F.when(F.col("_size") > keep, F.col("overlap"))), "final_rank"]
    return top_within(scored, ["query_id"], order, keep, "rerank").drop("_size")


def pack_to_budget(sources: DataFrame, keys: list[str], rank: str, text: str = "text",
                   budget: int = CONTEXT_TOKEN_BUDGET) -> DataFrame:
    """Strongest sources that fit the token budget, in rank order, numbered from 1.

    A source that would overrun is skipped and smaller later ones may still fit, so this is a
    fold over each short ranked list and not a running sum.
    """
    cost = approx_tokens(F.col(text)) + SOURCE_OVERHEAD_TOKENS
    lists = sources.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct(F.col(rank).cast("int").alias("r"), cost.alias("c")))).alias("_list"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"),
                    F.array().cast("array<int>").alias("kept"))
    fits = lambda s, x: s["used"] + x["c"] <= budget
    packed = F.aggregate("_list", zero, lambda s, x: F.struct(
        F.when(fits(s, x), s["used"] + x["c"]).otherwise(s["used"]).alias("used"),
        F.when(fits(s, x), F.concat(s["kept"], F.array(x["r"]))).otherwise(s["kept"])
        .alias("kept")), lambda s: s["kept"])
    kept = lists.select(*keys, F.posexplode(packed).alias("_i", rank)).select(
        *keys, rank, (F.col("_i") + 1).alias("source_index"))
    return sources.join(kept, [*keys, rank])


def build_context(packed: DataFrame) -> DataFrame:
    """One text per query: numbered source blocks and the question.

    Expects query_id, question, source_index, kind, text, sender_name, created_at, filename,
    page.
    """
    header = F.when(F.col("kind") == "message", F.concat(
        F.lit("message | "), F.coalesce("sender_name", F.lit("unknown")), F.lit(" | "),
        header_time(F.col("created_at")))).otherwise(F.concat(
            F.lit('document "'), F.coalesce("filename", F.lit("document")),
            F.lit('" | page '), F.coalesce("page", F.lit(1)).cast("string")))
    block = F.concat(F.lit("["), F.col("source_index").cast("string"),
                     F.lit("] BEGIN SOURCE ("), header, F.lit(")\n"), F.col("text"),
                     F.lit("\nEND SOURCE"))
    blocks = packed.groupBy("query_id", "question").agg(F.sort_array(F.collect_list(
        F.struct("source_index", block.alias("b")))).alias("_blocks"))
    body = F.array_join(F.transform("_blocks", lambda x: x["b"]), "\n")
    return blocks.select("query_id", F.concat(
        F.lit("<sources>\n"), body, F.lit("\n</sources>\n\nQuestion: "), F.col("question"))
        .alias("context"))


def map_citations(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """Citation rows for the [n] markers of ``answers(query_id, answer)``.

    Marker n names the n-th packed source. Numbers that were not shown are ignored.
    """
    shown = packed.groupBy("query_id").agg(F.max("source_index").alias("_shown"))
    marks = answers.join(shown, "query_id").select("query_id", F.explode(
        citation_markers(F.col("answer"), F.col("_shown"))).alias("source_index"))
    part = lambda i: F.get(F.split("key", ":"), F.lit(i))
    is_doc = F.col("kind") == "doc"
    return marks.join(packed, ["query_id", "source_index"]).select(
        "query_id", F.col("source_index").alias("index"), "kind", "room_id", "key",
        F.when(~is_doc, part(1).try_cast("bigint")).alias("message_id"),
        F.when(is_doc, part(1).try_cast("bigint")).alias("doc_id"),
        F.when(is_doc, part(2).try_cast("int")).alias("chunk_index"),
        (F.when(is_doc, F.col("page")) if "page" in packed.columns else F.lit(None))
        .cast("int").alias("page"),
        snippet(F.col("text")).alias("snippet"),
        F.coalesce("sender_name", F.when(F.col("kind") == "doc", F.col("filename")))
        .alias("sender_name"), "created_at")


def extract_decisions(messages: DataFrame, users: DataFrame, pattern: str = DECISION_PATTERN,
                      window: int = DECISIONS_WINDOW, keep: int = DECISIONS_KEEP) -> DataFrame:
    """Decisions among the newest ``window`` knowledge messages of every room, first ``keep``
    in time order, each with its author's display name and the id of its message."""
    recent = top_within(messages.where(is_knowledge()), ["room_id"], [F.desc("message_id")],
                        window, "_back").drop("_back")
    line = F.replace(F.col("body"), F.lit("\n"), F.lit(" "))
    hits = recent.where((F.length(line) > 0) & line.rlike(pattern))
    first = top_within(hits, ["room_id"], ["message_id"], keep, "position")
    return enrich_sender(first, users).select(
        "room_id", "position", F.substring(line, 1, 160).alias("decision"),
        F.col("display_name").alias("decided_by"), F.to_date("created_at").alias("date"),
        F.array("message_id").alias("source_ids"))


def citation_id_guard(decisions: DataFrame, shown: DataFrame) -> DataFrame:
    """Keep only source ids among the messages shown for the room; drop decisions left
    without any. ``decisions`` has room_id, position and source_ids."""
    listed = decisions.select("room_id", "position", F.posexplode("source_ids")
                              .alias("_i", "message_id"))
    real = listed.join(shown.select("room_id", "message_id"), ["room_id", "message_id"],
                       "left_semi")
    ids = real.groupBy("room_id", "position").agg(
        F.sort_array(F.collect_list(F.struct("_i", "message_id"))).alias("_ids"))
    return decisions.drop("source_ids").join(ids, ["room_id", "position"]).withColumn(
        "source_ids", F.transform("_ids", lambda x: x["message_id"])).drop("_ids")

