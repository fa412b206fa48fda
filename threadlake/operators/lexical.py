"""Lexical leg: exact BM25 top-k over a stored inverted index.

The scorer is documented here because the one it replaces lives inside a document store:
k1 = 1.2, b = 0.75, idf = ln(1 + (n - df + 0.5) / (df + 0.5)) over the whole eligible corpus,
tokens as in ``tokenize``, each query token counted once, scores at six decimals, ties to the
smaller id.

Only the postings of the queries' tokens are read. A very common word still joins a third of all
texts with every query that uses it. When that volume is large, the greatest weights of the index's
blocks replace the full join: the heaviest postings per (word, room) give every query a lower bound
on its k-th score, and a block is read only if a posting in it can lift its text over that bound
together with the query's weaker words. The result stays exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.constants import LEG_LIMIT
from threadlake.functions.scalar import tokenize
from threadlake.operators.ordered import top_within
from threadlake.session import materialize, scratch_path
from threadlake.sources.postings import PostingTable, weight

# (query, text) postings joined directly before the bounds are worth their extra passes.
DIRECT_PAIRS = 50_000_000
# Postings of the direct join for each part that a very common word is cut into.
PART_PAIRS = 2_000_000
_SLACK = 2e-6


def query_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(
        F.array_distinct(tokenize(F.col("question")))).alias("token"))


def _total(pairs: DataFrame, k: int) -> DataFrame:
    scored = pairs.groupBy("query_id", "doc_id", "room_id").agg(
        F.round(F.sum("weight"), 6).alias("score"))
    return top_within(scored, ["query_id"], [F.desc("score"), "doc_id"], k, "rank")


def _bounded(asked: DataFrame, tokens: DataFrame, postings: DataFrame, blocks: DataFrame,
             k: int) -> DataFrame:
    """``asked(query_id, room_id, token)``: candidates by bounds, then their full scores.

    ``blocks(token, room_id, level, documents, bound)``: no posting of the block weighs more.
    """
    word = ["token", "room_id"]
    # the fewest blocks per (word, room) with the k heaviest postings in them, roughly
    heavier = Window.partitionBy(*word).orderBy(F.desc("level")).rowsBetween(
        Window.unboundedPreceding, -1)
    first = blocks.withColumn("_before", F.coalesce(F.sum("documents").over(heavier), F.lit(0))).where(
        F.col("_before") < k).select(*word, "level")
    best = top_within(postings.join(first, [*word, "level"], "left_semi"), word,
                      [F.desc("weight"), "doc_id"], k, "_n")
    seeds = asked.join(best, word)
    partial = top_within(
        seeds.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("_sum")),
        ["query_id"], [F.desc("_sum"), "doc_id"], k, "_n")
    floor = partial.where(F.col("_n") == k).select("query_id", F.col("_sum").alias("_floor"))

    # A text that reaches the floor does so through its strongest query word t: its weight
    # for t plus the most the weaker words can add.
    top = blocks.groupBy(*word).agg(F.max("bound").alias("_max"))
    weaker = (Window.partitionBy("query_id", "room_id").orderBy("_max", "token")
              .rowsBetween(Window.unboundedPreceding, -1))
    need = (asked.join(top, word)
            .withColumn("_below", F.coalesce(F.sum("_max").over(weaker), F.lit(0.0)))
            .join(floor, "query_id", "left")
            .withColumn("_least", F.greatest(F.lit(0.0), F.coalesce("_floor", F.lit(0.0))
                                             - F.col("_below") - _SLACK))
            .where(F.col("_max") >= F.col("_least")))
    read = need.select("query_id", *word, "_least").join(
        blocks.select(*word, "level", "bound"), word).where(F.col("bound") >= F.col("_least")).drop("bound")
    candidates = read.join(postings, [*word, "level"]).where(
        F.col("weight") >= F.col("_least")).select("query_id", "doc_id").distinct()
    full = candidates.join(tokens, "query_id").join(postings, ["doc_id", "token"])
    return _total(full, k)


def indexed_leg(queries: DataFrame, index: PostingTable, scope: DataFrame, k: int = LEG_LIMIT,
                direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """(query_id, doc_id, room_id, score, rank): BM25 top k over the rooms in scope.

    ``queries(query_id, question)``; the index holds the corpus.
    """
    n, mean = index.statistics()
    tokens = materialize(query_tokens(queries), "tokens")
    asked, wanted = tokens.join(scope, "query_id"), index.wanted(tokens)
    df = materialize(index.frequencies(wanted), "frequencies")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = df.select("token", "df", idf.alias("idf"))
    postings = index.postings(wanted).join(worth, "token").select(
        "token", "room_id", "level", "doc_id",
        (F.col("idf") * weight(F.col("tf"), F.col("length"), mean)).alias("weight"))
    volume = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_q")).join(df, "token").agg(
        F.sum(F.col("_q") * F.col("df"))).first()[0] or 0
    if volume <= direct_pairs:
        # a word that a third of all texts have would otherwise be joined in one task for a room; the
        # few questions go to every part, each posting to one
        parts = int(-(-volume // PART_PAIRS)) or 1
        return _total(asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(
            postings.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")),
            ["token", "room_id", "_part"]), k)
    blocks = index.blocks(wanted).join(worth, "token").select(
        "token", "room_id", "level", "documents",
        (F.col("idf") * weight(F.col("tf"), F.col("length"), mean)).alias("bound"))
    return _bounded(asked, tokens, postings, materialize(blocks, "blocks"), k)


def lexical_leg(queries: DataFrame, corpus: DataFrame, scope: DataFrame, k: int = LEG_LIMIT,
                direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """``indexed_leg`` over ``corpus(doc_id, room_id, text)``, indexed for this call."""
    index = PostingTable(queries.sparkSession, scratch_path(queries.sparkSession, "postings"),
                         corpus.schema["doc_id"].dataType.simpleString())
    index.add(corpus, 0)
    return indexed_leg(queries, index, scope, k, direct_pairs)
