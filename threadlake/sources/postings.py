"""Inverted index as Parquet tables, kept up batch by batch.

``postings`` has a row for each token and text, in folders by batch and token bucket; inside a bucket
rows are sorted by token, room and block, so a search reads the buckets and row groups of its tokens.
A block is what a token has in a room at one level of weight; ``blocks`` has the greatest term
frequency and least length of each, which bound the weight of every posting in it whatever the corpus
has become since. A batch names the texts it replaces in ``gone``; ``totals`` has its share of the
corpus statistics. A repeated batch replaces its own folders, so a replay changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.constants import BM25_B, BM25_K1
from threadlake.functions.scalar import tokenize
from threadlake.session import spread

BUCKETS = 64
# Levels of a posting's weight, taken at this mean length; only the choice of blocks depends on it.
LEVELS, LEVEL_MEAN = 8, 100.0
# Tokens up to which the scan gets them as a list; more are joined.
LISTED_TOKENS = 512

_TABLES = {
    "postings": "token string, room_id bigint, level int, doc_id {id}, tf int, length int, "
                "batch bigint, bucket int",
    "blocks": "token string, room_id bigint, level int, documents bigint, tf int, length int, "
              "batch bigint",
    "docs": "doc_id {id}, length int, batch bigint",
    "gone": "doc_id {id}, length int, old bigint, batch bigint",
    "totals": "documents bigint, tokens bigint, batch bigint",
}


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def weight(tf: Column, length: Column, mean: float) -> Column:
    """BM25 weight without the idf; grows with ``tf`` and falls with ``length``."""
    norm = BM25_K1 * (1 - BM25_B + BM25_B * length / F.lit(float(mean or 1.0)))
    return tf * (BM25_K1 + 1) / (tf + norm)


@dataclass(frozen=True)
class Wanted:
    """Tokens to look up: a table of them and, if they are few, the list and their buckets."""
    tokens: DataFrame
    listed: list[str] | None
    buckets: list[int] | None

    def of(self, rows: DataFrame) -> DataFrame:
        if self.listed is not None:
            return rows.where(F.col("token").isin(self.listed))
        return rows.join(self.tokens, "token", "left_semi")


class PostingTable:
    def __init__(self, spark: SparkSession, root: str, id_type: str = "string"):
        self.spark, self.root, self.id_type = spark, root.rstrip("/"), id_type

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def table(self, name: str) -> DataFrame:
        schema = _TABLES[name].format(id=self.id_type)
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def next_batch(self) -> int:
        """One more than the highest batch number in use."""
        last = self.table("totals").agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def add(self, corpus: DataFrame, batch: int | None = None) -> None:
        """Index ``corpus(doc_id, room_id, text)``; a text known already is replaced."""
        batch = self.next_batch() if batch is None else batch
        tokens = F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>"))
        texts = spread(corpus).select(
            F.col("doc_id").cast(self.id_type).alias("doc_id"),
            F.col("room_id").cast("bigint").alias("room_id"), tokens.alias("_tokens")).withColumn(
            "length", F.size("_tokens"))

        def write(name: str, rows: DataFrame, *by: str) -> None:
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/batch={batch}") \
                if by else rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

        counts = texts.select("doc_id", "room_id", "length", F.explode("_tokens").alias("token")).groupBy(
            "doc_id", "room_id", "length", "token").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        level = F.least(F.lit(LEVELS - 1), F.floor(
            weight(F.col("tf"), F.col("length"), LEVEL_MEAN) * LEVELS / (BM25_K1 + 1))).cast("int")
        rows = counts.select("token", "room_id", level.alias("level"), "doc_id", "tf", "length",
                             bucket(F.col("token")).alias("bucket"))
        # a hot token's postings lie in one bucket, but are spread over tasks by text
        write("postings", rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
              .sortWithinPartitions("bucket", "token", "room_id", F.desc("level")), "bucket")
        own = self.table("postings").where(F.col("batch") == batch)
        write("blocks", own.groupBy("token", "room_id", "level").agg(
            F.count(F.lit(1)).alias("documents"), F.max("tf").alias("tf"),
            F.min("length").alias("length")))
        write("docs", texts.select("doc_id", "length"))
        mine = self.table("docs").where(F.col("batch") == batch)
        older = self.table("docs").where(F.col("batch") < batch).join(
            mine.select("doc_id"), "doc_id", "left_semi").join(
            self.table("gone").where(F.col("batch") < batch).select("doc_id", F.col("old").alias("batch")),
            ["doc_id", "batch"], "left_anti")
        write("gone", older.select("doc_id", "length", F.col("batch").alias("old")))
        lost = self.table("gone").where(F.col("batch") == batch).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t"))
        write("totals", mine.agg(F.count(F.lit(1)).alias("n"), F.coalesce(
            F.sum("length"), F.lit(0)).alias("t")).select("n", "t").unionByName(
            lost.select((-F.col("n")).alias("n"), (-F.col("t")).alias("t"))).agg(
            F.sum("n").alias("documents"), F.sum("t").alias("tokens")))

    def statistics(self) -> tuple[int, float]:
        """Number of texts and their mean length; reads a row for each batch."""
        n, tokens = self.table("totals").agg(F.sum("documents"), F.sum("tokens")).first()
        return n or 0, (tokens or 0) / n if n else 0.0

    def wanted(self, tokens: DataFrame) -> Wanted:
        """The distinct ``token`` of a table, as a list for the scan if they are few."""
        distinct = tokens.select("token").distinct()
        some = [r["token"] for r in distinct.limit(LISTED_TOKENS + 1).collect()]
        if len(some) <= LISTED_TOKENS:
            return Wanted(distinct, some, sorted({r["b"] for r in distinct.select(
                bucket(F.col("token")).alias("b")).distinct().collect()}))
        return Wanted(distinct, None, None)  # so many have a token in nearly every bucket

    def postings(self, wanted: Wanted) -> DataFrame:
        """``token, room_id, level, doc_id, tf, length`` of the wanted tokens in texts not replaced."""
        rows = wanted.of(self.table("postings"))
        if wanted.buckets is not None:
            rows = rows.where(F.col("bucket").isin(wanted.buckets))
        if self.replaced():
            rows = rows.join(self.table("gone").select("doc_id", F.col("old").alias("batch")),
                             ["doc_id", "batch"], "left_anti")
        return rows.select("token", "room_id", "level", "doc_id", "tf", "length")

    def replaced(self) -> bool:
        return not self.table("gone").isEmpty()

    def blocks(self, wanted: Wanted) -> DataFrame:
        """``token, room_id, level, documents, tf, length``: the wanted tokens' blocks over all batches.

        Replaced texts still count in ``documents`` and in the bounds, which stay bounds.
        """
        return wanted.of(self.table("blocks")).groupBy("token", "room_id", "level").agg(
            F.sum("documents").alias("documents"), F.max("tf").alias("tf"),
            F.min("length").alias("length"))

    def frequencies(self, wanted: Wanted) -> DataFrame:
        """``token, df``: texts that hold each wanted token."""
        if not self.replaced():
            return self.blocks(wanted).groupBy("token").agg(F.sum("documents").alias("df"))
        return self.postings(wanted).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
