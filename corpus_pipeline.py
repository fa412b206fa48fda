"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding.

Every stage takes the documents its predecessor kept and returns a DataFrame with the columns of
``documents``; the last adds the shard. A stage's result is stored before the next one reads it.

The near-duplicate stage links as the SimHash operator's contract does: three-word shingles, at most
three differing bits, no other likeness asked for.

Cases, for every stage. Null text or text without a letter: goes at the first stage, as no language is
recognised. Null ids: kept and judged by their text. Repeated rows and rows of one id with different
texts: one row of each group of near-duplicates stays, the one with the least id, then text hash.
Null source: a source of its own, after the named ones. Equal texts: one shard. Very long texts: read
whole. Empty documents or benchmark: no rows, or nothing removed. Extra columns, whatever their names:
kept by every stage; only ``shard`` is the pipeline's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadlake.llm import decontaminate, langid, mixing, sharding, simhash
from threadlake.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark text in them."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, repeating documents where the target asks for it."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, equal texts together."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]

# The language models and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
