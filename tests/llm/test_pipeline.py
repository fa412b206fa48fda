"""The pipeline stage by stage against plain versions, each on its own input."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from tests.llm.conftest import CLASHES, DOCS
from tests.llm.test_langid import WORDS, text_of
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import plain_fingerprint, plain_groups
from threadlake.session import materialize


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, root = random.Random(11), str(tmp_path_factory.mktemp("corpus"))
    rows, leak = [], " ".join(f"leaked{i} the of and" for i in range(10))
    for i in range(160):
        lang = rng.choice(list(WORDS))
        rows.append((i, text_of(rng, lang, 80), lang, rng.choice(["a", "b", "b", None])))
    copied = rows[5][1]
    rows += [(1000, copied, "en", "a"), (1001, copied, "en", "b"), (1002, None, "en", "a"),
             (1003, "12345 !!", "en", "a"), (1004, f"{rows[7][1]} {leak} {rows[8][1]}", "en", "b")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(
        f"{root}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(
        f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontamination", "mixture", "shards"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, after = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs.collect()
        out = stage(spark, docs, folder)
        assert out.columns[:len(DOCS)] == [f.name for f in DOCS]
        assert len(out.columns) == len(DOCS) + (name == "shards")
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after[name] = docs.collect()

    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(after["language"]) == [i for i in ids(before["language"])
                                      if i not in (1002, 1003)]

    prints = {r.doc_id: plain_fingerprint(r.text) for r in before["near_dedup"]}
    groups, least = plain_groups(prints.values(), 3), {}
    for i in sorted(prints):
        least.setdefault(groups[prints[i]], i)
    assert ids(after["near_dedup"]) == sorted(least.values())

    assert ids(after["decontamination"]) == [i for i in ids(before["decontamination"])
                                             if i != 1004]

    sizes, taken = {}, {}
    for r in before["mixture"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in after["mixture"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert taken == {s: int(t) for s, t in brute_targets(sizes).items()}
    assert sum(Fraction(v) for v in taken.values()) <= sum(sizes.values())

    assert ids(after["shards"]) == ids(before["shards"])
    shard_of = {}
    for r in after["shards"]:
        assert 0 <= r.shard < 16 and shard_of.setdefault(r.text, r.shard) == r.shard


def test_run_gives_the_same_rows(spark, folder):
    once, twice = (sorted(map(str, queries()["pipeline"](spark, folder).collect()))
                   for _ in range(2))
    assert once == twice and once


def test_an_empty_corpus(spark, folder, tmp_path):
    root = str(tmp_path)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(
            f"{root}/{name}.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []


def test_hard_rows_through_all_stages(spark, folder):
    """Null ids and columns, repeated rows, ties, a very long text, extra columns with clashing names."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = random.Random(5)
    hard = [(None, text_of(rng, "en", 80), "en", "a"), (None, text_of(rng, "en", 80), None, None),
            (7, text_of(rng, "en", 90), "en", "b"), (2000, text_of(rng, "en", 40_000), "en", "b"),
            (2001, "the of and", "en", None)]
    hard += [hard[3], hard[0]]
    more = spark.createDataFrame([(*r, len(r[1])) for r in hard], DOCS)
    docs = docs.unionByName(more).unionByName(docs.where("doc_id < 3"))
    for name in CLASHES:
        if name not in ("shard", *docs.columns):
            docs = docs.withColumn(name, F.lit("x"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[:len(columns)] == columns
        docs = materialize(out, name)
        kept[name] = docs.collect()
    texts = {name: [r.text for r in rows] for name, rows in kept.items()}
    for row in hard:  # whatever its id, a clean text stays, once, and gets a shard
        assert texts["near_dedup"].count(row[1]) == 1 and texts["decontamination"].count(row[1]) == 1
    assert {r.shard for r in kept["shards"]} <= set(range(16))
