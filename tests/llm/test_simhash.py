import random

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import CLASHES
from threadlake.llm import simhash
from threadlake.llm.components import components


def plain_fingerprint(text):
    words = bytes((text or ""), "utf-8").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64)
               if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(prints, bits):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    array = np.array(values, np.uint64)
    for i, a in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= bits):
            x, y = root(a), root(values[i + 1 + j])
            parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "one two", "A b C", "É é x y z w",
                                  "w " * 70_000 + "end"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def clouds(seed, count):
    """Fingerprints in dense clouds, so that many share halves and quarters."""
    rng, out = random.Random(seed), {0, 1, 7}
    centres = [rng.getrandbits(64) for _ in range(6)]
    while len(out) < count:
        value = rng.choice(centres)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            value ^= 1 << rng.randrange(64)
        out.add(value if rng.random() < .9 else rng.getrandbits(64))
    return [v - (1 << 64) if v >> 63 else v for v in out]


@pytest.mark.parametrize("dense", [1, 4, 512])
@pytest.mark.parametrize("bits", [0, 1, 3])
def test_groups_equal_brute_force_whether_keys_are_dense_or_not(spark, dense, bits):
    values = clouds(bits, 500)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash.groups(df, bits, dense).collect()}
    want = plain_groups([v % (1 << 64) for v in values], bits)
    least = {}
    for i, v in enumerate(values):
        least.setdefault(want[v % (1 << 64)], i)
    assert got == {v: least[want[v % (1 << 64)]] for v in values}


def test_dense_keys_give_no_more_rows_than_members(spark):
    # a cloud in one half: every pair shares the other half
    values = [(1 << 40) | i for i in range(1500)]
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    assert simhash.links(df, dense=16).count() < 80 * len(values)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(70)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(path + star + [(5, 5), (1, 0)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(71)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(df.limit(0)).collect() == []


def test_near_groups_and_keep_one(docs):
    base = " ".join(f"word{i}" for i in range(6000))
    rows = [(5, base), (3, base), (9, base.replace("word7 ", "changed ")), (1, "other text here"),
            (4, None), (8, ""), (None, "without id a b c"), (1, "other text here")]
    df = docs(rows, extra=CLASHES)
    got = [(r.doc_id, r.component_id) for r in simhash.near_groups(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 3), (1, 1), (1, 1), (4, 4), (8, 4),
                                           (None, None)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 1, 4, None], key=str)
    assert simhash.near_groups(docs([])).collect() == []
    assert simhash.keep_one(docs([])).collect() == []


def test_keep_one_keeps_a_row_of_each_group_whatever_the_ids(docs):
    def text(i):
        return " ".join(f"w{i}x{n}" for n in range(60))

    # without ids: two groups; one id: two texts; a copy of document 3 that has no id
    rows = [(None, text(0)), (None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)),
            (3, text(4)), (None, text(4)), (3, text(4)), (7, None), (8, "")]
    kept = simhash.keep_one(docs(rows, extra=CLASHES)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (3, text(4)), (7, None)],
        key=str)
