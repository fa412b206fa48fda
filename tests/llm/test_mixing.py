import random
from fractions import Fraction

import pytest

from tests.llm.conftest import CLASHES
from threadlake.llm import mixing


def brute_targets(sizes):
    """Share by weight, hold what exceeds three times its size, share the rest, and so on."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        rest, weights = total - sum(held.values()), sum(weight[s] for s in free)
        now = {s: Fraction(rest * weight[s], weights) for s in free}
        over = [s for s in free if now[s] > 3 * sizes[s]]
        if not over:
            return {**now, **held}
        held |= {s: 3 * sizes[s] for s in over}


def rows_for(seed, count=300):
    rng = random.Random(seed)
    sources = ["a", "b", None, "z", "é", "Z"]
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 12))), "en",
             rng.choices(sources, [1, 30, 2, 9, 1, 3])[0]) for i in range(count)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_meets_targets(docs, seed):
    rows = rows_for(seed)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = brute_targets(sizes)
    taken = {s: 0 for s in sizes}
    got = mixing.plan(docs(rows), slices=16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == int(want[s])
    assert abs(sum(want.values()) - sum(sizes.values())) < 1


def test_slices_do_not_matter_and_reruns_agree(docs):
    rows = rows_for(5)
    one, many, again = (sorted(map(tuple, mixing.plan(docs(rows), slices=n).collect()), key=str)
                        for n in (1, 4096, 4096))
    assert one == many == again


def test_mix_takes_what_the_plan_says(docs):
    rows = rows_for(7)
    df = docs(rows, extra=CLASHES)
    plan = {r.doc_id: r.taken for r in mixing.plan(df).collect()}
    mixed, texts = {}, {i: t for i, t, *_ in rows}
    out = mixing.mix(df)
    assert out.columns == df.columns
    for r in out.collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
        assert r.n_chars == len(r.text)
    assert mixed == {i: n for i, n in plan.items() if n}


def test_edges(docs):
    assert mixing.plan(docs([])).collect() == []
    assert mixing.mix(docs([])).collect() == []
    same = [(1, "a b c", "en", "s")] * 4 + [(None, None, None, None), (None, "", "en", None)]
    got = mixing.plan(docs(same)).collect()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == [
        (0, 0, 0), (0, 0, 0)] + [(1, 3, 3)] * 4
    assert mixing.mix(docs(same)).count() == 4
    repeats = [(1, "a b c d e f g", "en", "b")] * 3 + [(2, "x " * 50, "en", "a")]
    for r in mixing.plan(docs(repeats)).collect():
        assert r.taken <= 3 * r.size  # repeats at the cut share evenly


def test_first_words_keeps_blanks(docs, spark):
    from pyspark.sql import functions as F
    df = docs([(1, "  a\tb\n c"), (2, "a b")])
    got = {r.doc_id: r.t for r in df.select(
        "doc_id", mixing.first_words(F.col("text"), F.lit(2)).alias("t")).collect()}
    assert got == {1: "  a\tb\n ", 2: "a b"}
