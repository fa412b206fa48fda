import random
import zlib

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import CLASHES
from threadlake.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"
PLAIN = [f"word{i}" for i in range(300)]


def text(rng, size, *marked):
    found = [rng.choice(PLAIN) for _ in range(size)]
    at = rng.randrange(size)
    for step, word in enumerate(marked):
        found.insert(at + step, word)
    return " ".join(found)


def features(texts):
    return [toxicity.blocks(toxicity.words(t.encode()), toxicity.terms_of) for t in texts]


def scores(model, texts):
    known = model.lookup()
    return np.array([model.score(t.encode(), known) for t in texts])


def pairs(rng, count):
    """Insults and groups, toxic only side by side; alone, far apart or among their like they are clean."""
    rows = []
    insults, groups = ["vermin", "filth"], ["foreigners", "believers"]
    for i in range(count):
        insult, group, size = rng.choice(insults), rng.choice(groups), rng.randint(20, 200)
        near = [(insult, group), insults, groups, (insult,), (group,), ()][i % 7] if i % 7 < 6 else ()
        found = text(rng, size, *near)
        if i % 7 == 6:
            found = text(rng, 20, insult) + " " + text(rng, 120) + " " + text(rng, 20, group)
        rows.append((found, int(i % 7 == 0)))
    return rows


def test_pairs_are_learned_where_additive_weights_fail():
    rng = random.Random(3)
    train, held = pairs(rng, 2500), pairs(rng, 500)
    label = np.array([y for _, y in held])
    caught = {}
    for factors in (toxicity.FACTORS, 0):
        model = toxicity.train(features([t for t, _ in train]),
                               np.array([y for _, y in train], float), 1 / 7, factors)
        found = scores(model, [t for t, _ in held])
        caught[factors] = np.mean((found >= toxicity.TOXIC) == label)
    assert caught[toxicity.FACTORS] >= 0.95
    assert caught[0] < caught[toxicity.FACTORS] - 0.05


def plain_score(model, text_):
    """The machine written out pair by pair."""
    place = {t: i for i, t in enumerate(model.terms.tolist())}
    found = text_.lower().split()
    parts = [sorted({place[t] for w in found[i:i + toxicity.BLOCK]
                     for t in toxicity.terms_of(w.encode()) if t in place})
             for i in range(0, max(1, len(found)), toxicity.BLOCK)]
    values = []
    for i in range(len(parts)):
        terms = parts[i] + (parts[i + 1] if i + 1 < len(parts) else [])
        value = model.bias + sum(model.weights[t] for t in terms)
        value += sum(float(model.factors[a] @ model.factors[b])
                     for k, a in enumerate(terms) for b in terms[k + 1:])
        values.append(value)
    return 1 / (1 + np.exp(-max(values)))


def test_score_equals_the_sum_over_pairs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    terms = sorted({t for w in words[:30] for t in toxicity.terms_of(w.encode())})
    gen = np.random.default_rng(1)
    model = toxicity.Model(-0.5, np.array(terms), gen.normal(0, 1, len(terms)),
                           gen.normal(0, 0.5, (len(terms), 3)))
    for size in (0, 1, 15, 16, 17, 33, 200):
        for spread in (5, 40):
            t = " ".join(rng.choice(words[:spread]) if rng.random() < .3 else "unknown"
                         for _ in range(size))
            assert scores(model, [t])[0] == pytest.approx(plain_score(model, t), abs=1e-9)


def test_terms():
    assert toxicity.words("Ab-C ÄÖ1\tx".encode()) == [b"ab", b"c", "ÄÖ1".encode(), b"x"]
    assert toxicity.terms_of(b"abcd") == (xxhash.xxh64_intdigest(b"abcd", 13) % toxicity.BUCKETS,)
    assert len(toxicity.terms_of("äöüßx".encode())) == 2
    assert toxicity.terms_of("äöüßx".encode())[1] == toxicity.terms_of("äöüßyz".encode())[1]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture
def labelled(spark, docs):
    rng = random.Random(8)
    rows = [(i, text(rng, rng.randint(5, 300), *(["vermin", "filth"][i % 2:][:1] if i % 4 == 0 else [])))
            for i in range(1600)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(1500)], LABELS)
    return rows, labels


def test_held_out_accuracy_and_only_training_rows_count(spark, docs, labelled):
    rows, labels = labelled
    df = docs(rows)
    model = toxicity.fit(df, labels)
    out = toxicity.score(df, model, into="score").collect()
    right = [(r.score >= toxicity.TOXIC) == (r.doc_id % 4 == 0) for r in out
             if held(r.doc_id) or r.doc_id >= 1500]
    assert np.mean(right) >= 0.97
    # labels of held-out rows change nothing
    wrong = spark.createDataFrame([(i, 0, int(i % 4 == 0) ^ int(held(i))) for i in range(1500)],
                                  LABELS)
    again = toxicity.fit(df, wrong)
    assert np.array_equal(model.terms, again.terms) and np.array_equal(model.weights, again.weights)
    assert model.bias == again.bias


def test_edges(spark, docs, labelled):
    rows, labels = labelled
    hard = [(9000, None), (9001, ""), (9002, "... \n"), (None, "vermin"), (9003, "word1 " * 60_000 + "vermin"),
            (9004, "vermin"), (9004, "vermin")]
    df = docs(rows + hard, extra=CLASHES)
    more = labels.unionByName(spark.createDataFrame(
        [(None, 0, 1), (9001, 0, None), (4, 0, 0), (4, 0, 1), (9999, 0, 1)], LABELS))
    model = toxicity.fit(df, more)
    out = toxicity.score(df, model, into="score")
    assert out.columns == [*df.columns, "score"]
    got = out.where("doc_id >= 9000 OR doc_id IS NULL").select("doc_id", "score").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(got) == len(hard)
    assert by[9000] == by[9001] == by[9002] and by[9000][0] < 0.5
    assert min(by[None][0], by[9003][0], *by[9004]) >= toxicity.TOXIC
    assert len(by[9004]) == 2 and by[9004][0] == by[9004][1]


def test_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], LABELS)
    df = docs([(1, "a b"), (2, None)])
    assert [r.toxicity for r in toxicity.score(df, toxicity.fit(df, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(i, 0, 0) for i in range(5)], LABELS)
    assert all(r.toxicity < 0.01 for r in toxicity.score(df, toxicity.fit(df, one)).collect())
    # labels that no term tells apart
    alike = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 0, 1), (5, 0, 0)], LABELS)
    model = toxicity.fit(docs([(i, "the same text") for i in range(9)]), alike)
    assert len(model.terms) == 0
    assert {r.toxicity for r in toxicity.score(df, model).collect()} == {
        1 / (1 + np.exp(-model.bias))}
    empty = docs([])
    assert toxicity.score(empty, toxicity.fit(empty, one)).collect() == []
