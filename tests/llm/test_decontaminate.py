import random

import numpy as np
import pytest

from tests.llm.conftest import CLASHES
from threadlake.llm import decontaminate as d


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))


@pytest.fixture(scope="module")
def world():
    rng = random.Random(1)
    common = [word(rng) for _ in range(40)]
    prose = lambda n: [rng.choice(common) if rng.random() < .5 else word(rng)
                       for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(14, 60))).capitalize() + ".") for i in range(60)]
    return rng, prose, items


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return row[-1]


def test_common_subsequence_equals_the_table(world):
    rng = world[0]
    for _ in range(200):
        a = [rng.choice("abcde") for _ in range(rng.randint(1, 70))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert d.common_subsequence(d.places_of(a), len(a), b) == lcs(a, b)


def found(spark, docs, rows, items, **more):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.share
            for r in d.matches(docs(rows), bench, **more).collect()}


def test_copies_and_paraphrases_are_found_and_clean_texts_are_not(spark, docs, world):
    rng, prose, items = world
    rows, want = [], set()
    for i, text in items:
        before, after = " ".join(prose(rng.randint(0, 200))), " ".join(prose(rng.randint(0, 200)))
        words = text.rstrip(".").split()
        swapped = " ".join(w if rng.random() > .15 else word(rng) for w in words)
        loud = text.upper().replace(" ", "!! ")
        for kind, inside in enumerate((text, swapped, loud)):
            rows.append((3 * i + kind, f"{before} {inside} {after}"))
            want.add((3 * i + kind, i))
    rows += [(1000 + i, " ".join(prose(rng.randint(1, 900)))) for i in range(150)]
    got = found(spark, docs, rows, items)
    missed = want - set(got)
    assert {p for p in missed if p[0] % 3 != 1} == set()  # copies: all
    assert len(missed) <= 0.1 * len(items)  # paraphrases: recall of 0.9
    assert set(got) - want == set()
    # blocks change neither copies nor clean texts
    blocks = found(spark, docs, rows, items, block=7)
    assert {p for p in want - set(blocks) if p[0] % 3 != 1} == set()
    assert set(blocks) - want == set()


def test_long_texts_with_more_passages_than_the_rank(spark, docs, world):
    rng, prose, _ = world
    items = [(i, " ".join(prose(rng.randint(150, 500)))) for i in range(12)]
    items.append((12, " ".join(prose(1200))))  # alone more passages than the rank
    rows = [(i, f"{' '.join(prose(30))} {text} {' '.join(prose(30))}") for i, text in items]
    rows += [(100 + i, " ".join(prose(300))) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = d.matches(docs(rows), bench, rank=24).collect()
    assert sorted((r.doc_id, r.item_id, r.share) for r in got) == [(i, i, 1.0) for i, _ in items]
    known = [(i, d.words(t), []) for i, t in items]
    for part in d.index_blocks(known, 256, 24):
        assert sum(len(starts) for _, starts in part) <= 24 * d.SPREAD


@pytest.mark.parametrize("total", [10_000, 1_000_000, 20_000_000])
def test_short_copies_among_rare_words_in_a_large_corpus(spark, world, total):
    rng = random.Random(9)
    common = sorted({word(rng) for _ in range(120)})
    known = [(i, [rng.choice(common) for _ in range(size)], []) for i, size in
             enumerate([1, 2, 3, 4, 5, 8, 10, 12, 15, 19, 20, 25, 29])]
    # the share of documents that hold a word stays as the corpus grows
    seen = {b"": total} | {w.encode(): int(total * rng.uniform(0.005, 0.2)) for w in common}
    known = [(i, [w.encode() for w in ws], a) for i, ws, a in known]
    index = d.build_index(spark, known, seen)
    for i, ws, _ in known:
        for before in range(0, 45, 4):
            rare = [f"rare{n}".encode() for n in range(100)]
            assert i in {m[1] for m in index.matches(rare[:before] + ws + rare[before:])}


def test_partial_copy_needs_the_answer(spark, docs, world):
    rng, prose, _ = world
    question, answer = prose(20), prose(6)
    item = [(1, " ".join(question) + "? " + " ".join(answer) + ".")]
    half = " ".join(question[:10])
    rows = [(1, f"{half} {' '.join(answer)}"), (2, f"{half} {' '.join(prose(6))}"),
            (3, " ".join(answer))] + [(10 + i, " ".join(prose(50))) for i in range(30)]
    assert set(found(spark, docs, rows, item)) == {(1, 1)}


@pytest.mark.parametrize("rank", [d.RANK, 64])
def test_candidates_reach_nine_tenths_of_brute_force(spark, world, rank):
    """Windows that hold most of a text: how many of them the cosine search proposes."""
    rng, prose, items = world
    known = [(i, d.words(t), d.answer_of(t)) for i, t in items]
    texts = [d.words(" ".join(prose(100) + t.split() + prose(100))) for _, t in items]
    seen = {b"": len(texts)}
    for found_words in texts:
        for w in set(found_words):
            seen[w] = seen.get(w, 0) + 1
    index, hits, close = d.build_index(spark, known, seen, rank), 0, 0
    assert index.factor.shape[1] == min(rank, index.passages.shape[1])
    for found_words in texts:
        ids = np.array([index.vocabulary.get(w, len(index.factor)) for w in found_words])
        windows, passages = index._near(ids)
        proposed = set(zip(windows.tolist(), index.owner[passages].tolist()))
        for window in range(len(range(0, len(ids), d.STRIDE)) - 1):
            part = found_words[window * d.STRIDE:window * d.STRIDE + d.WINDOW]
            for item, (_, size, places, _, _) in enumerate(index.items):
                if d.common_subsequence(places, size, part) >= 0.6 * size:
                    close += 1
                    hits += (window, item) in proposed
    assert close >= len(items) and hits >= 0.9 * close


def test_randomised_svd_matches_the_exact_factor(spark):
    rng = np.random.default_rng(5)
    left, right = rng.standard_normal((40, 6)), rng.standard_normal((6, 90))
    a = left @ right + 0.01 * rng.standard_normal((40, 90))
    rows = spark.createDataFrame([(list(range(90)), r.tolist()) for r in a],
                                 "ids array<int>, weights array<double>").repartition(3)
    v = d.randomised_svd(rows, 90, 6)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-4)
    exact = np.linalg.svd(a)[2][:6].T
    assert np.linalg.norm(exact @ exact.T - v @ v.T) < 0.05


def test_edges(spark, docs, world):
    _, prose, items = world
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma"), (4, "!!")],
                                  "item_id bigint, text string")
    rows = [(1, None), (2, ""), (None, "x alpha beta gamma y"), (3, "alpha x beta gamma"),
            (4, "word " * 100_000), (None, "x alpha beta gamma y")]
    df = docs(rows, extra=CLASHES)
    assert [(r.doc_id, r.item_id, r.share) for r in d.matches(df, bench).collect()] == [
        (None, None, 1.0)] * 2
    kept = d.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect())) == [1, 2, 3, 4]
    none = bench.limit(0)
    assert d.matches(df, none).collect() == [] and d.keep_clean(df, none).count() == 6
    assert d.matches(docs([]), bench).collect() == []


def brute_matches(rows, items):
    """Every neighbourhood of every document against every item, without any candidate search."""
    out = {}
    for doc, text in rows:
        found = d.words(text)
        for item, wanted_text in items:
            wanted, answer = d.words(wanted_text), d.answer_of(wanted_text)
            reach = max(d.STRIDE, len(wanted))
            best = 0.0
            for start in range(0, max(1, len(found) - d.STRIDE), d.STRIDE):
                near = found[max(0, start - reach):start + d.WINDOW + reach]
                share = lcs(wanted, near) / len(wanted)
                if share >= d.COPIED or share >= d.PARAPHRASED and answer and d.has_run(answer, near):
                    best = max(best, share)
            if best:
                out[doc, item] = round(best, 4)
    return out


def reworded(rng, word_, words):
    """Words replaced, dropped, put in or swapped with the next."""
    out = list(words)
    for i in range(len(out)):
        change = rng.random()
        if change < .05:
            out[i] = word_(rng)
        elif change < .08:
            out[i] = ""
        elif change < .11:
            out[i] += " " + word_(rng)
        elif change < .15 and i + 1 < len(out):
            out[i], out[i + 1] = out[i + 1], out[i]
    return " ".join(out)


@pytest.mark.parametrize("rank", [d.RANK, 64])
def test_matches_as_a_whole_against_brute_force(spark, docs, world, rank):
    """Copies, reworded copies, halves with the answer and clean texts, items of 14 to 500 words."""
    rng, prose, _ = world
    items = [(i, " ".join(prose(size)) + ". " + " ".join(prose(6)) + ".") for i, size in
             enumerate([14, 16, 20, 25, 30, 34, 40, 50, 60, 80, 100, 130, 200, 300, 490])]
    rows = []
    for i, text in items:
        words = text.replace(".", "").split()
        half = " ".join(words[:len(words) * 3 // 5] + text.split(". ")[-1].replace(".", "").split())
        for kind, inside in enumerate((text, reworded(rng, word, words), half,
                                       " ".join(words[:len(words) // 3]))):
            rows.append((10 * i + kind, f"{' '.join(prose(rng.randint(0, 90)))} {inside} "
                                        f"{' '.join(prose(rng.randint(0, 90)))}"))
    rows += [(1000 + i, " ".join(prose(rng.randint(5, 300)))) for i in range(30)]
    got, want = found(spark, docs, rows, items, rank=rank), brute_matches(rows, items)
    assert set(got) <= set(want)  # nothing that the checks would not confirm
    assert {k for k in want if k[0] % 10 == 0} <= set(got)  # copies: all
    assert len(got) >= 0.9 * len(want) and len(want) >= 2.5 * len(items)
    for key, share in got.items():
        assert share <= want[key] + 1e-4


def test_texts_searched_together_give_what_each_gives(spark, monkeypatch):
    """One product serves the windows of many texts; they were searched one by one, at twice the CPU time."""
    rng = random.Random(21)

    def prose(n):
        return " ".join(word(rng) for _ in range(n))

    items = [prose(n) for n in (6, 14, 40, 90)]
    known = [(i, d.words(t), d.answer_of(t)) for i, t in enumerate(items)]
    seen = {b"": 1000} | {w: 3 for _, ws, _ in known for w in ws}
    index = d.build_index(spark, known, seen, rank=8)
    texts = [None, "", "one"] + [
        " ".join([prose(rng.randrange(1, 70)), rng.choice(items + [""]), prose(rng.randrange(1, 130))])
        for _ in range(60)]
    calls, near = [], d.Index._near
    monkeypatch.setattr(d.Index, "_near", lambda *a: calls.append(1) or near(*a))
    together = list(d.search_all([index], texts))
    assert len(calls) <= 4 and sum(map(len, together)) > 30
    assert together == [d.search([index], t) for t in texts]
    monkeypatch.setattr(d, "_SLAB", 3)
    assert together == list(d.search_all([index], texts))
