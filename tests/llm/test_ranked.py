import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES
from threadlake.llm import ranked

ITEMS = "item_id bigint, text string"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(rows, items, top=10):
    """Every item against every document."""
    docs = [(i, row[0], terms(row[1])) for i, row in enumerate(rows)]
    docs = [(i, id_, ws, Counter(ws)) for i, id_, ws in docs if ws]
    n_all, l_all = len(docs), sum(len(ws) for _, _, ws, _ in docs)
    held = Counter(w for _, _, _, c in docs for w in c)
    out = []
    for item, text in items:
        found = []
        for i, id_, ws, tf in docs:
            m = 10 + 90 * len(ws) * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * held[w] + 1)))
                        * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m))
                        for w in set(terms(text)) if w in tf)
            if score > 0:
                found.append((-score, id_ is None, id_ or 0, i, id_))
        out += [(item, rank, id_, -s) for rank, (s, _, _, _, id_) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def run(docs, spark, rows, items, extra=None, **how):
    df = docs(rows, extra)
    texts = spark.createDataFrame(items, ITEMS)
    if extra:
        texts = texts.withColumns({n: F.lit(1) for n in ("item", "no", "terms", "rank")})
    out = ranked.search(df, texts, **how)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=str)


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    pick = lambda: vocabulary[min(399, int(rng.paretovariate(0.6)) - 1)]
    rows = [(i, " ".join(pick() for _ in range(rng.choice([1, 3, 20, 60, 200])))) for i in range(size)]
    items = [(i, " ".join(pick() for _ in range(rng.choice([1, 2, 8, 40])))) for i in range(25)]
    return rows, items


@pytest.mark.parametrize("how", [{}, {"stages": 1}, {"stages": 7, "slice_rows": 9, "bundle_items": 4},
                                 {"pass_terms": 60, "slice_rows": 50}, {"top": 3, "slice_rows": 400}])
def test_equals_every_item_against_every_document(spark, docs, how):
    rows, items = corpus(1, 500)
    assert run(docs, spark, rows, items, **how) == plain(rows, items, how.get("top", 10))


def test_separators_cases_and_letters(spark, docs):
    rows = [(1, "ÄB äB a_b-c\x00d\x7fe  É"), (2, "äb Ä"), (3, "ab"), (4, "e\tE")]
    items = [(1, "äB"), (2, "ÄB"), (3, "A"), (4, "e E e"), (5, "é"), (6, "É d")]
    assert run(docs, spark, rows, items) == plain(rows, items)


def test_edges(spark, docs):
    many = [(100 + i, "copy of one text") for i in range(40)]
    rows = [(1, None), (2, ""), (3, " ,. "), (None, "copy of one text"), (None, "other words"),
            (5, "other words"), (5, "other words"), (6, "long " * 50_000 + "words"), *many]
    items = [(1, None), (2, ""), (3, "nothing here"), (None, "other words"), (4, "copy copy text"),
             (4, "copy copy text"), (7, "long " * 20_000)]
    got = run(docs, spark, rows, items, extra=CLASHES, slice_rows=7, stages=3)
    assert got == plain(rows, items)
    assert [g[2] for g in got if g[0] is None] == [5, 5, None, 6]
    assert run(docs, spark, rows, []) == []
    assert run(docs, spark, [], items) == []
    assert run(docs, spark, [(1, None)], items) == []


def test_accumulators_of_hopeless_documents_are_dropped():
    """The bound that keeps accumulators sparse never drops a tie."""
    import numpy as np
    assert ranked._tenth(np.array([[5, 1, 9, 9]]), 2).tolist() == [9]
    assert ranked._tenth(np.array([[5, 1]]), 3).tolist() == [0]
