import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import pairs
from threadlake.functions.embedding import embed
from threadlake.operators import cache, evaluation, fusion
from threadlake.operators.chunking import chunk_documents
from threadlake.operators.dedup import near_dup_collapse
from threadlake.operators.knn import best_rows, vector_knn
from threadlake.operators import lsh
from threadlake.operators.lexical import lexical_leg
from threadlake.operators.scope import permission_scope, source_sender
from threadlake.plans import search

AT = dt.datetime(2025, 1, 1)


def cut(text, pages):
    """The chunking rule, one paragraph after the other."""
    clean = text.replace("\r\n", "\n").strip()
    paragraphs, where, at = [], [], 0
    for piece in clean.split("\n\n"):
        stripped = piece.lstrip("\n")
        at += len(piece) - len(stripped)
        if stripped:
            paragraphs.append(stripped)
            where.append(at)
        at += len(stripped) + 2
    out, buffer, begin = [], "", 0
    for text_, start in zip(paragraphs, where):
        if len(text_) > 2000:
            out.append((buffer, begin))
            i = 0
            while True:
                out.append((text_[i:i + 2000], start + i))
                if i + 2000 >= len(text_):
                    break
                i += 1700
            buffer, begin = "", start + len(text_)
        elif len(buffer) + len(text_) + 2 > 2000:
            out.append((buffer, begin))
            buffer, begin = buffer[-300:] + "\n\n" + text_, max(0, start - 300)
        else:
            begin = begin if buffer else start
            buffer = f"{buffer}\n\n{text_}" if buffer else text_
    out.append((buffer, begin))
    return [(t.strip(), max(1, sum(p <= s for p in pages))) for t, s in out if t.strip()]


def test_chunking(spark):
    def para(n, seed):
        rng = random.Random(seed)
        return "".join(rng.choice("abcdé ") for _ in range(n - 2)).join("xy")

    texts = ["", "  \n ", para(2000, 1), para(2001, 2), para(3700, 3), para(3701, 4),
             para(1200, 5) + "\n\n" + para(1200, 6),
             para(100, 7) + "\n\n" + para(2500, 8) + "\n\n\n" + para(100, 9),
             para(50, 10) + "\r\n\r\n" + para(60, 11) + "\n" + para(9, 12),
             "\n\n".join(para(700, i) for i in range(12)),
             para(2000, 30) + "\n\n" + para(1999, 31),
             "\n\n".join(para(random.Random(i).choice([40, 900, 1998, 4000]), i)
                         for i in range(40, 60))]
    pages = [[], [0, 3000], [500, 900]]
    rows = [(i * 3 + j, t, p) for i, t in enumerate(texts) for j, p in enumerate(pages)]
    got = chunk_documents(spark.createDataFrame(
        rows, "doc_id int, text string, page_offsets array<int>"))
    want = [(d, i, t, p) for d, text, po in rows for i, (t, p) in enumerate(cut(text, po))]
    assert pairs(got, "doc_id", "chunk_index", "text", "page") == want


def vectors(n, dims, seed, centres=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    if centres is not None:
        v = centres[rng.integers(0, len(centres), n)] + v * .15
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("block,per_pivot", [(4096, 16_384), (8, 40)])
def test_knn_is_exact(spark, block, per_pivot):
    centres = vectors(6, 12, 0)
    points, asked = vectors(400, 12, 1, centres), vectors(25, 12, 2, centres)
    points[7] = points[3]
    rooms = [0 if random.Random(i).random() < .7 else i % 4 for i in range(400)]
    scope = [(q, r) for q in range(25) for r in range(4) if (q + r) % 3]
    p = spark.createDataFrame([(i, rooms[i], v.tolist()) for i, v in enumerate(points)],
                              "point_id int, room_id int, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)],
                              "query_id int, vector array<double>")
    s = spark.createDataFrame(scope, "query_id int, room_id int")
    got = vector_knn(q, p, s, 5, block, per_pivot)
    scores, want = np.round(asked @ points.T, 6), []
    for query in range(25):
        held = sorted((-scores[query, i], i) for i in range(400) if (query, rooms[i]) in scope)
        want += [(query, i, r + 1) for r, (_, i) in enumerate(held[:5])]
    assert pairs(got, "query_id", "point_id", "rank") == sorted(want)


@pytest.mark.parametrize("block,per_pivot", [(4096, 16_384), (8, 40)])
def test_knn_is_cosine_whatever_the_lengths(spark, block, per_pivot):
    rng = np.random.default_rng(4)
    points, asked = vectors(300, 8, 5), vectors(20, 8, 6)
    p = spark.createDataFrame(
        [(i, 1, (v * s).tolist()) for (i, v), s in zip(enumerate(points), rng.uniform(.1, 9, 300))],
        "point_id int, room_id int, vector array<double>")
    q = spark.createDataFrame([(i, (v * 3).tolist()) for i, v in enumerate(asked)],
                              "query_id int, vector array<double>")
    s = spark.createDataFrame([(i, 1) for i in range(20)], "query_id int, room_id int")
    scores = np.round(asked @ points.T, 6)
    want = [(i, j, r + 1) for i in range(20)
            for r, j in enumerate(sorted(range(300), key=lambda j: (-scores[i, j], j))[:5])]
    assert pairs(vector_knn(q, p, s, 5, block, per_pivot), "query_id", "point_id",
                 "rank") == sorted(want)


def test_knn_without_rooms_or_points(spark):
    p = spark.createDataFrame([(1, 1, [1.0, 0.0])], "point_id int, room_id int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    none = spark.createDataFrame([], "query_id int, room_id int")
    assert vector_knn(q, p, none).count() == 0
    assert vector_knn(q, p.limit(0), none).count() == 0


def test_hyperplane_search_finds_near_points_and_looks_at_few(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 24))
    points = [(i, i % 2, (centres[i % 40] + .15 * rng.standard_normal(24)).tolist()) for i in range(1600)]
    p = spark.createDataFrame(points, "point_id int, room_id int, vector array<double>")
    asked = [(j, (centres[j] + .15 * rng.standard_normal(24)).tolist()) for j in range(40)]
    q = spark.createDataFrame(asked, "query_id int, vector array<double>")
    scope = spark.createDataFrame([(j, r) for j in range(40) for r in range(1 + j % 2)],
                                  "query_id int, room_id int")
    exact = vector_knn(q, p, scope, 10)
    for block in (4096, 7):
        found = lsh.lsh_knn(q, p, scope, 10, tables=6, bits=8, probe_bits=3, block_points=block)
        total = lsh.recall(exact, found).first()
        assert total.questions == 40 and total.found_hits >= 0.95 * total.exact_hits
        scores = {(r.query_id, r.point_id): r.score for r in exact.collect()}
        rows = found.collect()
        assert all(scores.get((r.query_id, r.point_id), r.score) == r.score for r in rows)
        assert len({(r.query_id, r.point_id) for r in rows}) == len(rows) <= 400
    # what the tables propose: a small part of the rooms
    products = lsh._products(pd.Series([v for _, v in asked]), 6, 8)
    held = lsh.signatures(lsh._products(pd.Series([v for _, _, v in points]), 6, 8))
    looked = [set(x.tolist()) for x in lsh.probes(products, 3)]
    share = np.mean([np.mean([bool(cells & set(row)) for row in held.tolist()]) for cells in looked])
    assert share < 0.25
    assert all(set(own) <= cells for own, cells in zip(lsh.signatures(products).tolist(), looked))


def test_best_rows_keeps_column_order_on_ties():
    assert [list(r) for r in best_rows(np.array([[1., 3., 3., 2., 3.]]), 2)] == [[1, 2]]
    assert [list(r) for r in best_rows(np.array([[1., 3.]]), 5)] == [[1, 0]]


WORDS = ["the"] * 12 + ["cat", "dog", "report", "budget", "friday", "launch", "x1", "q3"]


@pytest.mark.parametrize("direct", [10**9, 0])
def test_lexical_is_exact(spark, direct):
    rng = random.Random(8)
    docs = [(i, i % 3, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))))
            for i in range(150)]
    asks = [(j, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6))))
            for j in range(30)] + [(90, "the the"), (91, "nowhere"), (92, "the cat")]
    scope = [(j, r) for j, _ in asks for r in range(3) if (j + r) % 4]
    got = lexical_leg(spark.createDataFrame(asks, "query_id int, question string"),
                      spark.createDataFrame(docs, "doc_id int, room_id int, text string"),
                      spark.createDataFrame(scope, "query_id int, room_id int"), 7, direct)

    def toks(t):
        return [w for w in t.split() if len(w) > 1]

    tf = {d: Counter(toks(t)) for d, _, t in docs}
    size = {d: len(toks(t)) for d, _, t in docs}
    mean, df = sum(size.values()) / len(docs), Counter(w for c in tf.values() for w in c)
    want = []
    for j, question in asks:
        scored = []
        for d, room, _ in docs:
            hit = set(toks(question)) & set(tf[d])
            if hit and (j, room) in scope:
                scored.append((-round(sum(
                    math.log(1 + (150 - df[w] + .5) / (df[w] + .5)) * tf[d][w] * 2.2
                    / (tf[d][w] + 1.2 * (.25 + .75 * size[d] / mean)) for w in hit), 6), d))
        want += [(j, d, s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:7])]
    got = [(r.query_id, r.doc_id, r["rank"]) for r in got.collect()]
    assert sorted(got) == sorted((j, d, r) for j, d, _, r in want)


def test_fusion_order_and_collapse(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)],
                              "query_id int, key string, rank int")
    x = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "d", 3), (1, "e", 4)],
                              "query_id int, key string, rank int")
    fused = fusion.rrf_fusion(v, x)
    # a and b tie on the score and so do c and d: the vector leg's order decides
    assert [r.key for r in fused.orderBy("fused_rank").collect()] == ["a", "b", "c", "d", "e"]
    first = fused.where("key = 'a'").first()
    assert math.isclose(first.score, 1 / 61 + 1 / 62)
    text = spark.createDataFrame([("a", "@recall hi"), ("b", "Same  text"), ("c", "same\ntext "),
                                  ("d", "other"), ("e", "last")], "key string, text string")
    kept = near_dup_collapse(fused.join(text, "key"), 2)
    assert pairs(kept, "final_rank", "key") == [(1, "b"), (2, "d")]


def test_rerank(spark):
    def pool(n):
        texts = ["nothing here", "redis connection pooling", "redis redis"] + ["zz"] * (n - 3)
        return spark.createDataFrame(
            [(1, "Redis connection pooling", i + 1, t) for i, t in enumerate(texts)],
            "query_id int, question string, final_rank int, text string")

    order = pairs(fusion.rerank_overlap(pool(8), 2), "rerank", "final_rank")
    assert order == [(1, 2), (2, 3)]
    assert pairs(fusion.rerank_overlap(pool(5)), "rerank", "final_rank") == [
        (i, i) for i in range(1, 6)]


def test_packing_skips_and_continues(spark):
    rows = [(1, 1, "x" * 40), (1, 2, "x" * 400), (1, 3, "x" * 41), (1, 4, "x")]
    df = spark.createDataFrame(rows, "query_id int, final_rank int, text string")
    packed = fusion.pack_to_budget(df, ["query_id"], "final_rank", budget=112)
    assert pairs(packed, "source_index", "final_rank") == [(1, 1), (2, 3), (3, 4)]


def packed_sources(spark):
    return spark.createDataFrame(
        [(1, "q?", 1, "message", 5, "message:9", "t" * 200, "Ann", AT, None, None),
         (1, "q?", 2, "doc", 5, "doc:3:0", "body", None, None, "plan.pdf", 4)],
        "query_id int, question string, source_index int, kind string, room_id int, key string, "
        "text string, sender_name string, created_at timestamp, filename string, page int")


def test_context_and_citations(spark):
    packed = packed_sources(spark)
    context = fusion.build_context(packed).first()["context"]
    assert context == ("<sources>\n[1] BEGIN SOURCE (message | Ann | 2025-01-01 00:00)\n"
                       + "t" * 200 + "\nEND SOURCE\n[2] BEGIN SOURCE (document \"plan.pdf\" | "
                       "page 4)\nbody\nEND SOURCE\n</sources>\n\nQuestion: q?")
    answers = spark.createDataFrame([(1, "yes [2][1] [3] [2]"), (2, "[1]")],
                                    "query_id int, answer string")
    got = fusion.map_citations(answers, packed)
    assert pairs(got, "index", "key", "sender_name") == [(1, "message:9", "Ann"),
                                                         (2, "doc:3:0", "plan.pdf")]
    assert len(got.where("index = 1").first()["snippet"]) == 180
    assert [tuple(r) for r in got.orderBy("index").select(
        "message_id", "doc_id", "chunk_index", "page").collect()] == [
        (9, None, None, None), (None, 3, 0, 4)]


def test_decisions_with_the_real_word_list(spark):
    rows = [(1, 0, 7, "user", "Decision: we are going with plan B\nfor now", AT),
            (2, 0, 7, "user", "undecided about lunch", AT), (3, 0, 8, "ai", "we decided", AT),
            (4, 0, 8, None, "All LOCKED.", AT), (5, 0, 8, "user", "@recall what was agreed", AT)]
    df = spark.createDataFrame(rows, "message_id long, room_id long, sender_id long, "
                                     "kind string, body string, created_at timestamp")
    users = spark.createDataFrame([(7, "ann", "Ann")],
                                  "user_id long, username string, display_name string")
    found = fusion.extract_decisions(df, users)
    assert pairs(found, "position", "decided_by") == [(1, "Ann"), (2, "Deleted user")]
    assert pairs(found, "position", "decision", "source_ids") == [
        (1, "Decision: we are going with plan B for now", [1]), (2, "All LOCKED.", [4])]
    claimed = found.withColumn("source_ids", F.concat(F.array(F.lit(77).cast("long")),
                                                      F.col("source_ids")))
    shown = df.where("message_id <> 4")
    assert pairs(fusion.citation_id_guard(claimed, shown), "position", "source_ids") == [(1, [1])]


def test_cache_lookup_trim_and_expiry(spark):
    def entry(i, fp, minutes, vec):
        return (i, fp, AT + dt.timedelta(minutes=minutes), vec)

    rows = [entry(i, "a", i, [1.0, 0.0]) for i in range(25)] + [entry(99, "b", 0, [0.0, 1.0])]
    entries = spark.createDataFrame(rows, "entry_id long, fingerprint string, "
                                          "stored_at timestamp, vector array<double>")
    assert {r.entry_id for r in cache.cache_trim(entries).where("fingerprint = 'a'")
            .collect()} == set(range(5, 25))
    asks = spark.createDataFrame([(1, "a", [0.96, 0.28]), (2, "a", [0.6, 0.8]),
                                  (3, "c", [1.0, 0.0])],
                                 "query_id long, fingerprint string, vector array<double>")
    got = cache.semantic_cache_lookup(asks, entries)
    assert [(r.query_id, r.entry_id) for r in got.orderBy("query_id").collect()] == [
        (1, 24), (2, None), (3, None)]
    gap = spark.createDataFrame([entry(1, "a", 0, [1.0]), entry(2, "a", 1440, [1.0]),
                                 entry(3, "a", 1500, [1.0])], entries.schema)
    live = cache.live_entries(gap, AT + dt.timedelta(minutes=2000))
    assert pairs(live, "entry_id") == [(2,), (3,)]
    assert cache.live_entries(gap, AT + dt.timedelta(minutes=1500 + 1440)).count() == 0


def test_fingerprint_changes_with_membership(spark):
    rooms = spark.createDataFrame([(1, True), (2, True)], "room_id long, ai_enabled boolean")
    asks = spark.createDataFrame([(0, 7)], "query_id long, user_id long")
    both = spark.createDataFrame([(7, 1), (7, 2)], "user_id long, room_id long")
    prints = [cache.scope_fingerprints(permission_scope(asks, m, rooms)).first()["fingerprint"]
              for m in (both, both.where("room_id = 1"))]
    assert prints[0] != prints[1]


# A small golden set: rooms, messages, one document, questions with anchors.
TALK = [(1, 1, 10, "user", "The spring fair moves from Monday to Wednesday", AT),
        (2, 1, 11, "user", "Volunteers wear green badges this year", AT),
        (3, 2, 10, "user", "The boiler was out for forty minutes", AT),
        (4, 2, 12, "user", "Spare keys hang behind the green door", AT),
        (5, 2, 12, "ai", "The boiler was out, says the log", AT)]
DOC = (70, 1, "fair.md", "Opening hours are nine to five.\n\nTickets cost four coins.", [0])
ASKED = [(0, "When does the spring fair move?", 1, "moves from Monday", None),
         (1, "How long was the boiler out?", 2, "out for forty", None),
         (2, "What do tickets cost?", 1, "Tickets cost four", "doc"),
         (3, "Where are the spare keys?", 2, "behind the green door", None)]


def golden(spark):
    messages = spark.createDataFrame(TALK, "message_id long, room_id long, sender_id long, "
                                           "kind string, body string, created_at timestamp")
    chunks = chunk_documents(spark.createDataFrame(
        [DOC], "doc_id long, room_id long, filename string, text string, "
               "page_offsets array<int>"))
    rooms = spark.createDataFrame([(1, True), (2, None)], "room_id long, ai_enabled boolean")
    questions = spark.createDataFrame([(q, t, 1) for q, t, *_ in ASKED],
                                      "query_id long, question string, user_id long")
    anchors = spark.createDataFrame([(q, 0, r, c, k) for q, _, r, c, k in ASKED],
                                    "query_id long, anchor_id int, room_id long, "
                                    "contains string, kind string")
    members = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, room_id long")
    return messages, chunks, rooms, questions, anchors, members


def test_golden_set_end_to_end(spark):
    messages, chunks, rooms, questions, anchors, members = golden(spark)
    expected = evaluation.resolve_anchors(anchors, messages, chunks)
    assert pairs(expected, "query_id", "key") == [
        (0, "message:1"), (1, "message:3"), (2, "doc:70:0"), (3, "message:4")]
    points = search.message_points(messages, rooms, 256).unionByName(
        search.chunk_points(chunks, rooms, 256))
    scope = permission_scope(questions, members, rooms)
    asked = questions.select("query_id", "question")
    # 256 dimensions on both sides
    leg = vector_knn(asked.select("query_id", embed(F.col("question"), 256).alias("vector")),
                     points.withColumnRenamed("key", "point_id"), scope).withColumnRenamed(
        "point_id", "key")
    words = search.message_lexical_leg(asked, messages, rooms, scope)
    ranked = fusion.rrf_fusion(leg, words).withColumnRenamed("fused_rank", "rank")
    per = evaluation.retrieval_eval(questions, expected, ranked)
    row = evaluation.eval_summary(per).first()
    assert (row.questions, row.recall_at_5) == (4, 1.0) and row.mrr > 0.8
    assert evaluation.misses(expected, ranked).count() == 0


def test_messages_without_vectors_and_documents_are_found(spark):
    messages, chunks, rooms, questions, _, members = golden(spark)
    points = search.message_points(messages.where("message_id <> 3"), rooms).unionByName(
        search.chunk_points(chunks, rooms))
    scope = permission_scope(questions, members, rooms)
    found = search.hybrid_retrieve(questions, points, messages, rooms, scope)
    users = spark.createDataFrame([(10, "Ann", "Ann")],
                                  "user_id long, username string, display_name string")
    senders = {r.key: r.sender for r in source_sender(found, users).collect()}
    assert senders["message:3"] == "Ann" and senders["message:4"] == "Deleted user"
    assert senders["doc:70:0"] == "fair.md"


def test_left_rooms_stay_hidden(spark):
    messages, chunks, rooms, questions, _, members = golden(spark)
    points = search.message_points(messages, rooms)
    for still, hit in ((members, True), (members.where("room_id = 1"), False)):
        scope = permission_scope(questions, still, rooms)
        found = search.hybrid_retrieve(questions.where("query_id = 1"), points, messages, rooms,
                                       scope)
        assert ("message:3" in {r.key for r in found.collect()}) is hit


def test_eval_measures(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id long, key string")
    ranked = spark.createDataFrame([(1, "b", 2), (1, "a", 7), (2, "y", 1)],
                                   "query_id long, key string, rank int")
    per = evaluation.retrieval_eval(q, expected, ranked)
    assert pairs(per, "query_id", "recall_at_5", "reciprocal_rank") == [
        (1, 0.5, 0.5), (2, 0.0, 0.0), (3, 0.0, 0.0)]
    assert pairs(evaluation.misses(expected, ranked), "query_id", "key") == [(1, "a"), (2, "z")]


def test_knn_by_cells_writes_no_tables_and_keeps_ties(spark):
    import os
    from threadlake.session import scratch_dir
    rows = [(i, i % 2, [1.0, float(i % 3), float(i % 7 == 0)]) for i in range(300)]  # large groups of copies
    p = spark.createDataFrame(rows, "point_id long, room_id int, vector array<float>")
    q = spark.createDataFrame([(i, v) for i, _, v in rows[:30]], "query_id long, vector array<float>")
    s = spark.createDataFrame([(i, r) for i in range(30) for r in range(2)], "query_id long, room_id int")
    path = scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    got = pairs(vector_knn(q, p, s, 6, 8, 40), "query_id", "rank", "point_id")
    assert not {n for n in os.listdir(path) if n not in before} if os.path.isdir(path) else True
    units = np.array([v for _, _, v in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    scores = np.round(units[:30] @ units.T, 6)
    assert got == [(i, n + 1, j) for i in range(30) for n, j in enumerate(
        sorted(range(300), key=lambda j: (-scores[i, j], j))[:6])]


def test_copies_of_anchors_and_texts_are_searched_once(spark, monkeypatch):
    """30 copies of a message were 900 pairs."""
    rows = [(100 * c + i, c % 2, f"copied text number {i} of a room") for c in range(1, 31) for i in range(3)]
    messages = spark.createDataFrame(rows, "message_id long, room_id long, body string")
    anchors = messages.select(F.col("message_id").alias("query_id"), F.lit("a").alias("anchor_id"), "room_id",
                              F.substring("body", 3, 18).alias("contains"), F.lit("message").alias("kind"))
    chunks = spark.createDataFrame([], "doc_id long, chunk_index int, room_id long, text string")
    real, pairs_seen = evaluation.text_contains, []

    def counted(*args, **named):
        found = real(*args, **named)
        pairs_seen.append(found.count())
        return found

    monkeypatch.setattr(evaluation, "text_contains", counted)
    got = evaluation.resolve_anchors(anchors, messages, chunks).collect()
    assert {r.query_id: r.key for r in got} == {
        m: f"message:{(200 if room == 0 else 100) + m % 100}" for m, room, _ in rows}
    assert pairs_seen == [6, 0]


def test_a_search_builds_only_the_tables_it_reads(spark, monkeypatch):
    from threadlake.plans import stored
    built = []
    real = stored.materialize
    monkeypatch.setattr(stored, "materialize", lambda df, label: built.append(label) or real(df, label))
    held = stored.Corpus(spark, "/root/testdata/sf0.001")
    assert held.chunks.count() == held.chunks.count() > 0 and built == ["chunks"]
    assert held.index.statistics()[0] > 0 and built == ["chunks"]
    assert held.chunk_points.count() > 0 and built == ["chunks", "chunk_points"]
