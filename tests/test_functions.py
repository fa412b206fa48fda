import numpy as np
from pyspark.sql import functions as F

from threadlake.functions import scalar
from threadlake.functions.embedding import embed, embed_rows, token_vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_json_array_len(spark):
    cases = {'[{"a":1},{"b":2},{"c":3}]': 3, "not json": 0, "[1] x": 0, "[1] [2]": 0,
             '{"a":1}': 0, "[]": 0, "": 0, "[[1],[2,3]]": 2, "[1],[2]": 0}
    df = spark.createDataFrame([*[(k,) for k in cases], (None,)], "t string")
    got = {r.t: r.n for r in df.select("t", scalar.json_array_len(F.col("t")).alias("n"))
           .collect()}
    assert got == {**cases, None: 0}


def test_word_count_of_blank_and_null(spark):
    df = spark.createDataFrame([("hello world  foo",), ("",), ("   ",), (None,)], "b string")
    assert [r.n for r in df.select(scalar.word_count(F.col("b")).alias("n")).collect()] == [
        3, 1, 1, None]


def test_parse_iso_is_lenient(spark):
    assert one(spark, scalar.parse_iso(F.lit("nope"))) is None
    assert one(spark, scalar.date_key(scalar.parse_iso(
        F.lit("2025-06-01T23:30:00-02:00")))) == 20250602


def test_command_prefix_needs_the_space(spark):
    df = spark.createDataFrame([("@recall x",), ("@recallx",), ("say @recall x",)], "b string")
    assert [r.c for r in df.select(scalar.is_command(F.col("b")).alias("c")).collect()] == [
        True, False, False]


def test_normalize_collapses_all_white_space(spark):
    assert one(spark, scalar.normalize_text(F.lit(" A b\n\nC "))) == "a b c"
    assert len(one(spark, scalar.normalize_text(F.lit("x" * 500)))) == 300


def test_markers(spark):
    got = one(spark, scalar.citation_markers(F.lit("x [2] [12] [1][2] [0] [123] [9]"),
                                             F.lit(9)))
    assert got == [1, 2, 9]


def test_page_for_offset(spark):
    def page(offset, pages):
        return one(spark, scalar.page_for_offset(
            F.lit(offset), F.lit(pages) if pages else F.array().cast("array<int>")))

    assert page(10, []) == 1
    assert page(2999, [0, 3000]) == 1
    assert page(3000, [0, 3000]) == 2
    assert page(5, [10, 20]) == 1


def test_ratio_rounds_half_up(spark):
    assert one(spark, scalar.ratio_1dp(F.lit(1), F.lit(20))) == 0.1
    assert one(spark, scalar.ratio_1dp(F.lit(200), F.lit(3))) == 66.7
    assert one(spark, scalar.ratio_1dp(F.lit(1), F.lit(0))) is None


def test_fingerprint_ignores_order(spark):
    a = one(spark, scalar.permission_fingerprint(F.array(F.lit("b"), F.lit("a")), "global"))
    b = one(spark, scalar.permission_fingerprint(F.array(F.lit("a"), F.lit("b")), "global"))
    c = one(spark, scalar.permission_fingerprint(F.array(F.lit("a")), "global"))
    assert a == b != c and len(a) == 32


def plain_generator(seed, n):
    """The generator one step at a time, on Python integers."""
    mask, state, out = 0xFFFFFFFF, seed, []
    for _ in range(n):
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ state >> 15) * (state | 1)) & mask
        t ^= (t + ((t ^ t >> 7) * (t | 61) & mask)) & mask
        out.append((t ^ t >> 14) / 2**31 - 1)
    return out


def test_token_vectors_match_the_stepwise_generator():
    import hashlib
    seed = int.from_bytes(hashlib.sha256(b"deadline").digest()[:4], "little")
    assert np.allclose(token_vectors(["deadline"], 256)[0], plain_generator(seed, 256))


def test_embedding_properties(spark):
    text = "the quarterly report deadline moved to friday"
    df = spark.createDataFrame([(0, text), (1, text.upper()), (2, "lunch menu"), (3, "!"),
                                (4, None)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", embed(F.col("t"), 256).alias("v")).collect()}
    assert got[4] is None
    v = {i: np.array(x) for i, x in got.items() if x is not None}
    assert np.isclose(v[0] @ v[1], 1.0) and abs(v[0] @ v[2]) < 0.5
    assert all(np.isclose(np.linalg.norm(x), 1.0) for x in v.values())


def test_embedding_in_slices(monkeypatch):
    from threadlake.functions import embedding
    lists = [["aa", "bb"], [], ["cc"] * 5, ["aa"]]
    texts = ["aa bb", "?", "cc cc cc cc cc", "aa"]
    whole = embed_rows(lists, texts, 16)
    monkeypatch.setattr(embedding, "_TOKENS_AT_ONCE", 1)
    assert np.allclose(whole, embed_rows(lists, texts, 16))


def test_embedding_keeps_little_of_a_batch_as_objects(monkeypatch):
    import pyarrow as pa
    from threadlake.functions import embedding
    lists = [[f"w{i % 97}", f"v{i}", "x"] if i % 5 else [] for i in range(2000)]
    texts = [None if i % 7 == 0 else " ".join(t) or "?" for i, t in enumerate(lists)]
    lists = [None if t is None else x for t, x in zip(texts, lists)]
    whole, seen = embed_rows(lists, texts, 8), []
    rows = embedding.embed_rows
    monkeypatch.setattr(embedding, "_TOKENS_AT_ONCE", 100)
    monkeypatch.setattr(embedding, "embed_rows", lambda t, x, d: seen.append(
        sum(map(len, t))) or rows(t, x, d))
    got = embedding.embed_arrays(pa.array(lists).slice(1), pa.array(texts).slice(1), 8).to_pylist()
    assert max(seen) <= 100 and len(got) == 1999
    assert all((a is None) == (b is None) and (a is None or np.allclose(a, b))
               for a, b in zip(got, whole[1:]))
    assert embedding.embed_arrays(pa.array([], pa.list_(pa.string())), pa.array([], pa.string()), 8).to_pylist() == []
