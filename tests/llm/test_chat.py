import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadlake.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def digests(spark, rows):
    return {r.conv_id: r for r in chat.digest(chat.format_turns(
        spark.createDataFrame(rows, SCHEMA))).collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(1)
    pieces = ["<|", "|>", "turn", "text", "end", "<|turn|>", "<|text|>", "<|end|>", "<||", "|", "<",
              "0", "1", "user", "\n", "é", "😀", "</s>[INST]", "\\", "$1", ""]
    rows, want = [], {}
    for conv in range(120):
        turns = []
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "assistant", "".join(
                rng.choice(pieces) for _ in range(3))])
            text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))
            turns.append((role, text))
            rows.append((conv, turn, role, text))
        want[conv] = turns
    rng.shuffle(rows)
    got = digests(spark, rows)
    for conv, turns in want.items():
        r = got[conv]
        lines = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.loss_chars == len(loss)


def test_plain_texts_stay_readable(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi <| there"), (1, 1, "assistant", "<|end|>")],
                                 SCHEMA)
    assert chat.format_turns(rows).first().formatted == (
        "<|turn|>0user<|text|>hi <| there<|end|><|turn|>1assistant<|text|><||end|><|end|>")


def test_edges(spark):
    rows = [(1, 2, "assistant", None), (1, None, None, "first"), (1, 2, "assistant", None),
            (None, 0, "user", "x"), (2, 0, "user", "long " * 50_000)]
    got = digests(spark, rows)
    assert set(got) == {1, None, 2}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[1].turns_sha256 == hashlib.sha256(
        b"\nfirst\nassistant\n\nassistant\n\n").hexdigest()
    assert digests(spark, []) == {}


def test_broken_grammar_gives_nulls(spark):
    one = spark.range(1).select(F.explode(F.array(
        chat.parse(F.lit("<|turn|>0user<|text|>no end")),
        chat.parse(F.lit("<|turn|>7user<|text|>x<|end|>")))).alias("t"))
    assert [r.t[0].role for r in one.collect()] == [None, None]


@pytest.mark.parametrize("text", ["<|", "<||", "<|||", "a<|b<||c", "<<|"])
def test_escape_is_reversible(spark, text):
    r = spark.range(1).select(chat.unescape(chat.escape(F.lit(text))).alias("x")).first()
    assert r.x == text


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|end|>"), (None, None, None, None)]
    plain, more = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA)
    for name in ("line", "level", "formatted", "turns", "loss", "n_turns", "parsed", "said", "t", "id", "key"):
        more = more.withColumn(name, F.lit("x"))
    out = [sorted(map(str, chat.digest(chat.format_turns(df)).collect())) for df in (plain, more)]
    assert out[0] == out[1]
