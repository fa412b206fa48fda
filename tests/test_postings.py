"""The stored inverted index: batches, replays, replaced texts, exact skipping of blocks."""

import contextlib
import io
import random

import pytest

from threadlake.operators import lexical
from threadlake.operators.lexical import indexed_leg, lexical_leg
from threadlake.sources.postings import PostingTable
from threadlake.streaming import ingest
from threadlake.streaming.runtime import stream_session

WORDS = ["the"] * 30 + ["of"] * 15 + [f"word{i}" for i in range(60)]


def corpus(seed, size, first=0):
    rng = random.Random(seed)
    return [(f"m{i}", i % 3, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 40))))
            for i in range(first, first + size)]


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(5)
    asks = [(j, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 8)))) for j in range(25)]
    scope = [(j, r) for j, _ in asks for r in range(3) if (j + r) % 4]
    return (spark.createDataFrame(asks + [(90, "nowhere"), (91, "")], "query_id int, question string"),
            spark.createDataFrame(scope, "query_id int, room_id long"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, room_id long, text string")


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.room_id, r.score) for r in df.collect())


def test_batches_give_what_one_index_of_all_gives(spark, asked, folder):
    queries, scope = asked
    parts = [corpus(1, 80), corpus(2, 50, 80), corpus(3, 40, 130)]
    index = PostingTable(spark, f"{folder}/index")
    assert index.statistics() == (0, 0.0) and hits(indexed_leg(queries, index, scope)) == []
    for part in parts:
        index.add(frame(spark, part))
    index.add(frame(spark, parts[2]), 2)  # a repeated batch replaces itself
    want = hits(lexical_leg(queries, frame(spark, sum(parts, [])), scope, 7))
    for direct in (10 ** 9, 0):
        assert hits(indexed_leg(queries, index, scope, 7, direct)) == want
    # edited texts, a text twice edited, a redelivery in a later batch, an empty text
    edits = [("m3", 0, "word1 word1 of"), ("m81", 0, "moved to another room word2"), ("m5", 2, "")]
    index.add(frame(spark, edits))
    index.add(frame(spark, [("m3", 0, "word7 the"), parts[0][10]]))
    now = {r[0]: r for part in (*parts, edits, [("m3", 0, "word7 the")]) for r in part}
    want = hits(lexical_leg(queries, frame(spark, list(now.values())), scope, 7))
    for direct in (10 ** 9, 0):
        assert hits(indexed_leg(queries, index, scope, 7, direct)) == want


@pytest.mark.parametrize("seed", range(3))
def test_skipped_blocks_hold_no_hit(spark, asked, folder, seed):
    queries, scope = asked
    index = PostingTable(spark, f"{folder}/index")
    index.add(frame(spark, corpus(seed, 400)))
    for k in (1, 3, 20):
        assert hits(indexed_leg(queries, index, scope, k, 0)) == hits(
            indexed_leg(queries, index, scope, k))


def test_the_scan_reads_the_tokens_and_their_buckets(spark, folder):
    index = PostingTable(spark, f"{folder}/index")
    index.add(frame(spark, corpus(1, 100)))
    wanted = spark.createDataFrame([("word3",), ("word9",)], "token string")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        index.postings(index.wanted(wanted)).explain("formatted")
    text = out.getvalue()
    assert "In(token, [word3,word9])" in text and "bucket#" in text.split("PartitionFilters: ")[1].split("\n")[0]
    assert {r.token for r in index.postings(index.wanted(wanted)).collect()} == {"word3", "word9"}
    many = spark.createDataFrame([(f"word{i}",) for i in range(600)], "token string")
    assert index.postings(index.wanted(many)).count() == index.table("postings").where("token LIKE 'word%'").count()


def test_blocks_bound_their_postings(spark, folder):
    index = PostingTable(spark, f"{folder}/index")
    for n in range(3):
        index.add(frame(spark, corpus(n, 100, 100 * n)))
    every = index.wanted(index.table("postings"))
    blocks = {(r.token, r.room_id, r.level): r for r in index.blocks(every).collect()}
    count = 0
    for r in index.postings(every).collect():
        block = blocks[r.token, r.room_id, r.level]
        assert r.tf <= block.tf and r.length >= block.length
        count += 1
    assert count == sum(b.documents for b in blocks.values())


def test_the_stream_keeps_the_index_over_restarts(spark, asked, folder):
    queries, scope = asked
    own = stream_session(spark, 2)
    rooms = own.createDataFrame([(r, True) for r in range(3)], "room_id long, ai_enabled boolean")
    schema = ("message_id long, room_id long, sender_id long, kind string, body string, "
              "created_at timestamp")

    def add(rows, day):
        own.sql("SELECT 1")
        own.createDataFrame([(int(i[1:]), room, 1, "user", body) for i, room, body in rows],
                            "message_id long, room_id long, sender_id long, kind string, body string"
                            ).selectExpr("*", f"timestamp'2025-01-{day:02d}' AS created_at").coalesce(
            1).write.mode("append").parquet(f"{folder}/source")

    def run(checkpoint):
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
            f"{folder}/source")
        return ingest.stream_index(stream, rooms, f"{folder}/index", f"{folder}/{checkpoint}")

    rows = corpus(4, 60)
    add(rows[:30], 1)
    add(rows[30:], 2)
    run("ckpt")
    add([("m2", 2, "word5 word5 edited")], 3)
    index = run("ckpt")  # goes on where it stopped
    now = {r[0]: r for r in (*rows, ("m2", 2, "word5 word5 edited"))}
    want = [(q, rank, f"message:{d[1:]}", room, s) for q, rank, d, room, s in hits(
        lexical_leg(queries, frame(spark, list(now.values())), scope, 7))]

    def same():
        got = hits(indexed_leg(queries, index, scope, 7))
        return sorted((q, s) for q, _, _, _, s in got) == sorted((q, s) for q, _, _, _, s in want)

    assert same() and index.next_batch() == 3
    # a restart that repeats the last batch gives it its old number
    import shutil
    last = max(int(n) for n in __import__("os").listdir(f"{folder}/ckpt/commits") if n.isdigit())
    shutil.move(f"{folder}/ckpt/commits/{last}", f"{folder}/moved")
    with contextlib.suppress(FileNotFoundError):
        shutil.move(f"{folder}/ckpt/commits/.{last}.crc", f"{folder}/moved.crc")
    run("ckpt")
    assert same() and index.next_batch() == 3


def test_a_common_word_of_a_room_is_cut_into_parts(spark, asked, folder, monkeypatch):
    """All postings of a word in a room were joined in one task."""
    queries, scope = asked
    index = PostingTable(spark, f"{folder}/index")
    index.add(frame(spark, corpus(7, 200)))
    want, seen, total = hits(indexed_leg(queries, index, scope)), [], lexical._total
    monkeypatch.setattr(lexical, "PART_PAIRS", 500)
    monkeypatch.setattr(lexical, "_total", lambda pairs, k: seen.append(pairs) or total(pairs, k))
    assert hits(indexed_leg(queries, index, scope)) == want
    sizes = [r["count"] for r in seen[0].where("token = 'the' AND room_id = 0").groupBy("_part").count().collect()]
    assert len(sizes) > 3 and max(sizes) < 0.5 * sum(sizes)
