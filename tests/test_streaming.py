import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import pairs
from threadlake.sources.points import PointTable, merge_points
from threadlake.streaming import ingest, state
from threadlake.streaming.runtime import keep_latest, run_to_table, stream_session

DAY = dt.datetime(2025, 1, 1)


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


class Source:
    """A folder that grows file by file, read one file per micro-batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.path, self.schema = spark, f"{folder}/source", schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(
            self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option(
            "maxFilesPerTrigger", 1).parquet(self.path)


@pytest.fixture
def own(spark):
    return stream_session(spark, 2)


MESSAGE = ("message_id long, room_id long, sender_id long, kind string, body string, "
           "created_at timestamp")


def test_replayed_messages_make_one_point(spark, own, folder):
    rooms = own.createDataFrame([(1, True), (2, False)], "room_id long, ai_enabled boolean")
    source = Source(own, folder, MESSAGE)
    row = (5, 1, 7, "user", "hello there", DAY)
    source.add([row, (6, 1, 7, "ai", "no", DAY), (7, 2, 7, "user", "off", DAY)])
    source.add([row])
    table = ingest.stream_ingest(source.stream(), rooms, f"{folder}/points", f"{folder}/ckpt")
    assert pairs(table.read(), "message_id", "text") == [(5, "hello there")]
    source.add([row, (8, 1, 7, None, "legacy", DAY)])
    # the same checkpoint goes on where it stopped; a new one starts over: same points
    for checkpoint in (f"{folder}/ckpt", f"{folder}/again"):
        table = ingest.stream_ingest(source.stream(), rooms, f"{folder}/points", checkpoint)
        assert pairs(table.read(), "message_id") == [(5,), (8,)]


def test_document_status(own, folder):
    source = Source(own, folder, "doc_id long, room_id long, filename string, text string, "
                                 "page_offsets array<int>")
    source.add([(1, 1, "a", "x" * 2500, [0]), (2, 1, "b", None, [0]), (3, 1, "c", "", [0]),
                (4, 9, "d", "other room", [0])])
    points, status = ingest.stream_doc_ingest(source.stream(), f"{folder}/docs")
    assert pairs(status.read(), "doc_id", "status", "chunk_count") == [
        (1, "ready", 2), (2, "failed", 0), (3, "ready", 0), (4, "ready", 1)]
    assert pairs(points.read(), "doc_id", "chunk_index") == [(1, 0), (1, 1), (4, 0)]


def test_point_table(spark, folder):
    table = PointTable(spark, f"{folder}/t", "point_id string, room_id long, text string")
    assert table.read().count() == 0

    def rows(*r):
        return spark.createDataFrame(r, "point_id string, room_id long, text string")

    table.upsert(rows(("a", 1, "x"), ("b", 2, "x")))
    table.upsert(rows())
    table.upsert(rows(("a", 1, "y")))
    table.upsert(rows(("a", 1, "y")))
    assert pairs(table.read(), "point_id", "text") == [("a", "y"), ("b", "x")]
    assert pairs(merge_points(rows(("a", 1, "x"), ("b", 2, "x")), rows(("a", 1, "y"))),
                 "point_id", "text") == [("a", "y"), ("b", "x")]
    table.delete_by("room_id", spark.createDataFrame([(2,)], "room_id long"))
    assert pairs(table.read(), "point_id") == [("a",)]
    small = table.compact(f"{folder}/small")
    assert pairs(small.read(), "point_id", "text") == [("a", "y")] and small.next_seq() == 1


def test_dedup_over_batches(own, folder):
    source = Source(own, folder, "message_id long, sender_id long, client_msg_id string, "
                                 "created_at timestamp")
    source.add([(1, 7, "c", at(0))])
    source.add([(2, 7, "c", at(5)), (3, 8, "c", at(6))])
    out = run_to_table(ingest.stream_dedup_send(source.stream(), "1 hour"), "dedup")
    assert pairs(own.read.parquet(out), "message_id") == [(1,), (3,)]


def test_rate_limit_state_survives_batches(own, folder):
    source = Source(own, folder, "user_id long, event_id long, ts timestamp")
    times = [0, .1, .2, .3, .4, .5, .6, 2.8]
    for half in (range(0, 4), range(4, 8)):
        source.add([(1, i, at(times[i])) for i in half])
    out = run_to_table(state.stream_rate_limit(source.stream(), (5, 10, 2)), "limit")
    got = dict(pairs(own.read.parquet(out), "event_id", "allowed"))
    assert [got[i] for i in range(8)] == [True] * 5 + [False] * 2 + [True]


def test_presence_times_out_in_silence(own, folder):
    source = Source(own, folder, "user_id long, event_id long, ts timestamp, delta int")
    source.add([(1, 0, at(0), 1), (1, 1, at(10), 1)])
    source.add([(2, 2, at(200), 1)])
    source.add([(2, 3, at(201), -1)])
    out = run_to_table(state.stream_presence(source.stream(), 30, "1 second"), "presence")
    got = own.read.parquet(out)
    assert pairs(got, "user_id", "ts", "online") == [
        (1, at(0), True), (1, at(40), False), (2, at(200), True), (2, at(201), False)]


def test_quota_refuses_the_second_call(own, folder):
    source = Source(own, folder, "stream_id long, user_id long, created_at timestamp, "
                                 "tokens long")
    source.add([(1, 7, at(0), 6)])
    source.add([(2, 7, at(1), 6), (3, 7, at(86400), 6)])
    out = run_to_table(state.stream_quota(source.stream(), 5), "quota")
    assert pairs(own.read.parquet(out), "stream_id", "allowed") == [
        (1, True), (2, False), (3, True)]
    usage = keep_latest(ingest.daily_usage(source.stream(), "2 days"), ("user_id", "day"), "use")
    assert pairs(usage.read(), "day", "used") == [("2025-01-01", 12), ("2025-01-02", 6)]


def test_cache_matches_brute_force(own, folder):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 4))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    clock, rows = 0, []
    pick = random.Random(5)
    for i in range(60):
        clock += pick.choice([1, 5, 400])
        rows.append((i, pick.choice("ab"), at(clock), vecs[i].tolist()))
    source = Source(own, folder, "query_id long, fingerprint string, ts timestamp, "
                                 "vector array<double>")
    source.add(rows[:30])
    source.add(rows[30:])
    out = run_to_table(state.stream_cache(source.stream(), .9, 5, 300), "cache")
    held, want = {}, []
    for i, fp, ts, vec in rows:
        entries, renewed = held.get(fp, ([], None))
        if renewed is not None and (ts - renewed).total_seconds() >= 300:
            entries = []
        best = max(entries, key=lambda e: round(float(np.dot(vecs[e], vec)), 6), default=None)
        if best is not None and round(float(np.dot(vecs[best], vec)), 6) >= .9:
            want.append((i, best))
        else:
            want.append((i, None))
            entries, renewed = [i, *entries][:5], ts
        held[fp] = (entries, renewed)
    got = {r.query_id: r.entry_id for r in own.read.parquet(out).collect()}
    assert got == dict(want) and any(e is not None for _, e in want)


def test_dead_letters(own, folder):
    source = Source(own, folder, "id long, question string")
    source.add([(1, "fine question"), (2, "no")])
    from threadlake.operators.validate import question_rules
    ingest.split_stream(source.stream(), question_rules(), f"{folder}/good", f"{folder}/bad")
    assert pairs(own.read.parquet(f"{folder}/good"), "id") == [(1,)]
    assert pairs(own.read.parquet(f"{folder}/bad"), "id", "reason") == [(2, "question")]


def test_heartbeats(spark):
    beats = spark.createDataFrame([(1, at(0)), (1, at(15)), (1, at(46))],
                                  "user_id long, ts timestamp")
    got = ingest.heartbeat_sessions(beats)
    assert pairs(got, "online_at", "offline_at", "beats") == [
        (at(0), at(45), 2), (at(46), at(76), 1)]


def state_rows(stream, checkpoint, out):
    """State rows after each batch; runs until the input is consumed."""
    query = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
             .option("path", out).trigger(availableNow=True).start())
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress
            if p["stateOperators"]]


def random_log(seed, size, step):
    rng, clock, rows = random.Random(seed), 0.0, []
    for i in range(size):
        clock += rng.expovariate(1 / step)
        rows.append((rng.choice([1, 1, 1, 2, 3]), i, clock, rng))
    return rows


@pytest.mark.parametrize("form", ["limit", "breaker", "quota", "cache", "typing", "presence"])
def test_state_is_gone_after_the_last_expiry(own, folder, form):
    day = 86_400
    schema, make, stream = {
        "limit": ("user_id long, event_id long, ts timestamp", lambda u, i, t: (u, i, t),
                  lambda s: state.stream_rate_limit(s, (3, 60, 30), "10 seconds")),
        "breaker": ("provider string, stream_id long, ok boolean, created_at timestamp",
                    lambda u, i, t: (str(u), i, i % 3 == 0, t),
                    lambda s: state.stream_breaker(s, 2, 60, 30, "10 seconds")),
        "quota": ("stream_id long, user_id long, tokens long, created_at timestamp",
                  lambda u, i, t: (i, u, 5, t), lambda s: state.stream_quota(s, 20, "10 seconds")),
        "cache": ("query_id long, fingerprint string, vector array<double>, ts timestamp",
                  lambda u, i, t: (i, str(u), [1.0, float(i % 4)], t),
                  lambda s: state.stream_cache(s, .99, 5, 60, "10 seconds")),
        "typing": ("user_id long, room_id long, event_id long, is_stop boolean, ts timestamp",
                   lambda u, i, t: (u, i % 2, i, i % 5 == 0, t),
                   lambda s: state.stream_typing(s, 3, "10 seconds")),
        "presence": ("user_id long, event_id long, delta int, ts timestamp",
                     lambda u, i, t: (u, i, 1 if i % 3 else -1, t),
                     lambda s: state.stream_presence(s, 30, "10 seconds")),
    }[form]
    source = Source(own, folder, schema)
    for n in range(3):  # all rows of three keys in three batches
        source.add([make(1 + i % 3, 100 * n + i, at(40 * n + i)) for i in range(30)])
    for n in (2, 4, 6):  # far later, one key only, so that the watermark passes all the others
        source.add([make(9, 1000 + n, at(n * day))])
    rows = state_rows(stream(source.stream()), f"{folder}/ckpt", f"{folder}/out")
    assert max(rows) >= 3
    # what is left belongs to the last rows of the late key alone: a value or two, and its timer
    assert rows[-1] <= 4


def test_typing_spans_over_batches(own, folder):
    source = Source(own, folder, "user_id long, room_id long, event_id long, is_stop boolean, ts timestamp")
    source.add([(1, 5, 0, False, at(0)), (1, 5, 1, False, at(2)), (2, 5, 2, False, at(1)), (1, 6, 3, False, at(1))])
    source.add([(1, 5, 4, True, at(4)), (2, 5, 5, False, at(4.5)), (1, 6, 6, True, at(2.5))])
    for n in (100, 200):
        source.add([(9, 9, 1000 + n, True, at(n))])
    out = run_to_table(state.stream_typing(source.stream(), 3, "10 seconds"), "typing")
    assert pairs(own.read.parquet(out), "user_id", "room_id", "started_at", "ended_at") == [
        (1, 5, at(0), at(4)), (1, 6, at(1), at(2.5)), (2, 5, at(1), at(4)), (2, 5, at(4.5), at(7.5))]


def test_presence_gaps_inside_a_batch_count(own, folder):
    source = Source(own, folder, "user_id long, event_id long, delta int, ts timestamp")
    source.add([(1, 0, 1, at(0)), (1, 1, 1, at(100)), (1, 2, -1, at(110))])
    source.add([(2, 3, 1, at(500))])
    out = run_to_table(state.stream_presence(source.stream(), 30, "1 second"), "presence")
    got = own.read.parquet(out).where("user_id = 1")
    assert pairs(got, "ts", "online") == [(at(0), True), (at(30), False), (at(100), True), (at(110), False)]


@pytest.mark.parametrize("seed", range(2))
def test_asof_join_of_two_streams_with_late_switches(own, folder, seed):
    rng = random.Random(seed)
    said = [(i, 0 if rng.random() < .8 else rng.randrange(3), at(rng.randrange(600))) for i in range(200)]
    turned = [(rng.choice([0, 0, 1]), at(rng.randrange(600)), i, rng.random() < .5) for i in range(60)]
    messages = Source(own, f"{folder}/m", "message_id long, room_id long, created_at timestamp")
    switches = Source(own, f"{folder}/s", "room_id long, switched_at timestamp, switch_id long, "
                                          "enabled boolean")
    for low in range(0, 600, 150):  # switches come a batch after the messages they decide
        messages.add([m for m in said if at(low) <= m[2] < at(low + 150)])
        switches.add([s for s in turned if at(low - 150) <= s[1] < at(low)])
    messages.add([(-1, 7, at(90_000))])
    switches.add([s for s in turned if at(450) <= s[1]])
    for n in (100_000, 200_000):
        messages.add([(-1, 7, at(n))])
        switches.add([(7, at(n), -1, True)])
    out = run_to_table(state.stream_memory_switch(messages.stream(), switches.stream(), "20 seconds"),
                       "asof")
    got = {r.message_id: r.ingested for r in own.read.parquet(out).where("message_id >= 0").collect()}
    want = {}
    for id_, room, moment in said:
        known = [(s[1], s[2], s[3]) for s in turned if s[0] == room and s[1] <= moment]
        want[id_] = max(known)[2] if known else True
    assert got == want


def test_failing_rows_are_dead_once_after_their_last_attempt(own, folder):
    source = Source(own, folder, "id long, good_at int")
    source.add([(1, 1), (2, 9), (3, 4)])
    source.add([(4, 2)])
    calls = []

    def attempt(df):
        calls.append(sorted((r.id, r.attempts) for r in df.collect()))
        return df.withColumn("error", F.when(F.col("attempts") + 1 < F.col("good_at"), "no"))

    def run():
        return ingest.stream_with_retries(source.stream(), attempt, f"{folder}/retries", "message",
                                          f"{folder}/ckpt")

    table = run()
    assert calls == [[(1, 0), (2, 0), (3, 0)], [(2, 1), (3, 1), (4, 0)], [(2, 2), (3, 2), (4, 1)],
                     [(2, 3), (3, 3)], [(2, 4)]]
    assert pairs(table.read("dead"), "id", "attempts") == [(2, 5)]
    assert pairs(table.read("done"), "id", "attempts") == [(1, 1), (3, 4), (4, 2)]
    source.add([(5, 1), (6, 99)])
    table = run()  # goes on with the checkpoint
    assert pairs(table.read("dead"), "id", "attempts") == [(2, 5), (6, 5)]
    assert pairs(table.read("done"), "id") == [(1,), (3,), (4,), (5,)]
    # a repeated round replaces itself
    table.run(None, attempt, 5, 2, 4)
    assert pairs(table.read("dead"), "id", "attempts") == [(2, 5), (6, 5)]
    documents = ingest.stream_with_retries(source.stream(), attempt, f"{folder}/docs", "document")
    assert pairs(documents.read("dead"), "id", "attempts") == [(2, 3), (3, 3), (6, 3)]


@pytest.mark.parametrize("key", ["dead_letter", "stream_ingest", "stream_doc_ingest", "stream_dedup_send"])
def test_streams_read_tables_of_several_files(spark, folder, key):
    import os
    from threadlake.plans.catalog import QUERIES
    whole = "/root/testdata/sf0.001"
    for name in os.listdir(whole):
        if name.split(".")[0] in ("documents", "conversations", "events"):
            spark.read.parquet(f"{whole}/{name}").repartition(3).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{whole}/{name}", f"{folder}/{name}")
    got, want = (sorted(map(str, QUERIES[key](spark, sf).collect())) for sf in (folder, whole))
    assert got == want and got


def test_state_of_many_keys_is_a_few_rows_a_lane(own, folder):
    source = Source(own, folder, "stream_id long, user_id long, tokens long, created_at timestamp")
    big = 1 << 60  # odd ids keep their digits beside a null one
    for n in range(2):
        source.add([(big + 3000 * n + u, None if u == 7 else big + u, 6, at(60 * n)) for u in range(3000)])
    rows = state_rows(state.stream_quota(source.stream(), 5), f"{folder}/ckpt", f"{folder}/out")
    assert max(rows) <= 4 * state.LANES  # a value and timers for each lane, not for each of 3,000 users
    got = own.read.parquet(f"{folder}/out")
    assert pairs(got.where("not allowed"), "stream_id") == [(big + 3000 + u,) for u in range(3000)]
    assert got.where("user_id is null").count() == 2
    assert got.where("used_before > 6").count() == 0 and got.select("user_id").distinct().count() == 3000


def test_waiting_messages_are_few_state_rows(own, folder):
    messages = Source(own, f"{folder}/m", "message_id long, room_id long, created_at timestamp")
    switches = Source(own, f"{folder}/s", "room_id long, switched_at timestamp, switch_id long, enabled boolean")
    messages.add([(i, 1, at(i)) for i in range(2000)] + [(5, 1, at(5))])  # one delivered twice
    switches.add([(1, at(1000), 0, False), (1, at(1500), 1, None)])  # an unknown state is on
    for n in (100_000, 200_000):
        messages.add([(-1, 7, at(n))])
        switches.add([(7, at(n), -1, True)])
    rows = state_rows(state.stream_memory_switch(messages.stream(), switches.stream(), "20 seconds"),
                      f"{folder}/ckpt", f"{folder}/out")
    assert max(rows) <= 100
    got = own.read.parquet(f"{folder}/out").where("message_id >= 0")
    assert got.count() == 2000
    assert pairs(got.where("not ingested"), "message_id") == [(i,) for i in range(1000, 1500)]
