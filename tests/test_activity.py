import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import pairs
from threadlake.operators import activity, delivery, limits, paging, presence, scope, validate
from threadlake.operators.dedup import dedup_send, reconcile_by_either_key, resolve_retries
from threadlake.operators.metrics import fanout_stats
from threadlake.streaming.ingest import memory_switch_asof, retry_or_bury

DAY = dt.datetime(2025, 1, 1)
MESSAGE = ("message_id long, room_id long, sender_id long, kind string, body string, "
           "created_at timestamp, client_msg_id string")


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def log(spark, n=300, rooms=2, users=4, seed=3):
    rng = random.Random(seed)
    rows = [(i, 0 if rng.random() < .8 else rng.randrange(rooms), rng.randrange(users),
             rng.choice(["user", "user", None, "ai"]), rng.choice(["hi", "hi", "@recall hi"]),
             at(i * 10), str(rng.randrange(40))) for i in range(n)]
    return rows, spark.createDataFrame(rows, MESSAGE)


def members(spark, users=4, rooms=2, n=300, seed=5):
    rng = random.Random(seed)
    rows = [(u, r, rng.choice([None, rng.randrange(n), n + 5])) for u in range(users)
            for r in range(rooms)]
    return rows, spark.createDataFrame(rows, "user_id long, room_id long, "
                                             "last_read_message_id long")


@pytest.mark.parametrize("limit", [10_000, 20])
def test_unread_and_catchup_match_brute_force(spark, limit):
    rows, df = log(spark)
    who, mem = members(spark)
    unread, digest = [], []
    for user, room, cursor in who:
        later = [m for m in rows if m[1] == room and m[2] != user
                 and (cursor is None or m[0] > cursor)]
        unread.append((user, room, len(later)))
        clean = [m for m in later if m[3] != "ai" and not m[4].startswith("@recall ")]
        digest += [(user, room, m[0], i + 1) for i, m in enumerate(clean[:25])]
    got = activity.unread_counts(mem, df, max_group_rows=limit)
    assert pairs(got, "user_id", "room_id", "unread") == sorted(unread)
    got = activity.catchup_window(mem, df, 25, max_group_rows=limit)
    assert pairs(got, "user_id", "room_id", "message_id", "position") == sorted(digest)


def test_catchup_boundary_overrides_cursor(spark):
    rows = [(i, 0, 1, "user", "hi", at(i), "c") for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, MESSAGE)
    mem = spark.createDataFrame([(9, 0, 3, 1), (8, 0, 3, None)],
                                "user_id long, room_id long, last_read_message_id long, "
                                "since_message_id long")
    got = activity.catchup_window(mem, df)
    assert pairs(got, "user_id", "message_id") == [(9, 2), (9, 3)]


@pytest.mark.parametrize("cap,limit", [(5, 10_000), (40, 10_000), (40, 20)])
def test_sync(spark, cap, limit):
    rows, df = log(spark)
    cursors = [(u, r, c) for u in (0, 1) for r, c in ((0, 280), (1, 100), (0, 299))][:4]
    cursors = list({(u, r): (u, r, c) for u, r, c in cursors}.values())
    mem = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "user_id long, room_id long")
    want = []
    for user, room, cursor in cursors:
        if (user, room) == (1, 1):
            continue
        missed = [m[0] for m in rows if m[1] == room and m[0] > cursor]
        if len(missed) > cap:
            want.append((user, room, True, None))
        else:
            want += [(user, room, False, m) for m in missed] or [(user, room, False, None)]
    got = activity.sync_since(spark.createDataFrame(
        cursors, "user_id long, room_id long, last_message_id long"), mem, df, cap,
        max_group_rows=limit)
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, want))


def test_read_cursor_only_moves_forward(spark):
    rows = [(1, 0, 0, 10, at(0)), (2, 0, 0, 5, at(1)), (3, 0, 0, 10, at(2)), (4, 0, 0, 11, at(3))]
    df = spark.createDataFrame(rows, "receipt_id long, user_id long, room_id long, "
                                     "last_read_message_id long, created_at timestamp")
    assert pairs(activity.read_cursor_moves(df), "receipt_id") == [(1,), (4,)]
    assert activity.read_cursor(df).first()["last_read_message_id"] == 11


def test_scope_follows_membership_and_switch(spark):
    rooms = spark.createDataFrame([(1, None), (2, True), (3, False)],
                                  "room_id long, ai_enabled boolean")
    mem = spark.createDataFrame([(7, 1), (7, 2), (7, 3)], "user_id long, room_id long")
    asks = spark.createDataFrame([(0, 7, None), (1, 7, 2), (2, 7, 3), (3, 7, 9), (4, 8, None)],
                                 "query_id long, user_id long, restrict_room long")
    assert pairs(scope.permission_scope(asks, mem, rooms), "query_id", "room_id") == [
        (0, 1), (0, 2), (1, 2)]
    left = mem.where("room_id <> 2")
    assert pairs(scope.permission_scope(asks, left, rooms), "query_id", "room_id") == [(0, 1)]


def test_knowledge_filter(spark):
    rooms = spark.createDataFrame([(1, None), (2, False)], "room_id long, ai_enabled boolean")
    df = spark.createDataFrame([(1, 1, "ai", "x"), (2, 1, None, "x"), (3, 1, "user", "@recall x"),
                                (4, 1, "user", "@recallx"), (5, 2, "user", "x")],
                               "message_id long, room_id long, kind string, body string")
    assert pairs(scope.knowledge_filter(df, rooms), "message_id") == [(2,), (4,)]


def test_enrichment_defaults(spark):
    df = spark.createDataFrame([(1, 5, 1), (2, 6, 2)], "message_id long, sender_id long, room_id long")
    users = spark.createDataFrame([(5, "ann", "Ann")], "user_id long, username string, "
                                                       "display_name string")
    rooms = spark.createDataFrame([(1, "general")], "room_id long, name string")
    out = scope.enrich_room_name(scope.enrich_sender(df, users), rooms)
    assert pairs(out, "message_id", "username", "display_name", "room_name") == [
        (1, "ann", "Ann", "general"), (2, "deleted", "Deleted user", "unknown")]


def test_first_failing_rule_is_reported(spark):
    good, uuid = "a" * 24, "0" * 8 + "-0000-0000-0000-" + "0" * 12
    df = spark.createDataFrame([(good, uuid, " hi "), ("zz", "no", ""), (good, "no", ""),
                                (good, uuid, "   "), (good, uuid, "x" * 2001),
                                (good, uuid, None)],
                               "room_id string, client_msg_id string, body string")
    got = [r.error_path for r in validate.row_validation(df, validate.message_rules()).collect()]
    assert got == [None, "roomId", "clientMsgId", "body", "body", "body"]
    ok, bad = validate.split_valid(df, validate.message_rules())
    assert (ok.count(), bad.count()) == (1, 5)
    users = spark.createDataFrame([("ab", "n"), ("a b c", "n"), ("Good_1", "")],
                                  "username string, display_name string")
    assert [r.error_path for r in validate.row_validation(users, validate.user_rules())
            .collect()] == ["username", "username", "displayName"]


def test_validity(spark):
    df = spark.createDataFrame([(1, None, at(10), 0, 1), (2, at(0), at(10), 0, 1),
                                (3, None, at(5), 0, 1), (4, None, at(10), 1, 1)],
                               "id int, revoked_at timestamp, expires_at timestamp, "
                               "redemption_count int, max_redemptions int")
    assert pairs(validate.valid_invites(df, at(5)), "id") == [(1,)]
    assert pairs(validate.valid_tokens(df), "id") == [(1,), (3,), (4,)]


def test_text_contains_matches_brute_force(spark):
    texts = ["the cat sat on the mat", "a cat  sat", "catalog of cats", "", "on the", "xx yy zz",
             "line one\nline two ends here", "émile a dit oui"]
    needles = ["cat sat on", "the", "cat", "at", "t", "", "on the mat", "cat  sat", "yy zz",
               "nothing at all here", "one\nline two", "mile a di", "line two ends", " "]
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "nid int, needle string")
    want = sorted((i, j) for i, x in enumerate(texts) for j, y in enumerate(needles)
                  if y in x)
    for size in (validate.NEEDLE_BYTES, 12):  # one reading, several
        got = validate.text_contains(t, n, "tid", "text", "nid", "needle", needle_bytes=size)
        assert pairs(got, "tid", "nid") == want
    assert pairs(validate.name_contains(t, "text", "CAT"), "tid") == [(0,), (1,), (2,)]


def test_hits_of_a_batch_are_handed_on_bit_by_bit():
    import pyarrow as pa
    from types import SimpleNamespace
    shared = SimpleNamespace(value=(validate._Needles([("a", 0, None), ("", 1, None), ("b", 2, None)]), [7, 8, 9]))
    texts = ["ab", None, "", "b"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["i", "t"])
    got = list(validate._occurrences(shared, pa.int64(), False, 40)(iter([batch])))
    assert max(b.num_rows for b in got) == 40
    rows = sorted((r["text_id"], r["needle_id"]) for b in got for r in b.to_pylist())
    assert rows == sorted((i, n) for i, t in enumerate(texts) if t is not None
                          for needle, n in (("a", 7), ("", 8), ("b", 9)) if needle in t)


def test_text_contains_within_groups_and_with_nulls(spark):
    t = spark.createDataFrame([((1, 0), "a cat", 1), ((2, 0), "a cat", 2), ((3, 0), None, 1),
                               ((4, 0), "", 1), ((5, 0), "cat", None)],
                              "tid struct<a:int,b:int>, text string, room int")
    n = spark.createDataFrame([("x", "cat", 1), ("y", "cat", 1), ("z", "", 1), ("w", None, 2),
                               ("v", "a", 2), ("u", "cat", None)], "nid string, needle string, room int")
    got = validate.text_contains(t, n, "tid", "text", "nid", "needle", group="room")
    assert sorted((r.tid.a, r.nid) for r in got.collect()) == [
        (1, "x"), (1, "y"), (1, "z"), (2, "v"), (4, "z")]
    assert validate.text_contains(t, n.limit(0), "tid", "text", "nid", "needle").collect() == []


def test_many_needles_are_looked_for_in_one_reading(spark, monkeypatch):
    """Each 8 MB of needles took a reading of all texts; the limit is 12 bytes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé𝄞") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 40]))) for _ in range(60)] + [None, "", "a" * 50, "a" * 700]
    t = spark.createDataFrame([(i, i % 3 if i % 7 else None, x) for i, x in enumerate(texts)],
                              "tid int, room long, text string")
    needles = [x[at:at + size] for x in texts if x for at in (0, 2) for size in (7, 7, 9)] + [
        "not there", "aaaaaaaaa", "aaaaaaa", "aaaaaaa", None]
    n = spark.createDataFrame([(f"n{i}", i % 4 if i % 9 else None, x) for i, x in enumerate(needles)],
                              "nid string, room int, needle string")
    monkeypatch.setattr(validate, "BLOCK", 64)  # long texts are cut
    readings, real = [], validate._occurrences
    monkeypatch.setattr(validate, "_occurrences", lambda *a: readings.append(a) or real(*a))
    for group, same in ((None, lambda i, j: True), ("room", lambda i, j: i % 7 and j % 9 and i % 3 == j % 4)):
        want = sorted((i, f"n{j}") for i, x in enumerate(texts) for j, y in enumerate(needles)
                      if x is not None and y is not None and y in x and same(i, j))
        assert len(want) > 20
        got = validate.text_contains(t, n, "tid", "text", "nid", "needle", group=group, needle_bytes=12)
        assert pairs(got, "tid", "nid") == want
        got = validate.text_contains(t, n.withColumn("room", F.col("room").cast("long")), "tid", "text", "nid",
                                     "needle", group=group, needle_bytes=12)
        assert pairs(got, "tid", "nid") == want
    assert not readings


def test_resends(spark):
    rows = [(1, 0, 7, "user", "a", at(0), "c1"), (2, 0, 7, "user", "a", at(1), "c1"),
            (3, 0, 8, "user", "a", at(2), "c1")]
    df = spark.createDataFrame(rows, MESSAGE)
    assert pairs(dedup_send(df), "message_id") == [(1,), (3,)]
    assert pairs(resolve_retries(df), "message_id", "canonical_id", "is_retry") == [
        (1, 1, False), (2, 1, True), (3, 3, False)]


def test_pending_rows_stay_apart(spark):
    schema = "message_id long, room_id long, sender_id long, client_msg_id string, body string"
    held = spark.createDataFrame([(None, 0, 7, f"c{i}", f"pending {i}") for i in (1, 2, 3)],
                                 schema)
    new = spark.createDataFrame([(9, 0, 7, "c1", "sent")], schema)
    assert pairs(reconcile_by_either_key(held, new), "body") == [
        ("pending 2",), ("pending 3",), ("sent",)]


def test_needles_stay_in_their_group(spark):
    t = spark.createDataFrame([(1, 0, "a b c"), (2, 1, "a b c"), (3, 0, "")],
                              "tid int, room int, text string")
    n = spark.createDataFrame([(1, 0, "a b c"), (2, 1, "b"), (3, 0, ""), (4, 2, "a")],
                              "nid int, room int, needle string")
    got = validate.text_contains(t, n, "tid", "text", "nid", "needle", group="room")
    assert pairs(got, "tid", "nid") == [(1, 1), (1, 3), (2, 2), (3, 3)]


def test_reconcile_by_either_key(spark):
    schema = "message_id long, room_id long, sender_id long, client_msg_id string, body string"
    held = spark.createDataFrame([(None, 0, 7, "c1", "sending"), (5, 0, 8, "c2", "old")], schema)
    new = spark.createDataFrame([(9, 0, 7, "c1", "sent"), (5, 0, 8, None, "edited"),
                                 (6, 0, 8, "c3", "more")], schema)
    assert pairs(reconcile_by_either_key(held, new), "message_id", "body") == [
        (5, "edited"), (6, "more"), (9, "sent")]


def test_delivery(spark):
    sends = spark.createDataFrame([(1, 0, 7), (2, 0, 8), (3, 0, 9)],
                                  "message_id long, room_id long, sender_id long")
    mem = spark.createDataFrame([(0, 7), (0, 8), (0, 6)], "room_id long, user_id long")
    receipts = spark.createDataFrame([(1, 8), (1, 6), (1, 5), (2, 8), (2, 7), (3, 7), (3, 7)],
                                     "message_id long, user_id long")
    got = delivery.delivery_audit(sends, mem, receipts)
    assert pairs(got, "message_id", "user_id") == [(2, 6), (3, 6), (3, 8)]
    cursors = spark.createDataFrame([(0, 7, 2), (0, 8, 1), (0, 6, None)],
                                    "room_id long, user_id long, last_read_message_id long")
    got = delivery.delivery_status(sends, receipts, cursors)
    assert pairs(got, "message_id", "status") == [(1, "read"), (2, "read"), (3, "delivered")]
    runs = sends.withColumn("run_id", F.lit("r"))
    timed = receipts.withColumn("latency_ms", F.col("user_id") * 10)
    row = fanout_stats(runs, timed).first()
    assert (row.sent, row.delivered, row.p50_ms, row.max_ms) == (3, 7, 70, 80)


def test_one_silent_member_of_a_large_room(spark):
    """Rooms of one word, several words, several blocks; what lacks is what brute force says."""
    sizes = {0: 3, 1: 64, 2: 65, 3: 4096, 4: 9000, 5: 1}
    members = spark.range(9000).selectExpr("id * 7 AS user_id", "explode(sequence(0L, 5L)) AS room_id", "id").where(
        " OR ".join(f"(room_id = {r} AND id < {n})" for r, n in sizes.items())).select("room_id", "user_id")
    # message m in room m % 6, sent by a member or (every third) by a stranger
    sent = spark.range(12).selectExpr("id AS message_id", "id % 6 AS room_id",
                                      "CASE WHEN id % 3 = 0 THEN 3L ELSE 0L END AS sender_id")
    silent = "user_id = 14 OR (message_id = 10 AND user_id BETWEEN 20000 AND 50000) OR message_id = 7"
    receipts = members.join(sent, "room_id").where(f"NOT ({silent})").select("message_id", "user_id")
    noise = spark.createDataFrame([(4, 99_999_999), (5, 1), (77, 7), (4, 7), (4, 7)],
                                  "message_id long, user_id long")
    got = delivery.delivery_audit(sent, members, receipts.unionByName(noise).unionByName(receipts))
    want = members.join(sent, "room_id").where(f"({silent}) AND user_id <> sender_id").select(
        "message_id", "room_id", "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("sizes,stored", [((5, 64), ["rooms"]), ((5, 64, 65, 130), ["rooms", "ordinals", "got"])])
def test_delivery_audit_of_small_and_large_rooms(spark, monkeypatch, sizes, stored):
    """Rooms of at most a word of members need no ordinals; all went that way."""
    labels, keep = [], delivery.materialize
    monkeypatch.setattr(delivery, "materialize", lambda df, label: labels.append(label) or keep(df, label))
    held = [(room, room * 1000 + u) for room, size in enumerate(sizes) for u in range(size)]
    sent = [(room * 100 + n, room, [room * 1000, 999_999, None][n % 3]) for room in range(len(sizes)) for n in range(9)]
    got = [(m, u) for m, room, _ in sent for r, u in held if r == room and (m * 7 + u) % 5]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names))
    found = delivery.delivery_audit(
        frame(sent, ["message_id", "room_id", "sender_id"]),
        frame(held * 2 + [(0, None), (None, 7)], ["room_id", "user_id"]),
        frame(got * 2 + [(0, 888_888), (0, None), (555, 3)], ["message_id", "user_id"])).collect()
    assert labels == stored
    assert sorted(map(tuple, found)) == sorted(
        (m, room, u) for m, room, s in sent for r, u in held if r == room and u != s and (m, u) not in set(got))


def test_paging(spark):
    rows = [(i, 0, 1, "user", "b", at(0 if i < 3 else i), "c") for i in range(1, 6)]
    df = spark.createDataFrame(rows, MESSAGE)
    for limit in (10_000, 2):
        pages = paging.all_pages(df, ["room_id"], [F.desc("created_at"), F.desc("message_id")],
                                 2, F.col("message_id"), "message_id", max_group_rows=limit)
        assert sorted((r.page, r.rows, r.first_id, r.last_id, r.next_cursor)
                      for r in pages.collect()) == [(0, 2, 5, 4, 4), (1, 2, 3, 2, 2),
                                                    (2, 1, 1, 1, None)]
    first = paging.keyset_page(df, 0, 2).collect()
    assert [r.message_id for r in first] == [5, 4, 3]
    second = paging.keyset_page(df, 0, 2, (first[1].created_at, first[1].message_id)).collect()
    assert [r.message_id for r in second] == [3, 2, 1]
    tied = paging.keyset_page(df, 0, 2, (at(0), 2)).collect()
    assert [r.message_id for r in tied] == [1]
    assert [r.message_id for r in paging.id_page(df, "message_id", 2, 2).collect()] == [3, 4, 5]
    last = paging.last_n_chronological(df, 3)
    assert pairs(last, "position", "message_id") == [(1, 3), (2, 4), (3, 5)]


@pytest.mark.parametrize("limit", [10_000, 2])
def test_grouping(spark, limit):
    def msg(i, sender, sec, kind="user"):
        return (i, 0, sender, kind, "b", at(sec), "c")

    midnight = 86400
    rows = [msg(1, 7, 0), msg(2, 7, 180), msg(3, 7, 361), msg(4, 8, 362), msg(5, 8, 363, "ai"),
            msg(6, 8, 364), msg(7, 8, 365), msg(8, 8, midnight), msg(9, 8, midnight + 1)]
    got = paging.message_grouping(spark.createDataFrame(rows, MESSAGE), max_group_rows=limit)
    out = {r.message_id: (r.show_header, r.new_day, r.run_id) for r in got.collect()}
    assert [out[i][0] for i in range(1, 10)] == [True, False, True, True, True, True, False,
                                                 True, False]
    assert [i for i in out if out[i][1]] == [1, 8] and out[9][2] == 6


def presence_log(spark, rows):
    return spark.createDataFrame([(u, at(s), i, d) for i, (u, s, d) in enumerate(rows)],
                                 "user_id long, ts timestamp, event_id long, delta int")


def test_two_tabs_do_not_flicker(spark):
    df = presence_log(spark, [(1, 0, 1), (1, 1, 1), (1, 2, -1), (1, 3, -1)])
    edges = presence.presence_edges(df)
    assert pairs(edges, "event_id", "online") == [(0, True), (3, False)]


@pytest.mark.parametrize("limit", [10_000, 15])
def test_presence_matches_a_counter(spark, limit):
    rng = random.Random(1)
    rows = [(rng.randrange(2), i, rng.choice([1, -1, -1, 1])) for i in range(120)]
    spans, count, since = [], {0: 0, 1: 0}, {}
    for user, sec, delta in rows:
        before, count[user] = count[user], max(0, count[user] + delta)
        if (before, count[user]) == (0, 1):
            since[user] = at(sec)
        elif (before, count[user]) == (1, 0):
            spans.append((user, since.pop(user), at(sec)))
    spans += [(u, t, None) for u, t in since.items()]
    df = presence_log(spark, rows)
    got = presence.presence_intervals(df, max_group_rows=limit)
    assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, spans))
    online = {u for u, a, b in spans if b is None}
    assert {r.user_id for r in presence.online_snapshot(df, at(500)).collect()} == online


def test_typing(spark):
    rows = [(1, 0.0, False), (1, 1.0, False), (1, 2.5, True), (1, 3.0, False), (1, 6.0, False),
            (1, 10.0, True), (1, 11.0, True)]
    df = spark.createDataFrame([(u, at(s), i, stop) for i, (u, s, stop) in enumerate(rows)],
                               "user_id long, ts timestamp, event_id long, is_stop boolean")
    for limit in (10_000, 2):
        got = presence.typing_sessions(df, max_group_rows=limit)
        assert pairs(got, "started_at", "ended_at") == [
            (at(0), at(2.5)), (at(3), at(6)), (at(6), at(9))]


def test_invite_ceiling_and_revocation(spark):
    tries = [(1, "a", 7, 0), (2, "a", 7, 1), (3, "a", 8, 2), (4, "a", 7, 3), (5, "a", 9, 4),
             (6, "b", 7, 0), (7, "b", 8, 6), (8, "c", 7, 99)]
    attempts = spark.createDataFrame([(i, v, u, at(s)) for i, v, u, s in tries],
                                     "attempt_id long, invite_id string, user_id long, "
                                     "attempted_at timestamp")
    invites = spark.createDataFrame([("a", 2, at(50), None), ("b", 5, at(50), at(5)),
                                     ("c", 5, at(50), None)],
                                    "invite_id string, max_redemptions int, "
                                    "expires_at timestamp, revoked_at timestamp")
    for limit in (10_000, 1):
        got = presence.invite_redemption(attempts, invites, max_group_rows=limit)
        assert dict(pairs(got, "attempt_id", "outcome")) == {
            1: "accepted", 2: "member", 3: "accepted", 4: "invalid", 5: "invalid",
            6: "accepted", 7: "invalid", 8: "invalid"}


def one_by_one(tries, invites, members, joined, limit):
    """Attempts served in order: the source system's walk."""
    used, rooms, inside, out = Counter(), Counter(joined), set(members), {}
    for n, invite, user, moment in sorted(tries, key=lambda t: (t[3], t[0])):
        room, places, closes = invites[invite]
        if moment >= closes or used[invite] >= places:
            out[n] = "invalid"
        elif (user, room) in inside:
            out[n] = "member"
        elif rooms[user] >= limit:
            out[n] = "room_limit"
        else:
            out[n] = "accepted"
            used[invite] += 1
            rooms[user] += 1
            inside.add((user, room))
    return out


@pytest.mark.parametrize("seed,bounds", [(0, {}), (1, {}), (2, {"max_group_rows": 5}), (3, {}), (4, {})])
def test_places_of_invites_and_rooms_of_users_bind_each_other(spark, seed, bounds):
    rng = random.Random(seed)
    count = rng.choice([3, 12, 30])
    invites = {i: (i % rng.choice([2, 5, 9]), rng.randint(0, 6), rng.choice([30, 300, 300]))
               for i in range(count)}
    hot = rng.randrange(count)
    tries = [(n, hot if rng.random() < .3 else rng.randrange(count), rng.randrange(25),
              rng.randrange(200)) for n in range(300)]
    members = {(u, rng.randrange(9)) for u in range(6)}
    joined = {u: rng.randint(0, 3) for u in range(12)}
    rooms = {}
    for i, (room, _, _) in invites.items():
        rooms.setdefault(room, i)
    got = presence.invite_redemption(
        spark.createDataFrame([(n, i, u, at(t)) for n, i, u, t in tries],
                              "attempt_id int, invite_id int, user_id int, attempted_at timestamp"),
        spark.createDataFrame([(i, room, places, at(closes), None) for i, (room, places, closes)
                               in invites.items()],
                              "invite_id int, room_id int, max_redemptions int, "
                              "expires_at timestamp, revoked_at timestamp"),
        spark.createDataFrame([(rooms[r], u) for u, r in members if r in rooms] or [(-1, -1)],
                              "invite_id int, user_id int"),
        joined=spark.createDataFrame(list(joined.items()), "user_id int, rooms int"),
        room_limit=3, **bounds)
    assert dict(pairs(got, "attempt_id", "outcome")) == one_by_one(tries, invites, members, joined, 3)


def test_rate_limit_fixture(spark):
    times = [0, .1, .2, .3, .4, .5, .6, 2.8]
    df = spark.createDataFrame([(1, i, at(t)) for i, t in enumerate(times)],
                               "user_id long, event_id long, ts timestamp")
    got = dict(pairs(limits.rate_limit(df, (5, 10, 2)), "event_id", "allowed"))
    assert [got[i] for i in range(8)] == [True] * 5 + [False] * 2 + [True]
    got = limits.rate_limit(df.where("event_id < 4"), (3, 10, 5))
    assert pairs(got, "event_id", "allowed", "retry_after")[-1] == (3, False, 5)


def test_rate_limit_matches_one_machine_per_key(spark):
    rng = random.Random(2)
    rows, now = [], 0
    for i in range(600):
        now += rng.choice([1, 1, 2, 3, 40])
        rows.append((0 if rng.random() < .9 else 1, i, at(now)))
    machines, want = {}, []
    for user, i, ts in rows:
        m = machines.setdefault(user, limits.SlidingWindow(4, 10_000_000, 15_000_000))
        want.append((i, *m.offer(int(ts.timestamp() * 1e6))))
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
    for limit, walk in ((10_000, 10_000), (50, 10_000), (10_000, 25), (10_000, 3)):
        got = limits.rate_limit(df, (4, 10, 15), max_walk_rows=walk, max_group_rows=limit)
        assert pairs(got, "event_id", "allowed", "retry_after") == want


def test_rate_limit_of_a_key_that_never_pauses(spark):
    rng = random.Random(9)
    for rate in ((3, 10, 4), (2, 5, 9), (1, 3, 3)):
        now, rows = 0, []
        for i in range(250):
            now += rng.choice([0, 0, 1, 1, 2, 4])
            rows.append((0, i, at(now)))
        machine = limits.SlidingWindow(rate[0], rate[1] * 10**6, rate[2] * 10**6)
        want = [(i, *machine.offer(int(ts.timestamp() * 1e6))) for _, i, ts in rows]
        df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp")
        got = limits.rate_limit(df, rate, max_walk_rows=17)
        assert pairs(got, "event_id", "allowed", "retry_after") == want


def plain_breaker(rows, threshold, window, cooldown):
    """Openings by the rule itself: all failures of the window are kept."""
    failures, until, out = {}, {}, []
    for provider, i, ok, ts in rows:
        now = int(ts.timestamp())
        held = [] if ok else [t for t in failures.get(provider, []) if now - t < window] + [now]
        if not ok and len(held) >= threshold and now >= until.get(provider, 0):
            until[provider], held = now + cooldown, []
            out.append((i,))
        failures[provider] = held
    return out


@pytest.mark.parametrize("seed,threshold,share", [(4, 3, .3), (5, 1, .3), (6, 5, .02), (7, 2, 0)])
def test_breaker_matches_one_machine(spark, seed, threshold, share):
    rng = random.Random(seed)
    rows, now = [], 0
    for i in range(500):
        now += rng.choice([0, 1, 1, 5, 10, 30])
        rows.append((rng.choice("ppppq"), i, rng.random() < share, at(now)))
    want = plain_breaker(rows, threshold, 60, 30)
    df = spark.createDataFrame(rows, "provider string, stream_id long, ok boolean, "
                                     "created_at timestamp")
    for how in ({}, {"max_group_rows": 50}, {"max_walk_rows": 7, "max_group_rows": 100}):
        got = limits.breaker_windows(df, threshold, 60, 30, **how)
        assert want and pairs(got, "stream_id") == want


def test_memory_switch(spark):
    msgs = spark.createDataFrame([(i, 0, at(i)) for i in range(4)] + [(9, 1, at(0))],
                                 "message_id long, room_id long, created_at timestamp")
    def switches(*rows):
        return spark.createDataFrame([(0, at(s), i, e) for i, (s, e) in enumerate(rows)],
                                     "room_id long, switched_at timestamp, switch_id long, "
                                     "enabled boolean")
    off = memory_switch_asof(msgs, switches((1.5, False)))
    assert pairs(off.where("ingested"), "message_id") == [(0,), (1,), (9,)]
    assert pairs(off.where("visible"), "message_id") == [(9,)]
    on = memory_switch_asof(msgs, switches((1.5, False), (2.5, True)))
    assert pairs(on.where("visible"), "message_id") == [(0,), (1,), (3,), (9,)]


def test_retries_end_in_the_dead_letter_table(spark):
    df = spark.createDataFrame([(1, 3), (2, 4)], "id int, attempts int")
    again, buried = retry_or_bury(df)
    assert (pairs(again, "id"), pairs(buried, "id", "attempts")) == ([(1,)], [(2, 5)])


def test_invites_know_members_full_users_and_earlier_redemptions(spark):
    tries = [(1, "i", 1), (2, "i", 2), (3, "i", 3), (4, "i", 4), (5, "i", 1), (6, "i", 5),
             (7, "i", 1), (8, "gone", 9)]
    attempts = spark.createDataFrame([(n, i, u, at(n)) for n, i, u in tries],
                                     "attempt_id int, invite_id string, user_id int, "
                                     "attempted_at timestamp")
    invites = spark.createDataFrame(
        [("i", 10, 8, at(99), None), ("gone", 3, 3, at(99), None)],
        "invite_id string, max_redemptions int, used int, expires_at timestamp, "
        "revoked_at timestamp")
    members = spark.createDataFrame([("i", 1)], "invite_id string, user_id int")
    stuck = spark.createDataFrame([(2,)], "user_id int")
    got = presence.invite_redemption(attempts, invites, members, stuck)
    assert pairs(got, "attempt_id", "outcome") == [
        (1, "member"), (2, "room_limit"), (3, "accepted"), (4, "accepted"), (5, "invalid"),
        (6, "invalid"), (7, "invalid"), (8, "invalid")]
