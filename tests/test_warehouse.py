import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from conftest import pairs
from threadlake.operators import metrics, sketches, star
from threadlake.operators.dedup import dedup_any, dedup_latest
from threadlake.operators.ordered import nearest_rank
from threadlake.plans.warehouse import (
    REPORTS, refresh_messages, run_all_reports, run_warehouse,
)
from threadlake.schemas import GOLD_TABLES, bronze_schema, conform
from threadlake.sources import bronze, feedback, gold
from threadlake.sources.golden import read_golden

MESSAGES = ("id string, roomId string, senderId string, body string, kind string, "
            "citations string, aiQuestion string, createdAt string, updatedAt string")
AT = "2025-06-01T10:00:00+00:00"


def messages(spark):
    return spark.createDataFrame([
        ("m1", "r1", "u1", "hello world foo", "user", None, None, AT, AT),
        ("m2", "r1", "u2", "the decision was made", "ai", '[{"messageId":"m1"}]',
         "what was decided?", "2025-06-01T11:00:00+00:00", "2025-06-01T11:00:00+00:00"),
        ("m3", "r1", "u1", "", None, "oops", None, "bad stamp", None),
        ("m4", "r2", "u9", "naïve 😀", None, "{}", None, AT, AT),
    ], MESSAGES)


def test_message_metrics(spark):
    fact = star.fact_message(messages(spark))
    assert "body" not in fact.columns
    got = {r.message_id: r for r in fact.collect()}
    m1, m2, m3, m4 = (got[f"m{i}"] for i in range(1, 5))
    assert (m1.word_count, m1.is_ai_answer, m1.has_citations, m1.citation_count) == (
        3, False, False, 0)
    assert (m2.is_ai_answer, m2.has_citations, m2.citation_count, m2.has_ai_question) == (
        True, True, 1, True)
    assert (m3.is_ai_answer, m3.created_at, m3.date_key, m3.word_count, m3.citation_count) == (
        None, None, None, 1, 0)
    assert (m4.body_length, m4.date_key) == (7, 20250601)
    assert "body" in star.fact_message(messages(spark), include_text=True).columns


def test_missing_optional_columns(spark):
    fact = star.fact_message(messages(spark).drop("citations", "aiQuestion"))
    assert {(r.has_citations, r.citation_count, r.has_ai_question) for r in fact.collect()} == {
        (False, 0, False)}


def test_latest_version_wins(spark):
    df = spark.createDataFrame([("x", "old", "2025-01-01"), ("x", "new", "2025-02-01"),
                                ("y", "a", None), ("y", "b", "2024-01-01"),
                                ("z", "p", "2025-01-01"), ("z", "q", "2025-01-01")],
                               "id string, v string, updatedAt string")
    assert pairs(dedup_latest(df), "id", "v") == [("x", "new"), ("y", "b"), ("z", "q")]
    plain = df.drop("updatedAt")
    assert pairs(dedup_latest(plain), "id", "v") == pairs(dedup_any(plain), "id", "v") == [
        ("x", "new"), ("y", "a"), ("z", "p")]


def test_room_defaults(spark):
    rooms = spark.createDataFrame(
        [("r1", "general", "general", None, None, AT, AT)],
        "id string, name string, slug string, isDM boolean, aiEnabled boolean, "
        "createdAt string, updatedAt string")
    row = star.dim_room(rooms).first()
    assert (row.is_dm, row.ai_enabled, row.creator_user_id) == (False, True, None)


def test_call_defaults_and_verdicts(spark):
    calls = conform(spark.createDataFrame(
        [("c1", "s1", None, None, AT, AT), ("c2", "s2", "down", 7, AT, AT)],
        "id string, streamId string, verdict string, tokensIn int, createdAt string, "
        "updatedAt string"), bronze_schema("aicalls"))
    got = {r.stream_id: r for r in star.fact_ai_call(calls).collect()}
    assert (got["s1"].total_tokens, got["s1"].cached, got["s1"].ok, got["s1"].is_thumbs_up,
            got["s1"].is_thumbs_down) == (0, False, True, False, False)
    assert (got["s2"].total_tokens, got["s2"].is_thumbs_up, got["s2"].is_thumbs_down) == (
        7, False, True)


def test_rollup_ignores_unknown_kind_but_counts_the_row(spark):
    daily = star.room_activity_daily(star.fact_message(messages(spark)))
    got = {(r.room_id, r.date_key): (r.message_count, r.ai_answer_count,
                                     r.distinct_sender_count) for r in daily.collect()}
    assert got[("r1", 20250601)] == (2, 1, 2)
    assert got[("r2", 20250601)] == (1, None, 1)
    assert got[("r1", None)] == (1, None, 1)


def test_calendar_is_contiguous_and_may_be_empty(spark):
    facts = spark.createDataFrame([(dt.datetime(2025, 1, 30, 5),), (dt.datetime(2025, 2, 2),)],
                                  "created_at timestamp")
    days = star.dim_date(facts, facts.limit(0))
    assert [r.date_key for r in days.orderBy("date_key").collect()] == [
        20250130, 20250131, 20250201, 20250202]
    saturday = days.where("date_key = 20250201").first()
    assert (saturday.day_of_week, saturday.day_name, saturday.is_weekend,
            saturday.month_name) == (7, "Saturday", True, "February")
    assert star.dim_date(facts.limit(0)).count() == 0


def test_active_rooms_merges_names_and_takes_the_peak(spark):
    daily = spark.createDataFrame([("r1", 20250601, 5, 1, 3, 9), ("r2", 20250602, 2, None, 7, 4),
                                   ("r1", 20250401, 99, 9, 9, 9), ("rX", 20250601, 9, 9, 9, 9),
                                   ("r1", None, 50, 1, 1, 1)],
                                  "room_id string, date_key int, message_count long, "
                                  "ai_answer_count long, distinct_sender_count long, "
                                  "total_words long")
    rooms = spark.createDataFrame([("r1", "a", False, True), ("r2", "a", False, True)],
                                  "room_id string, name string, is_dm boolean, "
                                  "ai_enabled boolean")
    days = spark.createDataFrame([(20250401, dt.date(2025, 4, 1)), (20250601, dt.date(2025, 6, 1)),
                                  (20250602, dt.date(2025, 6, 2))], "date_key int, date date")
    rows = star.active_rooms(daily, rooms, days, "2025-06-10").collect()
    assert [tuple(r) for r in rows] == [("a", False, True, 7, 1, 7)]


def test_incremental_extract(spark, folder):
    def source(rows):
        return spark.createDataFrame(
            [(i, n, dt.datetime(2025, 1, d), "hash") for i, n, d in rows],
            "_id string, username string, updatedAt timestamp, passwordHash string")

    marks = {}
    first = bronze.extract_collection(source([("a", "x", 1), ("b", "y", 2)]), "users", folder,
                                      marks)
    assert first.rows == 2 and marks["users"] == dt.datetime(2025, 1, 2)
    # strictly newer rows only; the row at the watermark itself is not read again
    again = bronze.extract_collection(source([("b", "y2", 2), ("a", "x2", 3)]), "users", folder,
                                      marks)
    assert again.rows == 1 and marks["users"] == dt.datetime(2025, 1, 3)
    none = bronze.extract_collection(source([("a", "x2", 3)]), "users", folder, marks)
    assert none.rows == 0 and marks["users"] == dt.datetime(2025, 1, 3)
    incl = bronze.changed_since(source([("a", "x2", 3)]), "updatedAt", marks["users"], True)
    assert incl.count() == 1
    stored = bronze.read_bronze(spark, folder, "users")
    assert "passwordHash" not in spark.read.parquet(f"{folder}/users").columns
    assert pairs(stored, "id", "username") == [("a", "x"), ("a", "x2"), ("b", "y")]
    assert pairs(star.dim_user(stored), "user_id", "username") == [("a", "x2"), ("b", "y")]
    assert stored.where("username = 'x'").first()["updatedAt"].startswith("2025-01-01T00:00:00")


def test_watermark_table(spark, folder):
    table = bronze.WatermarkTable(spark, f"{folder}/marks")
    assert table.load() == {}
    table.save({"users": dt.datetime(2025, 1, 1)})
    table.save({"users": dt.datetime(2025, 1, 2), "rooms": dt.datetime(2024, 1, 1)})
    assert table.load() == {"users": dt.datetime(2025, 1, 2), "rooms": dt.datetime(2024, 1, 1)}
    os.makedirs(f"{folder}/broken")
    with open(f"{folder}/broken/part.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # not taken for a first run, which would overwrite bronze
        bronze.WatermarkTable(spark, f"{folder}/broken").load()
    table.save({"users": dt.datetime(2024, 6, 1)})  # the source was set back
    assert table.load()["users"] == dt.datetime(2024, 6, 1)


def test_extract_casts_to_the_schema(spark, folder):
    calls = spark.createDataFrame([("1", 7, 120, dt.datetime(2025, 1, 1))],
                                  "_id string, tokensIn bigint, latencyMs bigint, "
                                  "updatedAt timestamp")
    bronze.extract_collection(calls, "aicalls", folder, {})
    stored = bronze.read_bronze(spark, folder, "aicalls").first()
    assert (stored["tokensIn"], stored["latencyMs"]) == (7, 120)


def test_warehouse_end_to_end(spark, folder):
    root = f"{folder}/bronze"
    messages(spark).write.parquet(f"{root}/messages")
    for name in ("users", "rooms", "aicalls"):
        spark.createDataFrame([], bronze_schema(name)).write.parquet(f"{root}/{name}")
    counts = run_warehouse(spark, root, f"{folder}/gold")
    assert counts["fact_message"] == 4 and counts["dim_date"] == 1
    assert gold.register_gold(spark, f"{folder}/gold") == list(GOLD_TABLES)
    reports = run_all_reports(spark, f"{folder}/gold", "2025-06-10")
    assert set(reports) == set(REPORTS) and all(r.count() == 0 for r in reports.values())
    plan = spark.read.parquet(f"{folder}/gold/fact_message").where(
        "date_key = 20250601").select("message_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date_key" in plan


def test_missing_gold_tables_are_skipped(spark, folder):
    spark.range(1).write.parquet(f"{folder}/dim_user")
    assert gold.register_gold(spark, folder) == ["dim_user"]


def calls(spark):
    rows = [(1, "u", "mock-chat-1", 100, 10, 5, False, True, "up", dt.datetime(2025, 1, 2), "a"),
            (2, "u", "gpt-4o-mini", 1000, 100, 9, False, True, None, dt.datetime(2025, 1, 2), "a"),
            (3, "u", "gpt-4o-mini", 1000, 100, 1, True, True, "down", dt.datetime(2025, 1, 2),
             "b"),
            (4, "u", "other", 7, 7, 7, False, False, None, dt.datetime(2025, 1, 2), "b"),
            (5, "u", "other", 7, 7, 7, False, True, None, dt.datetime(2024, 1, 2), "b")]
    return spark.createDataFrame(
        rows, "stream_id long, user_id string, model string, tokens_in int, tokens_out int, "
              "latency_ms int, cached boolean, ok boolean, verdict string, "
              "created_at timestamp, kind string")


def test_call_metrics(spark):
    row = metrics.ai_call_metrics(calls(spark), dt.datetime(2025, 1, 3)).first()
    assert (row.requests, row.answers, row.cache_hits, row.failures) == (4, 2, 1, 1)
    assert (row.latency_p50, row.latency_p95) == (5, 9)
    assert row.total_cost == round(1000 * 0.15 / 1e6 + 100 * 0.6 / 1e6, 6)
    assert row.cost_saved == row.total_cost and row.hit_rate_pct == 25.0


def test_quota_first_call_may_overshoot(spark):
    rows = calls(spark).withColumn("tokens", F.lit(6))
    got = pairs(metrics.quota_decisions(rows.where("stream_id < 3"), 5), "stream_id", "allowed")
    assert got == [(1, True), (2, False)]
    assert metrics.daily_token_usage(rows, 5).where("remaining <> 0").count() == 0
    cut = metrics.quota_decisions(rows, 13, max_group_rows=2)
    assert pairs(cut, "stream_id", "allowed") == pairs(
        metrics.quota_decisions(rows, 13), "stream_id", "allowed")


def test_ceiling(spark):
    assert pairs(metrics.ceiling_audit(calls(spark), "user_id", 5), "user_id", "owned") == [
        ("u", 5)]
    assert metrics.ceiling_audit(calls(spark), "user_id", 6).count() == 0


def test_feedback_export_keeps_newest(spark, folder):
    rows = calls(spark).withColumns({"question": F.lit("q"), "answer": F.lit("a"),
                                     "source_keys": F.lit("[]"), "provider": F.lit("p")})
    path = feedback.export_feedback(rows, f"{folder}/out", cap=1)
    assert [r.stream_id for r in feedback.read_feedback(spark, path).collect()] == [3]


def test_golden_reader(spark, folder):
    with open(f"{folder}/g.json", "w") as f:
        f.write('{"items":[{"question":"q0","expect":[{"room":"r","contains":"c"},'
                '{"room":"r","contains":"d","kind":"doc"}]},\n{"question":"q1","expect":[]}]}')
    rows = read_golden(spark, f"{folder}/g.json")
    assert pairs(rows, "query_id", "anchor_id", "contains") == [(0, 0, "c"), (0, 1, "d")]
    assert [r.kind for r in rows.orderBy("anchor_id").collect()] == [None, "doc"]


def message_rows(spark, rows):
    """Bronze versions from (id, day, sender, updated)."""
    return spark.createDataFrame(
        [(str(i), "r", str(sender), f"body {i}", f"2025-06-{day:02d}T10:00:00+00:00",
          f"2025-06-{upd:02d}T11:00:00+00:00") for i, day, sender, upd in rows],
        "id string, roomId string, senderId string, body string, createdAt string, updatedAt string")


def test_only_touched_days_are_rewritten(spark, folder):
    bronze_root, gold_root = f"{folder}/bronze", f"{folder}/gold"
    for name in ("users", "rooms", "aicalls"):
        spark.createDataFrame([], bronze_schema(name)).write.parquet(f"{bronze_root}/{name}")
    first = [(1, 1, 7, 1), (2, 1, 8, 1), (3, 2, 7, 2), (4, 3, 7, 3), (5, 4, 9, 4)]
    message_rows(spark, first).write.parquet(f"{bronze_root}/messages")
    run_warehouse(spark, bronze_root, gold_root)

    def files(table):
        return {d: sorted(os.listdir(f"{gold_root}/{table}/{d}"))
                for d in os.listdir(f"{gold_root}/{table}") if d.startswith("date_key")}

    before = {t: files(t) for t in ("fact_message", "fact_room_activity_daily")}
    # edited in place, moved to another day, the only one of its day moved away, a new one
    later = [(1, 1, 8, 20), (2, 2, 8, 20), (4, 9, 7, 20), (6, 2, 5, 20)]
    message_rows(spark, later).write.mode("append").parquet(f"{bronze_root}/messages")
    days = refresh_messages(spark, bronze_root, gold_root,
                            message_rows(spark, later).select("id"))
    assert days == [20250601, 20250602, 20250603, 20250609]
    after = {t: files(t) for t in before}
    for table in before:
        assert set(after[table]) == {f"date_key={d}" for d in (20250601, 20250602, 20250604, 20250609)}
        assert after[table]["date_key=20250604"] == before[table]["date_key=20250604"]
    run_warehouse(spark, bronze_root, f"{folder}/again")
    for table in ("fact_message", "fact_room_activity_daily", "dim_date"):
        columns = sorted(gold.read_gold(spark, gold_root, table).columns)
        one, two = (pairs(gold.read_gold(spark, root, table).select(*columns).na.fill(0).na.fill("-"), *columns)
                    for root in (gold_root, f"{folder}/again"))
        assert one == two
    assert refresh_messages(spark, bronze_root, gold_root, message_rows(spark, later).select("id").limit(0)) == []


def test_merged_sketches_keep_their_rank_error(spark):
    rows = spark.range(40_000).selectExpr(
        "id % 3 AS kind", "id % 11 AS day", "CASE WHEN id % 50 = 0 THEN NULL ELSE "
        "CAST(pow(xxhash64(id) % 1000, 2) AS INT) END AS ms")
    percents = {"p1": 1, "p50": 50, "p95": 95, "p100": 100}
    days = sketches.daily_sketches(rows, ["kind"], "day", "ms")
    assert days.count() == 33
    found = sketches.merged_percentiles(days, ["kind"], percents)
    assert found.agg(F.sum("n")).first()[0] == rows.where("ms IS NOT NULL").count()
    off = sketches.rank_error(rows, ["kind"], "ms", found, percents).collect()
    assert len(off) == 3 and all(r[p] <= 2 * sketches.RANK_ERROR for r in off for p in percents)
    exact = nearest_rank(rows.where("ms IS NOT NULL"), ["kind"], "ms", percents)
    off = sketches.rank_error(rows, ["kind"], "ms", exact, percents).collect()
    assert all(r[p] < 1e-3 for r in off for p in percents)
    part = sketches.merged_percentiles(days.where("day < 3"), ["kind"], percents)  # without the facts
    off = sketches.rank_error(rows.where("day < 3"), ["kind"], "ms", part, percents).collect()
    assert all(r[p] <= 2 * sketches.RANK_ERROR for r in off for p in percents)
