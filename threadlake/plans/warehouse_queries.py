"""Registered queries: sources, sinks, star schema, reports, call metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadlake.constants import PRICES
from threadlake.operators import metrics, sketches, star
from threadlake.operators.dedup import (
    dedup_any, dedup_latest, reconcile_by_either_key, resolve_retries,
)
from threadlake.plans import bindings as b
from threadlake.plans import warehouse
from threadlake.plans.registry import query
from threadlake.plans.warehouse import REPORTS, run_report
from threadlake.session import scratch_path
from threadlake.sources import bronze, feedback, gold
from threadlake.sources.golden import read_golden

AS_OF = "2024-02-10"


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _date(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


# --- sources and sinks -------------------------------------------------------------------

@query("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in b.TABLES))
def table_row_counts(spark, sf):
    return gold.table_row_counts({t: b.table(spark, sf, t) for t in b.TABLES})


@query("read_bronze", f"""
    SELECT event_id, {_time('ts')} AS ts, user_id, event_type, value, props,
           CAST(NULL AS VARCHAR) AS note FROM events""")
def read_bronze(spark, sf):
    """Explicit schema with one column the file lacks: it reads as null."""
    schema = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string, note string")
    return spark.read.schema(schema).parquet(f"{sf}/events.parquet")


_BRONZE_MESSAGES = """
    SELECT CAST(message_id AS VARCHAR) AS id, CAST(room_id AS VARCHAR) AS "roomId",
           CAST(sender_id AS VARCHAR) AS "senderId", body, kind, citations,
           strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS "createdAt",
           strftime(created_at + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS "updatedAt"
    FROM b_messages"""


@query("read_bronze_versions", f"""
    SELECT id, "roomId", "senderId", 'draft' AS body, 'ai' AS kind, CAST(NULL AS VARCHAR) AS citations,
           "createdAt", "createdAt" AS "updatedAt"
    FROM ({_BRONZE_MESSAGES}) WHERE body LIKE 'purchase%'
    UNION ALL SELECT * FROM ({_BRONZE_MESSAGES})""")
def read_bronze_versions(spark, sf):
    """A bronze folder of two snapshots, the older without some columns, read by the explicit schema."""
    root, versions = scratch_path(spark, "bronze"), b.bronze_messages(spark, sf)
    draft = F.col("body") == "draft"
    versions.where(draft).drop("citations", "aiQuestion").write.parquet(f"{root}/messages")
    versions.where(~draft).write.mode("append").parquet(f"{root}/messages")
    return bronze.read_bronze(spark, root, "messages").select(
        "id", "roomId", "senderId", "body", "kind", "citations", "createdAt", "updatedAt")


def _sources(spark, sf, until=None):
    """Messages as the source system holds them at a moment: those created before it, with the edits
    made before it. Every message is edited a week later, and moved by three days if its id divides
    by seven."""
    created = F.col("created_at")
    edited = created + F.expr("INTERVAL 7 DAYS")
    now = F.lit(until or dt.datetime(2100, 1, 1)).cast("timestamp")
    moved = F.when((edited < now) & (F.col("message_id") % 7 == 0), created - F.expr("INTERVAL 3 DAYS"))
    return b.messages(spark, sf).where(created < now).select(
        F.col("message_id").cast("string").alias("_id"), F.col("room_id").cast("string").alias("roomId"),
        F.col("sender_id").cast("string").alias("senderId"), F.lit("secret").alias("passwordHash"),
        F.when(edited < now, F.concat("body", F.lit(" edited"))).otherwise(F.col("body")).alias("body"),
        F.col("client_msg_id").alias("clientMsgId"), "kind", "citations",
        F.col("ai_question").alias("aiQuestion"), F.coalesce(moved, created).alias("createdAt"),
        F.when(edited < now, edited).otherwise(created).alias("updatedAt"))


_CUT = dt.datetime(2024, 1, 20)
_SOURCE_NOW = """
    SELECT message_id, room_id, sender_id, kind, citations, ai_question, body || ' edited' AS body,
           created_at - CASE WHEN message_id % 7 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END
             AS created_at FROM b_messages"""


def _extract_twice(spark, sf):
    """Bronze after a full extract in the middle of the month and an incremental one at the end."""
    root = scratch_path(spark, "extract")
    marks = bronze.WatermarkTable(spark, f"{root}/marks")
    results = []
    for until in (_CUT, None):
        known = marks.load()
        results.append(bronze.extract_collection(
            _sources(spark, sf, until), "messages", f"{root}/bronze", known))
        marks.save(known)
    return f"{root}/bronze", results, marks.load()["messages"]


@query("extract_twice", f"""
    SELECT count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-20') AS first_rows,
           count(*) FILTER (WHERE created_at + INTERVAL 7 DAY > (
             SELECT max(CASE WHEN created_at + INTERVAL 7 DAY < TIMESTAMP '2024-01-20'
                        THEN created_at + INTERVAL 7 DAY ELSE created_at END)
             FROM b_messages WHERE created_at < TIMESTAMP '2024-01-20')) AS second_rows,
           {_time('max(created_at) + INTERVAL 7 DAY')} AS watermark,
           (SELECT count(*) FROM b_messages WHERE created_at < TIMESTAMP '2024-01-20')
             + second_rows AS stored, count(*) AS messages
    FROM b_messages""")
def extract_twice(spark, sf):
    """Rows extracted by a full and an incremental run, the watermark kept, the versions in bronze."""
    root, (first, second), mark = _extract_twice(spark, sf)
    return bronze.read_bronze(spark, root, "messages").agg(
        F.lit(first.rows).cast("bigint").alias("first_rows"),
        F.lit(second.rows).cast("bigint").alias("second_rows"),
        F.date_format(F.lit(mark), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("watermark"),
        F.count(F.lit(1)).alias("stored"), F.countDistinct("id").alias("messages"))


@query("gold_upkeep", f"""
    WITH now AS ({_SOURCE_NOW})
    SELECT room_id::VARCHAR AS room_id, CAST(strftime(created_at, '%Y%m%d') AS INTEGER) AS date_key,
           count(*) AS message_count,
           count(*) FILTER (WHERE kind = 'ai') AS ai_answer_count,
           count(DISTINCT sender_id) AS distinct_sender_count,
           CAST(sum(len(regexp_split_to_array(trim(body), '\\s+'))) AS BIGINT) AS total_words
    FROM now GROUP BY 1, 2""")
def gold_upkeep(spark, sf):
    """Gold of the first extract, brought up to date by the days that the second one touches."""
    root = scratch_path(spark, "upkeep")
    bronze_root, gold_root = f"{root}/bronze", f"{root}/gold"
    marks: dict = {}
    bronze.extract_collection(_sources(spark, sf, _CUT), "messages", bronze_root, marks)
    b.bronze_ai_calls(spark, sf).write.parquet(f"{bronze_root}/aicalls")
    b.bronze_users(spark, sf).write.parquet(f"{bronze_root}/users")
    b.bronze_rooms(spark, sf).write.parquet(f"{bronze_root}/rooms")
    warehouse.run_warehouse(spark, bronze_root, gold_root)
    known = marks["messages"]
    later = _sources(spark, sf)
    bronze.extract_collection(later, "messages", bronze_root, marks)
    changed = bronze.changed_since(later, "updatedAt", known).select(F.col("_id").alias("id"))
    warehouse.refresh_messages(spark, bronze_root, gold_root, changed)
    return gold.read_gold(spark, gold_root, "fact_room_activity_daily").select(
        "room_id", "date_key", "message_count", "ai_answer_count", "distinct_sender_count", "total_words")


@query("gold_catalog", """
    SELECT 'dim_date' AS table_name, (SELECT count(*) FROM g_date) AS row_count
    UNION ALL SELECT 'dim_user', (SELECT count(*) FROM customer)
    UNION ALL SELECT 'dim_room', (SELECT count(*) FROM region)
    UNION ALL SELECT 'fact_message', (SELECT count(*) FROM events)
    UNION ALL SELECT 'fact_ai_call', (SELECT count(*) FROM events)
    UNION ALL SELECT 'fact_room_activity_daily', (SELECT count(*) FROM g_daily)""")
def gold_catalog(spark, sf):
    """The whole warehouse written, its tables found in the catalog and counted."""
    root = scratch_path(spark, "catalog")
    for name, rows in (("messages", b.bronze_messages(spark, sf)), ("users", b.bronze_users(spark, sf)),
                       ("rooms", b.bronze_rooms(spark, sf)), ("aicalls", b.bronze_ai_calls(spark, sf))):
        rows.write.parquet(f"{root}/bronze/{name}")
    warehouse.run_warehouse(spark, f"{root}/bronze", f"{root}/gold")
    found = gold.register_gold(spark, f"{root}/gold")
    return gold.table_row_counts({name: spark.table(name) for name in found})


@query("golden_set", """
    SELECT item_id AS query_id, text AS question, CAST(n AS INTEGER) AS anchor_id,
           'room-' || (item_id % 5) AS room, substr(text, 1 + 20 * n, 20) AS contains,
           CASE n WHEN 1 THEN 'doc' END AS kind
    FROM benchmark, (SELECT unnest([0, 1]) AS n)""")
def golden_set(spark, sf):
    """Every benchmark passage as a golden question with two anchors, written as the set's JSON."""
    path = scratch_path(spark, "golden")
    room = F.concat(F.lit("room-"), (F.col("item_id") % 5).cast("string"))
    anchors = F.array(*[F.struct(
        room.alias("room"), F.substring("text", 1 + 20 * n, 20).alias("contains"),
        F.lit(kind).cast("string").alias("kind")) for n, kind in ((0, None), (1, "doc"))])
    items = b.table(spark, sf, "benchmark").agg(F.array_sort(F.collect_list(F.struct(
        "item_id", F.col("text").alias("question"), anchors.alias("expect")))).alias("items"))
    items.coalesce(1).write.json(path)
    return read_golden(spark, path).withColumn("query_id", F.col("query_id").cast("bigint"))


@query("latency_sketches", """
    SELECT kind, count(*) AS calls, true AS p50_close, true AS p95_close FROM b_ai_calls GROUP BY kind""")
def latency_sketches(spark, sf):
    """Latency percentiles by kind from daily sketches: whether their ranks are as near as promised."""
    calls = b.ai_calls(spark, sf).withColumn("day", F.to_date("created_at"))
    percents = {"p50": 50, "p95": 95}
    found = sketches.merged_percentiles(sketches.daily_sketches(calls, ["kind"], "day", "latency_ms"),
                                        ["kind"], percents)
    off = sketches.rank_error(calls, ["kind"], "latency_ms", found, percents)
    return found.select("kind", F.col("n").alias("calls")).join(off, "kind").select(
        "kind", "calls", *[(F.col(p) <= 2 * sketches.RANK_ERROR).alias(f"{p}_close") for p in percents])


@query("incremental_extract", f"""
    SELECT count(*) AS extracted, {_time('max(l_shipdate)')} AS watermark
    FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-01-01'""")
def incremental_extract(spark, sf):
    mark = dt.datetime(2000, 1, 1)
    changed = bronze.changed_since(b.table(spark, sf, "lineitem"), "l_shipdate", mark)
    return bronze.next_watermark(changed, "l_shipdate", mark)


@query("append_merge_bronze", """
    SELECT event_id, user_id, event_type, CAST(NULL AS DOUBLE) AS value, props
    FROM events WHERE ts < TIMESTAMP '2024-01-15'
    UNION ALL BY NAME
    SELECT event_id, user_id, value, props, event_type
    FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def append_merge_bronze(spark, sf):
    """Two snapshots, split in time; the older one does not know ``value`` yet."""
    events = b.table(spark, sf, "events")
    cut = F.lit(dt.datetime(2024, 1, 15))
    return bronze.append_merge(events.where(F.col("ts") < cut).drop("value", "ts"),
                               events.where(F.col("ts") >= cut).drop("ts"))


@query("flatten_document", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name,
           '{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' AS profile,
           '["' || c_mktsegment || '",null]' AS tags,
           strftime(last_seen_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS last_order
    FROM customer JOIN b_users ON user_id = c_custkey""")
def flatten_document(spark, sf):
    """Nested customers to flat rows; the balance plays the secret and never gets through."""
    seen = b.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("last_order"))
    nested = b.table(spark, sf, "customer").join(
        seen, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("_id"), "c_name",
        F.struct(F.col("c_nationkey").alias("nation"),
                 F.col("c_mktsegment").alias("segment")).alias("profile"),
        F.array("c_mktsegment", F.lit(None)).alias("tags"),
        "last_order", F.col("c_acctbal").alias("passwordHash"))
    return bronze.flatten(bronze.project_out_secrets(nested, "users"))


@query("write_gold", f"""
    SELECT * EXCLUDE (body, created_at), {_time('created_at')} AS created_at FROM g_message""")
def write_gold(spark, sf):
    """fact_message written by day and read back."""
    root = scratch_path(spark, "gold")
    fact = star.fact_message(b.bronze_messages(spark, sf))
    gold.write_gold(fact, root, "fact_message")
    return spark.read.schema(fact.schema).parquet(f"{root}/fact_message")


@query("export_feedback", """
    SELECT stream_id, question, answer, verdict, source_keys AS retrieved_keys, kind, provider,
           strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
    FROM b_ai_calls WHERE verdict IS NOT NULL
    ORDER BY b_ai_calls.created_at DESC, stream_id DESC LIMIT 1000""")
def export_feedback(spark, sf):
    path = feedback.export_feedback(b.ai_calls(spark, sf), scratch_path(spark, "feedback"))
    return feedback.read_feedback(spark, path)


# --- de-duplication ----------------------------------------------------------------------

_LINE_ORDER = ("l_tax DESC, l_suppkey DESC, l_returnflag DESC, l_quantity DESC, "
               "l_partkey DESC, l_linestatus DESC, l_linenumber DESC, "
               "l_extendedprice DESC, l_discount DESC")
_LINE_COLUMNS = ("l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                 "l_discount, l_tax, l_returnflag, l_linestatus")


def _versions(spark, sf):
    return b.table(spark, sf, "lineitem").withColumnsRenamed(
        {"l_orderkey": "id", "l_shipdate": "updatedAt"})


@query("dedup_latest", f"""
    SELECT id, updated_text AS "updatedAt", {_LINE_COLUMNS} FROM (
      SELECT l_orderkey AS id, {_time('l_shipdate')} AS updated_text, {_LINE_COLUMNS},
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC NULLS LAST,
               l_discount DESC, l_extendedprice DESC, l_linenumber DESC, l_linestatus DESC,
               l_partkey DESC, l_quantity DESC, l_returnflag DESC, l_suppkey DESC, l_tax DESC
             ) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_latest_query(spark, sf):
    """Order lines as versions of their order; the latest shipped one is current."""
    return dedup_latest(_versions(spark, sf))


@query("dedup_any", f"""
    SELECT id, {_LINE_COLUMNS} FROM (
      SELECT l_orderkey AS id, {_LINE_COLUMNS},
             row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_COLUMNS}) AS rn
      FROM lineitem) WHERE rn = 1""")
def dedup_any_query(spark, sf):
    return dedup_any(_versions(spark, sf).drop("updatedAt"))


@query("dedup_send", """
    SELECT message_id, sender_id, client_msg_id,
           min(message_id) OVER (PARTITION BY sender_id, client_msg_id) AS canonical_id,
           message_id <> min(message_id) OVER (PARTITION BY sender_id, client_msg_id)
             AS is_retry
    FROM b_messages""")
def dedup_send_query(spark, sf):
    """Every send with the message its (sender, client id) resolves to."""
    sends = b.messages(spark, sf).select("message_id", "sender_id", "client_msg_id")
    return resolve_retries(sends)


@query("reconcile_keys", """
    WITH both_sides AS (
      SELECT CASE WHEN message_id % 7 > 0 THEN message_id END AS message_id, room_id, sender_id,
             client_msg_id, body, 0 AS seq FROM b_messages
      WHERE kind IS NOT DISTINCT FROM 'user'
      UNION ALL
      SELECT message_id, room_id, sender_id, client_msg_id, upper(body), 1
      FROM b_messages WHERE body LIKE 'purchase%' OR kind = 'ai'),
    by_client AS (
      SELECT *, row_number() OVER (PARTITION BY room_id, sender_id, client_msg_id
                                   ORDER BY seq DESC, message_id DESC NULLS LAST,
                                            body DESC) AS c FROM both_sides),
    by_id AS (
      SELECT *, row_number() OVER (PARTITION BY room_id, message_id
                                   ORDER BY seq DESC, client_msg_id DESC) AS i
      FROM by_client WHERE c = 1)
    SELECT message_id, room_id, sender_id, client_msg_id, body FROM by_id
    WHERE i = 1 OR message_id IS NULL""")
def reconcile_keys(spark, sf):
    """The user messages held, merged with arriving purchases and answers. One held message in
    seven is still pending and has no id."""
    held = b.messages(spark, sf).select("message_id", "room_id", "sender_id", "client_msg_id",
                                        "kind", "body")
    arriving = held.where(F.col("body").startswith("purchase") | (F.col("kind") == "ai"))
    return reconcile_by_either_key(
        held.where(F.col("kind") == "user").drop("kind").withColumn(
            "message_id", F.when(F.col("message_id") % 7 > 0, F.col("message_id"))),
        arriving.withColumn("body", F.upper("body")).drop("kind"))


# --- star schema -------------------------------------------------------------------------

@query("dim_date", """
    SELECT date_key, strftime(date, '%Y-%m-%d') AS date, CAST(year(date) AS INTEGER) AS year,
           CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month,
           monthname(date) AS month_name, CAST(day(date) AS INTEGER) AS day,
           CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week, dayname(date) AS day_name,
           dayofweek(date) IN (0, 6) AS is_weekend
    FROM (SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date FROM (
      SELECT CAST(unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi),
                                         INTERVAL 1 DAY)) AS DATE) AS d
      FROM (SELECT least((SELECT min(ts) FROM events), (SELECT min(o_orderdate) FROM orders))
                     AS lo,
                   greatest((SELECT max(ts) FROM events), (SELECT max(o_orderdate) FROM orders))
                     AS hi)))""")
def dim_date(spark, sf):
    """Calendar over two facts: message times and order dates."""
    sent = b.messages(spark, sf).select("created_at")
    ordered = b.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return star.dim_date(sent, ordered)


@query("dim_user", f"""
    SELECT CAST(user_id AS VARCHAR) AS user_id, username,
           upper(username[1]) || lower(username[2:]) AS display_name,
           {_time('account_created_at')} AS account_created_at,
           {_time('last_seen_at')} AS last_seen_at FROM b_users""")
def dim_user(spark, sf):
    return star.dim_user(b.bronze_users(spark, sf))


@query("dim_room", """
    SELECT CAST(room_id AS VARCHAR) AS room_id, name, slug, is_dm,
           coalesce(ai_enabled, true) AS ai_enabled,
           CAST(creator_id AS VARCHAR) AS creator_user_id,
           '2024-01-01 00:00:00.000000' AS room_created_at FROM b_rooms""")
def dim_room(spark, sf):
    return star.dim_room(b.bronze_rooms(spark, sf))


@query("fact_message", f"""
    SELECT * EXCLUDE (body, created_at), {_time('created_at')} AS created_at FROM g_message""")
def fact_message(spark, sf):
    return star.fact_message(b.bronze_messages(spark, sf))


@query("privacy_gate", "SELECT message_id, kind, body FROM g_message")
def privacy_gate(spark, sf):
    """With the opt-in the body comes along; ``fact_message`` shows that without it, it
    does not."""
    opted = star.fact_message(b.bronze_messages(spark, sf), include_text=True)
    return opted.select("message_id", "kind", "body")


@query("fact_ai_call", f"""
    SELECT * EXCLUDE (created_at), {_time('created_at')} AS created_at FROM g_ai_call""")
def fact_ai_call(spark, sf):
    return star.fact_ai_call(b.bronze_ai_calls(spark, sf))


@query("room_activity_daily", "SELECT * FROM g_daily")
def room_activity_daily(spark, sf):
    return star.room_activity_daily(star.fact_message(b.bronze_messages(spark, sf)))


# --- reports -----------------------------------------------------------------------------

def _ratio(n: str, d: str) -> str:
    return f"CAST(((({n}) * 20 + ({d})) // nullif(({d}) * 2, 0)) AS DOUBLE) / 10"


_SPEND = f"""
    SELECT {_date('d.date')} AS date, provider, model, count(*) AS calls,
           CAST(sum(total_tokens) AS BIGINT) AS tokens,
           {_ratio('sum(latency_ms)', 'count(*)')} AS avg_latency_ms,
           count(*) FILTER (WHERE cached) AS cache_hits
    FROM g_ai_call c JOIN g_date d USING (date_key) GROUP BY d.date, provider, model"""
_QUALITY = f"""
    SELECT kind, count(*) AS answers, count(*) FILTER (WHERE is_thumbs_up) AS up,
           count(*) FILTER (WHERE is_thumbs_down) AS down,
           {_ratio('count(*) FILTER (WHERE is_thumbs_up) * 100',
                   'count(*) FILTER (WHERE is_thumbs_up OR is_thumbs_down)')} AS pct_positive
    FROM g_ai_call WHERE ok GROUP BY kind"""
_ROOMS = f"""
    SELECT r.name, r.is_dm, coalesce(r.ai_enabled, true) AS ai_enabled,
           CAST(sum(message_count) AS BIGINT) AS messages,
           CAST(sum(ai_answer_count) AS BIGINT) AS ai_answers,
           max(distinct_sender_count) AS peak_daily_speakers
    FROM g_daily a JOIN b_rooms r ON CAST(r.room_id AS VARCHAR) = a.room_id
    JOIN g_date d USING (date_key)
    WHERE d.date >= DATE '{AS_OF}' - INTERVAL 30 DAY
    GROUP BY ALL ORDER BY messages DESC, 1, 2, 3 LIMIT 20"""
_HEALTH = f"""
    SELECT source_count, count(*) AS answers,
           {_ratio('sum(retrieval_hits)', 'count(*)')} AS avg_hits,
           {_ratio('count(*) FILTER (WHERE is_thumbs_up) * 100', 'count(*)')} AS pct_up
    FROM g_ai_call WHERE kind IN ('room-ask', 'global-ask', 'catchup') GROUP BY source_count"""
_COHORT = """
    SELECT CAST(year(account_created_at) AS INTEGER) AS year,
           CAST(month(account_created_at) AS INTEGER) AS month, count(*) AS signups
    FROM b_users WHERE account_created_at IS NOT NULL GROUP BY ALL"""


@query("q_token_spend", _SPEND)
def q_token_spend(spark, sf):
    fact = star.fact_ai_call(b.bronze_ai_calls(spark, sf))
    return star.token_spend(fact, star.dim_date(b.messages(spark, sf)))


@query("q_answer_quality", _QUALITY)
def q_answer_quality(spark, sf):
    return star.answer_quality(star.fact_ai_call(b.bronze_ai_calls(spark, sf)))


@query("q_active_rooms", _ROOMS)
def q_active_rooms(spark, sf):
    """Bronze versions -> latest -> fact -> daily rollup -> rooms of the last 30 days."""
    fact = star.fact_message(b.bronze_messages(spark, sf))
    return star.active_rooms(star.room_activity_daily(fact),
                             star.dim_room(b.bronze_rooms(spark, sf)),
                             star.dim_date(b.messages(spark, sf)), AS_OF)


@query("q_retrieval_health", _HEALTH)
def q_retrieval_health(spark, sf):
    return star.retrieval_health(star.fact_ai_call(b.bronze_ai_calls(spark, sf)))


@query("q_signup_cohort", _COHORT)
def q_signup_cohort(spark, sf):
    return star.signup_cohort(star.dim_user(b.bronze_users(spark, sf)))


_AS_JSON = {
    "token_spend": (_SPEND, ("date", "provider", "model", "calls", "tokens", "cache_hits")),
    "answer_quality": (_QUALITY, ("kind", "answers", "up", "down")),
    "active_rooms": (_ROOMS, ("name", "is_dm", "messages", "ai_answers",
                              "peak_daily_speakers")),
    "retrieval_health": (_HEALTH, ("source_count", "answers")),
    "signup_cohort": (_COHORT, ("year", "month", "signups")),
}


@query("named_sql", " UNION ALL ".join(
    f"SELECT '{name}' AS report, concat_ws('|', "
    + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + f") AS line FROM ({sql})"
    for name, (sql, cols) in _AS_JSON.items()))
def named_sql(spark, sf):
    """All five reports as SQL text over the registered gold views, one line per row."""
    calls = star.fact_ai_call(b.bronze_ai_calls(spark, sf))
    messages = star.fact_message(b.bronze_messages(spark, sf))
    views = {"fact_ai_call": calls, "fact_message": messages,
             "dim_date": star.dim_date(b.messages(spark, sf)),
             "dim_room": star.dim_room(b.bronze_rooms(spark, sf)),
             "dim_user": star.dim_user(b.bronze_users(spark, sf)),
             "fact_room_activity_daily": star.room_activity_daily(messages)}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = None
    for name in REPORTS:
        lines = run_report(spark, name, AS_OF).select(
            F.lit(name).alias("report"),
            F.concat_ws("|", *[F.date_format(c, "yyyy-MM-dd") if c == "date"
                               else F.col(c).cast("string") for c in _AS_JSON[name][1]])
            .alias("line"))
        out = lines if out is None else out.unionByName(lines)
    return out


# --- call log ----------------------------------------------------------------------------

_PRICE_ROWS = ", ".join(
    f"('{m}', CAST({i} AS DECIMAL(12,6)), CAST({o} AS DECIMAL(12,6)))" for m, i, o in PRICES)


@query("ai_call_metrics", f"""
    WITH prices(model, price_in, price_out) AS (VALUES {_PRICE_ROWS}),
    calls AS (
      SELECT c.*, ok AND NOT cached AS is_answer,
             tokens_in * coalesce(price_in, 0) + tokens_out * coalesce(price_out, 0) AS cost
      FROM b_ai_calls c LEFT JOIN prices USING (model)
      WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 168 HOUR)
    SELECT count(*) AS requests, count(*) FILTER (WHERE is_answer) AS answers, count(*) FILTER (WHERE cached) AS cache_hits,
           count(*) FILTER (WHERE NOT ok) AS failures,
           {_ratio('sum(tokens_in) FILTER (WHERE is_answer)', 'count(*) FILTER (WHERE is_answer)')}
             AS avg_tokens_in,
           {_ratio('sum(tokens_out) FILTER (WHERE is_answer)', 'count(*) FILTER (WHERE is_answer)')}
             AS avg_tokens_out,
           round(CAST(sum(cost) FILTER (WHERE is_answer) AS DOUBLE) / 1e6, 6) AS total_cost,
           round(CAST(sum(cost) FILTER (WHERE is_answer) AS DOUBLE) / 1e6 / count(*) FILTER (WHERE is_answer), 6)
             AS cost_per_answer,
           {_ratio('count(*) FILTER (WHERE cached) * 100', 'count(*)')} AS hit_rate_pct,
           round(CAST(sum(cost) FILTER (WHERE cached) AS DOUBLE) / 1e6, 6) AS cost_saved,
           quantile_disc(latency_ms, 0.5) FILTER (WHERE is_answer) AS latency_p50,
           quantile_disc(latency_ms, 0.95) FILTER (WHERE is_answer) AS latency_p95
    FROM calls""")
def ai_call_metrics(spark, sf):
    return metrics.ai_call_metrics(b.ai_calls(spark, sf), "2024-01-30 00:00:00")


@query("calls_by_kind", "SELECT kind, count(*) AS calls FROM b_ai_calls GROUP BY kind")
def calls_by_kind(spark, sf):
    return metrics.calls_by_kind(b.ai_calls(spark, sf))


@query("public_stats", """
    SELECT CAST((SELECT count(*) FROM b_messages) AS BIGINT) AS messages,
           CAST((SELECT count(*) FROM b_ai_calls WHERE ok) AS BIGINT) AS answers""")
def public_stats(spark, sf):
    return metrics.public_stats(b.messages(spark, sf), b.ai_calls(spark, sf))


_TOKENS = "greatest(0, tokens_in + tokens_out)"


@query("daily_token_quota", f"""
    SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day,
           CAST(sum({_TOKENS}) AS BIGINT) AS used,
           CAST(greatest(0, 500 - sum({_TOKENS})) AS BIGINT) AS remaining
    FROM b_ai_calls GROUP BY 1, 2""")
def daily_token_quota(spark, sf):
    calls = b.ai_calls(spark, sf).withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
    return metrics.daily_token_usage(calls, 500)


@query("quota_decisions", f"""
    SELECT stream_id, user_id, strftime(created_at, '%Y-%m-%d') AS day, used_before,
           used_before < 500 AS allowed FROM (
      SELECT *, CAST(coalesce(sum({_TOKENS}) OVER (
        PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, stream_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before
      FROM b_ai_calls)""")
def quota_decisions(spark, sf):
    calls = b.ai_calls(spark, sf).withColumn(
        "tokens", F.col("tokens_in") + F.col("tokens_out")).select(
        "stream_id", "user_id", "created_at", "tokens")
    return metrics.quota_decisions(calls, 500).drop("created_at", "tokens")


@query("ceiling_audit", """
    SELECT o_custkey, count(*) AS owned FROM orders GROUP BY o_custkey HAVING count(*) >= 15""")
def ceiling_audit(spark, sf):
    return metrics.ceiling_audit(b.table(spark, sf, "orders"), "o_custkey", 15)
