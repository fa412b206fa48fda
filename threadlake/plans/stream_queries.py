"""Registered queries: streams over the test tables, run until the input is consumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.constants import CACHE_ENTRIES
from threadlake.functions.scalar import point_id
from threadlake.operators.validate import message_rules
from threadlake.plans import (  # noqa: F401  (their SQL is shared below)
    activity_queries, retrieval_queries, warehouse_queries,
)
from threadlake.plans import bindings as b
from threadlake.plans.registry import PLAIN_SQL, query
from threadlake.session import scratch_path
from threadlake.streaming import ingest, state
from threadlake.streaming.runtime import keep_latest, run_to_table, stream_session


# Files that a table is dealt over by time, one micro-batch each, so that state crosses batches.
_FILES = 4


def _files(own, rows, order: str, label: str, late: int = 0):
    """``rows`` as a stream of files in the order of a time column; ``late`` starts it with so many
    files that hold its first row only, so what follows comes that many batches later."""
    path, at = scratch_path(own, label), F.unix_micros(order)
    cuts = rows.select(at.alias("us")).approxQuantile(
        "us", [i / _FILES for i in range(1, _FILES)], 0.01)
    part = sum([F.when(at >= c, 1).otherwise(0) for c in cuts], F.lit(0))
    for n in range(late):
        rows.orderBy(order).limit(1).where(F.lit(n < 0)).coalesce(1).write.mode("append").parquet(path)
    for n in range(_FILES):
        rows.where(part == n).coalesce(1).write.mode("append").parquet(path)
    return own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), path


def _flush(rows, path: str, **values):
    """Two last files with one row far in the future, so that the watermark passes all others."""
    row = rows.limit(1).withColumns({k: F.lit(v).cast(rows.schema[k].dataType) for k, v in values.items()})
    for _ in range(2):
        row.coalesce(1).write.mode("append").parquet(path)


def _events(own, sf):
    return b.table(own, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


@query("stream_ingest", """
    SELECT regexp_replace(md5('msg:' || message_id),
             '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id,
           room_id, message_id, body AS text, CAST(64 AS INTEGER) AS dims
    FROM r_corpus""")
def stream_ingest(spark, sf):
    own = stream_session(spark)
    messages = b.texts(own, sf, b.stream_table(own, sf, "conversations"))
    table = ingest.stream_ingest(messages, b.rooms(own, sf), scratch_path(spark, "points"))
    return table.read().select("point_id", "room_id", "message_id", "text",
                               F.size("vector").alias("dims"))


@query("stream_doc_ingest", PLAIN_SQL["chunk_documents"].split("SELECT * FROM chunks")[0] + """
    SELECT d.doc_id, 'ready' AS status, CAST(count(c.doc_id) AS INTEGER) AS chunk_count,
           CAST(NULL AS VARCHAR) AS error
    FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id
    GROUP BY d.doc_id""")
def stream_doc_ingest(spark, sf):
    """Status per document after its chunks became points, whatever the memory switch says."""
    own = stream_session(spark)
    docs = b.docs(own, sf, b.stream_table(own, sf, "documents"))
    _, status = ingest.stream_doc_ingest(docs, scratch_path(spark, "docs"))
    return status.read()


@query("stream_dedup_send", """
    SELECT DISTINCT sender_id, client_msg_id FROM b_messages""")
def stream_dedup_send(spark, sf):
    """The whole month fits the watermark, so every retry meets its first send."""
    own = stream_session(spark)
    messages = b.messages(own, sf, b.stream_table(own, sf, "events")).select(
        "message_id", "sender_id", "client_msg_id", "created_at")
    path = run_to_table(ingest.stream_dedup_send(messages, "40 days"), "sends")
    return spark.read.parquet(path).select("sender_id", "client_msg_id")


@query("stream_rate_limit", PLAIN_SQL["rate_limit"])
def stream_rate_limit(spark, sf):
    own = stream_session(spark)
    events, _ = _files(own, _events(own, sf), "ts", "events")
    return spark.read.parquet(run_to_table(
        state.stream_rate_limit(events, (3, 86_400, 21_600)), "limits"))


@query("stream_breaker", PLAIN_SQL["breaker_windows"])
def stream_breaker(spark, sf):
    own = stream_session(spark)
    calls, _ = _files(own, b.ai_calls(own, sf), "created_at", "calls")
    return spark.read.parquet(run_to_table(
        state.stream_breaker(calls, 3, 3600, 1800), "breaker"))


_EDGES = f"""
    WITH moves AS (
      SELECT user_id, ts, event_id,
             CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS delta
      FROM events WHERE event_type <> 'signup'),
    summed AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
               FROM moves),
    floored AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id
                  ORDER BY ts, event_id)) AS c FROM summed),
    stepped AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY user_id
                  ORDER BY ts, event_id), 0) AS before FROM floored)
    SELECT user_id, event_id, {_time('ts')} AS ts, c = 1 AS online FROM stepped
    WHERE (before = 0 AND c = 1) OR (before = 1 AND c = 0)"""


def _moves(own, sf):
    return _events(own, sf).where(F.col("event_type") != "signup").select(
        "user_id", "event_id", "ts",
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("delta"))


@query("stream_presence", _EDGES)
def stream_presence(spark, sf):
    own = stream_session(spark)
    events, _ = _files(own, _moves(own, sf), "ts", "moves")
    return spark.read.parquet(run_to_table(state.stream_presence(events), "presence"))


# Silence of ten hours counts as leaving: a user's rows fall into stretches between such pauses, and
# the counter starts at zero in each.
@query("stream_presence_ttl", f"""
    WITH moves AS (
      SELECT user_id, ts, event_id,
             CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS delta,
             lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
             lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after
      FROM events WHERE event_type <> 'signup'),
    cut AS (
      SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 10 HOUR THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stretch FROM moves),
    summed AS (
      SELECT *, sum(delta) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id) AS s FROM cut),
    floored AS (
      SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id)) AS c
      FROM summed),
    stepped AS (
      SELECT *, coalesce(lag(c) OVER (PARTITION BY user_id, stretch ORDER BY ts, event_id), 0) AS was
      FROM floored)
    SELECT user_id, event_id, {_time('ts')} AS ts, c = 1 AS online FROM stepped
    WHERE (was = 0 AND c = 1) OR (was = 1 AND c = 0)
    UNION ALL
    SELECT user_id, NULL, {_time('ts + INTERVAL 10 HOUR')}, false FROM stepped
    WHERE c > 0 AND (after IS NULL OR after - ts >= INTERVAL 10 HOUR)""")
def stream_presence_ttl(spark, sf):
    """The same with a time to live, told by timers or by the next row, whichever comes first."""
    own = stream_session(spark)
    moves = _moves(own, sf)
    events, path = _files(own, moves, "ts", "moves")
    _flush(moves, path, user_id=-1, ts="2100-01-01 00:00:00")
    return spark.read.parquet(run_to_table(
        state.stream_presence(events, 36_000), "presence")).where("user_id >= 0")


@query("stream_typing", f"""
    WITH rows AS (
      SELECT user_id, event_id % 5 AS room_id, ts, event_id, event_type = 'purchase' AS is_stop,
             lag(ts) OVER w AS before, lag(event_type = 'purchase') OVER w AS before_stop
      FROM events WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id)),
    opened AS (
      SELECT *, sum(CASE WHEN NOT is_stop AND (before IS NULL OR before_stop
                                  OR ts - before >= INTERVAL 30 MINUTE) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id, room_id ORDER BY ts, event_id) AS session FROM rows)
    SELECT user_id, room_id, {_time('min(ts) FILTER (WHERE NOT is_stop)')} AS started_at,
           {_time("least(max(ts) FILTER (WHERE NOT is_stop) + INTERVAL 30 MINUTE, min(ts) FILTER (WHERE is_stop))")}
             AS ended_at
    FROM opened WHERE session > 0 GROUP BY user_id, room_id, session""")
def stream_typing(spark, sf):
    """Typing spans by user and room, told when they stop or run out after half an hour."""
    own = stream_session(spark)
    rows = _events(own, sf).select(
        "user_id", (F.col("event_id") % 5).alias("room_id"), "event_id", "ts",
        (F.col("event_type") == "purchase").alias("is_stop"))
    events, path = _files(own, rows, "ts", "typing")
    _flush(rows, path, user_id=-1, ts="2100-01-01 00:00:00")
    return spark.read.parquet(run_to_table(
        state.stream_typing(events, 1800), "typing")).where("user_id >= 0")


@query("stream_quota", PLAIN_SQL["quota_decisions"])
def stream_quota(spark, sf):
    own = stream_session(spark)
    calls, _ = _files(own, b.ai_calls(own, sf).withColumn(
        "tokens", F.col("tokens_in") + F.col("tokens_out")), "created_at", "calls")
    return spark.read.parquet(run_to_table(state.stream_quota(calls, 500), "quota"))


@query("stream_daily_usage", """
    SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day,
           CAST(sum(greatest(0, tokens_in + tokens_out)) AS BIGINT) AS used
    FROM b_ai_calls GROUP BY 1, 2""")
def stream_daily_usage(spark, sf):
    own = stream_session(spark)
    calls = b.ai_calls(own, sf, b.stream_table(own, sf, "events")).withColumn(
        "tokens", F.col("tokens_in") + F.col("tokens_out"))
    return keep_latest(ingest.daily_usage(calls), ("user_id", "day"), "usage").read()


@query("stream_read_cursor", """
    SELECT user_id, event_id % 5 AS room_id,
           max(event_id - 5 * CAST(json_extract_string(props, '$.k') AS INTEGER))
             AS last_read_message_id
    FROM events GROUP BY 1, 2""")
def stream_read_cursor(spark, sf):
    own = stream_session(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    receipts = b.stream_table(own, sf, "events").select(
        "user_id", (F.col("event_id") % 5).alias("room_id"),
        (F.col("event_id") - 5 * k).alias("last_read_message_id"))
    return keep_latest(ingest.cursor_maximum(receipts), ("user_id", "room_id"),
                       "cursors").read()


# One ask a minute, so a fingerprint's entries live as long as its asks miss once a day at least.
@query("stream_cache", f"""
    WITH RECURSIVE asks AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec, vec_id * 60 AS t,
             row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    walk AS (
      SELECT DISTINCT label, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS renewed,
             CAST([] AS STRUCT(id BIGINT, vec DOUBLE[])[]) AS held, CAST(NULL AS BIGINT) AS vec_id,
             CAST(NULL AS BIGINT) AS entry_id FROM embeddings
      UNION ALL
      SELECT label, n, CASE WHEN entry_id IS NULL THEN t ELSE renewed END,
             CASE WHEN entry_id IS NULL
                  THEN list_prepend(struct_pack(id := vec_id, vec := vec), alive)[1:{CACHE_ENTRIES}] ELSE alive END,
             vec_id, entry_id
      FROM (SELECT *, CASE WHEN best[1] >= 0.25 THEN CAST(-best[2] AS BIGINT) END AS entry_id
            FROM (SELECT *, list_max(list_transform(alive, lambda e: [
                            round(list_dot_product(e.vec, vec), 6), -CAST(e.id AS DOUBLE)])) AS best
                  FROM (SELECT a.label, a.n, a.vec_id, a.vec, a.t, w.renewed,
                               CASE WHEN a.t - w.renewed >= 86400 AND len(w.held) > 0
                                    THEN CAST([] AS STRUCT(id BIGINT, vec DOUBLE[])[])
                                    ELSE w.held END AS alive
                        FROM walk w JOIN asks a ON a.label = w.label AND a.n = w.n + 1))))
    SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS fingerprint, entry_id
    FROM walk WHERE vec_id IS NOT NULL""")
def stream_cache(spark, sf):
    """Every vector as an ask of its label, one a minute; misses are stored. The order of
    lookups and inserts decides."""
    own = stream_session(spark)
    asks, _ = _files(own, b.table(own, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("fingerprint"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 60).alias("ts"),
        F.col("embedding").alias("vector")), "ts", "asks")
    return spark.read.parquet(run_to_table(state.stream_cache(asks, 0.25), "cache"))


@query("dead_letter", PLAIN_SQL["row_validation"].replace(
    "SELECT conv_id, turn,", "SELECT conv_id, turn, error_path AS reason FROM (SELECT conv_id, turn,", 1)
    + ") WHERE error_path IS NOT NULL")
def dead_letter(spark, sf):
    """Conversation turns as sends: what fails validation goes to the dead-letter table."""
    own = stream_session(spark)
    turns = b.stream_table(own, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("body"),
        F.when(F.col("role") == "system", F.col("role")).otherwise(
            F.substring(F.md5(F.col("conv_id").cast("string")), 1, 24)).alias("room_id"),
        F.when(F.col("role") == "assistant", F.md5("text")).otherwise(
            point_id(F.col("text"))).alias("client_msg_id"))
    root = scratch_path(spark, "split")
    ingest.split_stream(turns, message_rules(), f"{root}/good", f"{root}/bad")
    return spark.read.parquet(f"{root}/bad").select("conv_id", "turn", "reason")


# A fourth of the texts never succeed, a fourth succeed at the third attempt.
@query("dead_letter_retries", """
    SELECT conv_id, turn, CASE WHEN length(text) % 4 = 0 THEN 'dead' ELSE 'done' END AS outcome,
           CAST(CASE length(text) % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 1 END AS INTEGER) AS attempts
    FROM conversations""")
def dead_letter_retries(spark, sf):
    """Conversation turns sent over several batches; failed ones are tried again by later batches."""
    own = stream_session(spark)
    turns = b.table(own, sf, "conversations").select(
        "conv_id", "turn", "text", F.timestamp_seconds(
            F.lit(1704067200) + (F.col("conv_id") * 100 + F.col("turn")) * 60).alias("at"))
    rows, _ = _files(own, turns, "at", "sends")
    kind = F.length("text") % 4
    table = ingest.stream_with_retries(rows, lambda df: df.withColumn("error", F.when(
        (kind == 0) | ((kind == 1) & (F.col("attempts") < 2)), F.lit("refused"))),
        scratch_path(spark, "retries"))
    out = [table.read(name).select("conv_id", "turn", F.lit(name).alias("outcome"), "attempts")
           for name in ("done", "dead")]
    return out[0].unionByName(out[1])


@query("memory_switch", """
    WITH switches AS (SELECT event_id % 5 AS room_id, ts, event_id,
                             event_type = 'signup' AS enabled
                      FROM events WHERE event_type IN ('signup', 'error')),
    now AS (SELECT room_id, arg_max(enabled, (ts, event_id)) AS enabled
            FROM switches GROUP BY room_id),
    sent AS (SELECT event_id AS message_id, event_id % 5 AS room_id, ts FROM events
             WHERE event_type NOT IN ('signup', 'error'))
    SELECT s.message_id, s.room_id, coalesce(w.enabled, true) AS ingested,
           coalesce(w.enabled, true) AND coalesce(n.enabled, true) AS visible
    FROM sent s ASOF LEFT JOIN switches w ON w.room_id = s.room_id AND w.ts <= s.ts
    LEFT JOIN now n ON n.room_id = s.room_id""")
def memory_switch(spark, sf):
    """Signups switch a room's memory on, errors switch it off; the rest are messages."""
    events = b.table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), (F.col("event_id") % 5).alias("room_id"),
        F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    toggles = F.col("event_type").isin("signup", "error")
    switches = events.where(toggles).select(
        "room_id", F.col("created_at").alias("switched_at"),
        F.col("message_id").alias("switch_id"),
        (F.col("event_type") == "signup").alias("enabled"))
    return ingest.memory_switch_asof(events.where(~toggles), switches)


@query("stream_memory_switch", """
    WITH switches AS (SELECT event_id % 5 AS room_id, ts, event_id,
                             event_type = 'signup' AS enabled
                      FROM events WHERE event_type IN ('signup', 'error'))
    SELECT s.event_id AS message_id, s.event_id % 5 AS room_id, coalesce(w.enabled, true) AS ingested
    FROM (SELECT * FROM events WHERE event_type NOT IN ('signup', 'error')) s
    ASOF LEFT JOIN switches w ON w.room_id = s.event_id % 5 AND w.ts <= s.ts""")
def stream_memory_switch(spark, sf):
    """Messages and switches as two streams; the switches come a batch later than the messages."""
    own = stream_session(spark)
    events = _events(own, sf).withColumn("room_id", F.col("event_id") % 5)
    toggles = F.col("event_type").isin("signup", "error")
    said = events.where(~toggles).select(F.col("event_id").alias("message_id"), "room_id",
                                         F.col("ts").alias("created_at"))
    turned = events.where(toggles).select(
        "room_id", F.col("ts").alias("switched_at"), F.col("event_id").alias("switch_id"),
        (F.col("event_type") == "signup").alias("enabled"))
    messages, said_path = _files(own, said, "created_at", "said")
    switches, turned_path = _files(own, turned, "switched_at", "turned", late=1)
    _flush(said, said_path, message_id=-1, created_at="2100-01-01 00:00:00")
    _flush(turned, turned_path, room_id=-1, switched_at="2100-01-01 00:00:00")
    return spark.read.parquet(run_to_table(
        state.stream_memory_switch(messages, switches), "asof")).where("message_id >= 0")


@query("heartbeat_sessions", f"""
    WITH marked AS (
      SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL
               OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS opens
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
                 FROM marked)
    SELECT user_id, {_time('min(ts)')} AS online_at,
           {_time('max(ts) + INTERVAL 2 HOUR')} AS offline_at, count(*) AS beats
    FROM numbered GROUP BY user_id, s""")
def heartbeat_sessions(spark, sf):
    """Events as heartbeats with a time to live of two hours."""
    beats = b.table(spark, sf, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return ingest.heartbeat_sessions(beats, "2 hours")
