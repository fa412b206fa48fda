"""Registered queries: joins on cursors, delivery, paging, presence, limits, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.constants import CATCHUP_CAP, SYNC_CAP, WIDE_SPACE
from threadlake.functions import scalar
from threadlake.operators import activity, delivery, limits, paging, presence, scope, validate
from threadlake.operators.metrics import fanout_stats
from threadlake.plans import bindings as b
from threadlake.plans.registry import PLAIN_SQL, query


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


# --- scope and enrichment ----------------------------------------------------------------

@query("knowledge_filter", """
    SELECT message_id, room_id, kind FROM k_messages
    WHERE room_id IN (SELECT room_id FROM b_rooms WHERE coalesce(ai_enabled, true))""")
def knowledge_filter(spark, sf):
    kept = scope.knowledge_filter(b.messages(spark, sf), b.rooms(spark, sf))
    return kept.select("message_id", "room_id", "kind")


@query("permission_scope", """
    SELECT DISTINCT e.user_id AS query_id, m.room_id
    FROM (SELECT DISTINCT user_id FROM events) e JOIN b_memberships m USING (user_id)
    JOIN b_rooms r USING (room_id) WHERE coalesce(r.ai_enabled, true)""")
def permission_scope(spark, sf):
    askers = b.table(spark, sf, "events").select("user_id").distinct().withColumn(
        "query_id", F.col("user_id"))
    return scope.permission_scope(askers, b.memberships(spark, sf), b.rooms(spark, sf))


@query("enrich_messages", """
    SELECT m.message_id, m.room_id, m.sender_id,
           CASE WHEN s.s_suppkey IS NULL THEN 'deleted' ELSE s.s_name END AS username,
           CASE WHEN s.s_suppkey IS NULL THEN 'Deleted user' ELSE upper(s.s_name) END
             AS display_name,
           coalesce(r.name, 'unknown') AS room_name
    FROM b_messages m LEFT JOIN supplier s ON s.s_suppkey = m.sender_id
    LEFT JOIN b_rooms r ON r.room_id = m.room_id AND NOT r.is_dm""")
def enrich_messages(spark, sf):
    """Suppliers as the account list (some senders have none), public rooms as directory."""
    users = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("username"),
        F.upper("s_name").alias("display_name"))
    messages = b.messages(spark, sf).select("message_id", "room_id", "sender_id")
    return scope.enrich_room_name(scope.enrich_sender(messages, users),
                                  b.rooms(spark, sf).where(~F.col("is_dm")))


# --- validation --------------------------------------------------------------------------

@query("validity_filter", """
    SELECT o_orderkey AS invite_id, redemptions AS redemption_count FROM (
      SELECT o_orderkey, o_orderdate, o_orderstatus, count(l_orderkey) AS redemptions
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-01-01'
      AND redemptions < 5""")
def validity_filter(spark, sf):
    """Orders as invites: lines are redemptions, finished ones are revoked."""
    used = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("redemption_count"))
    orders = b.table(spark, sf, "orders")
    invites = orders.join(used, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("invite_id"),
        F.coalesce("redemption_count", F.lit(0)).alias("redemption_count"),
        F.lit(5).alias("max_redemptions"),
        (F.col("o_orderdate") + F.expr("interval 30 days")).cast("timestamp")
        .alias("expires_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    as_of = F.to_timestamp(F.lit("1998-01-01"))
    return validate.valid_invites(invites, as_of).select("invite_id", "redemption_count")


_TRIMMED = f"regexp_replace(text, '^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$', '', 'g')"


@query("row_validation", f"""
    SELECT conv_id, turn,
      CASE WHEN NOT regexp_matches(room_id, '^[a-f0-9]{{24}}$') THEN 'roomId'
           WHEN NOT regexp_matches(client_msg_id, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')
             THEN 'clientMsgId'
           WHEN length({_TRIMMED}) NOT BETWEEN 1 AND 2000 THEN 'body' END
        AS error_path,
      CASE WHEN length({_TRIMMED}) NOT BETWEEN 3 AND 600 THEN 'question' END
        AS question_error
    FROM (SELECT conv_id, turn, text,
      CASE role WHEN 'system' THEN role ELSE substr(md5(CAST(conv_id AS VARCHAR)), 1, 24) END
        AS room_id,
      CASE role WHEN 'assistant' THEN md5(text)
        ELSE regexp_replace(md5(text), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$',
                            '\\1-\\2-\\3-\\4-\\5') END AS client_msg_id
      FROM conversations)""")
def row_validation(spark, sf):
    """Conversation turns as send payloads: system turns carry a bad room id, assistant turns
    a client id without dashes, long turns a body that is too long."""
    turns = b.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("body"), F.col("text").alias("question"),
        F.when(F.col("role") == "system", F.col("role")).otherwise(
            F.substring(F.md5(F.col("conv_id").cast("string")), 1, 24)).alias("room_id"),
        F.when(F.col("role") == "assistant", F.md5("text")).otherwise(
            scalar.point_id(F.col("text"))).alias("client_msg_id"))
    checked = validate.row_validation(turns, validate.message_rules())
    checked = validate.row_validation(checked, validate.question_rules(), "question_error")
    return checked.select("conv_id", "turn", "error_path", "question_error")


@query("text_contains", """
    SELECT doc_id, item_id FROM documents d, benchmark q WHERE contains(d.text, q.text)""")
def text_contains(spark, sf):
    """Documents that hold a benchmark passage word for word."""
    return validate.text_contains(
        b.table(spark, sf, "documents").select("doc_id", "text"),
        b.table(spark, sf, "benchmark").withColumnRenamed("text", "passage"),
        "doc_id", "text", "item_id", "passage")


@query("text_contains_short", """
    SELECT doc_id, item_id FROM documents d,
           (SELECT item_id, substr(text, 2, item_id % 12) AS part FROM benchmark) q
    WHERE contains(d.text, q.part)""")
def text_contains_short(spark, sf):
    """Needles of one word or part of one, keyed by their first characters, and the empty one."""
    return validate.text_contains(
        b.table(spark, sf, "documents").select("doc_id", "text"),
        b.table(spark, sf, "benchmark").select("item_id", F.substr(
            F.col("text"), F.lit(2), (F.col("item_id") % 12).cast("int")).alias("part")),
        "doc_id", "text", "item_id", "part")


# --- cursors -----------------------------------------------------------------------------

@query("unread_counts", """
    SELECT b.user_id, b.room_id, count(m.message_id) AS unread
    FROM b_memberships b LEFT JOIN b_messages m
      ON m.room_id = b.room_id AND m.sender_id <> b.user_id
     AND m.message_id > coalesce(b.last_read_message_id, -1)
    GROUP BY b.user_id, b.room_id""")
def unread_counts(spark, sf):
    return activity.unread_counts(b.memberships(spark, sf), b.messages(spark, sf))


@query("sync_since", f"""
    WITH cursors AS (
      SELECT user_id, event_id % 5 AS room_id, max(event_id) AS last_message_id
      FROM events WHERE event_type = 'click' GROUP BY ALL),
    mine AS (SELECT c.* FROM cursors c SEMI JOIN b_memberships m USING (user_id, room_id)),
    missed AS (
      SELECT c.user_id, c.room_id, m.message_id,
             count(m.message_id) OVER (PARTITION BY c.user_id, c.room_id) AS n
      FROM mine c LEFT JOIN b_messages m
        ON m.room_id = c.room_id AND m.message_id > c.last_message_id)
    SELECT DISTINCT user_id, room_id, n > {SYNC_CAP} AS refetch,
           CASE WHEN n <= {SYNC_CAP} THEN message_id END AS message_id FROM missed""")
def sync_since(spark, sf):
    """Cursors at every user's newest click in a room, member or not."""
    cursors = b.table(spark, sf, "events").where(F.col("event_type") == "click").groupBy(
        "user_id", (F.col("event_id") % 5).alias("room_id")).agg(
        F.max("event_id").alias("last_message_id"))
    return activity.sync_since(cursors, b.memberships(spark, sf), b.messages(spark, sf))


@query("catchup_window", f"""
    SELECT user_id, room_id, message_id, CAST(position AS INTEGER) AS position FROM (
      SELECT b.user_id, b.room_id, m.message_id,
             row_number() OVER (PARTITION BY b.user_id, b.room_id ORDER BY m.message_id)
               AS position
      FROM b_memberships b JOIN k_messages m ON m.room_id = b.room_id
       AND m.sender_id <> b.user_id AND m.message_id > coalesce(b.last_read_message_id, -1))
    WHERE position <= {CATCHUP_CAP}""")
def catchup_window(spark, sf):
    return activity.catchup_window(b.memberships(spark, sf), b.messages(spark, sf))


_RECEIPTS = """
    receipts AS (SELECT event_id AS receipt_id, user_id, event_id % 5 AS room_id, ts,
      event_id - 5 * CAST(json_extract_string(props, '$.k') AS INTEGER) AS target FROM events)"""


def _receipts(spark, sf):
    """Read receipts that reach back k messages of the room: some arrive stale."""
    k = F.get_json_object("props", "$.k").cast("int")
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("receipt_id"), "user_id",
        (F.col("event_id") % 5).alias("room_id"), F.col("ts").alias("created_at"),
        (F.col("event_id") - 5 * k).alias("last_read_message_id"))


@query("read_cursor", f"""
    WITH {_RECEIPTS}
    SELECT receipt_id, user_id, room_id, target AS last_read_message_id FROM (
      SELECT *, max(target) OVER (PARTITION BY user_id, room_id ORDER BY ts, receipt_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM receipts)
    WHERE before IS NULL OR target > before""")
def read_cursor(spark, sf):
    return activity.read_cursor_moves(_receipts(spark, sf)).drop("created_at")


# --- delivery ----------------------------------------------------------------------------

_DELIVERY = """
    members AS (SELECT l_orderkey AS room_id, l_suppkey AS user_id,
                       min(l_linenumber) AS first_line, max(l_linenumber) AS last_line
                FROM lineitem GROUP BY 1, 2),
    sends AS (SELECT l_orderkey * 10 + l_linenumber AS message_id, l_orderkey AS room_id,
                     max(l_suppkey) AS sender_id, l_linenumber AS line
              FROM lineitem GROUP BY l_orderkey, l_linenumber),
    receipts AS (SELECT message_id, user_id, (line - first_line) * 100 + user_id % 100
                   AS latency_ms
                 FROM sends JOIN members USING (room_id)
                 WHERE line >= first_line AND user_id <> sender_id)"""


def _delivery(spark, sf):
    """Order threads: the suppliers of an order are its members, its line numbers the
    messages. A member receives what comes after their own first line, and has read up to
    their last."""
    lines = b.table(spark, sf, "lineitem")
    members = lines.groupBy(F.col("l_orderkey").alias("room_id"),
                            F.col("l_suppkey").alias("user_id")).agg(
        F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"))
    sends = lines.groupBy(F.col("l_orderkey").alias("room_id"),
                          F.col("l_linenumber").alias("line")).agg(
        F.max("l_suppkey").alias("sender_id")).withColumn(
        "message_id", F.col("room_id") * 10 + F.col("line"))
    receipts = sends.join(members, "room_id").where(
        (F.col("line") >= F.col("first_line")) & (F.col("user_id") != F.col("sender_id"))
    ).select("message_id", "user_id",
             ((F.col("line") - F.col("first_line")) * 100 + F.col("user_id") % 100)
             .alias("latency_ms"))
    return members, sends, receipts


@query("delivery_audit", f"""
    WITH {_DELIVERY}
    SELECT message_id, room_id, user_id FROM sends JOIN members USING (room_id)
    WHERE user_id <> sender_id
      AND (message_id, user_id) NOT IN (SELECT (message_id, user_id) FROM receipts)""")
def delivery_audit(spark, sf):
    members, sends, receipts = _delivery(spark, sf)
    return delivery.delivery_audit(sends, members, receipts)


@query("delivery_status", f"""
    WITH {_DELIVERY}
    SELECT s.message_id, s.room_id, s.sender_id,
      CASE WHEN EXISTS (SELECT 1 FROM members m WHERE m.room_id = s.room_id
              AND m.user_id <> s.sender_id AND m.room_id * 10 + m.last_line >= s.message_id)
             THEN 'read'
           WHEN EXISTS (SELECT 1 FROM receipts r WHERE r.message_id = s.message_id
              AND r.user_id <> s.sender_id) THEN 'delivered'
           ELSE 'sent' END AS status
    FROM sends s""")
def delivery_status(spark, sf):
    members, sends, receipts = _delivery(spark, sf)
    cursors = members.withColumn("last_read_message_id",
                                 F.col("room_id") * 10 + F.col("last_line"))
    return delivery.delivery_status(sends, receipts, cursors)


@query("fanout_stats", f"""
    WITH {_DELIVERY},
    runs AS (SELECT message_id, line AS run_id FROM sends),
    got AS (SELECT run_id, latency_ms FROM receipts JOIN runs USING (message_id))
    SELECT run_id, sent, coalesce(delivered, 0) AS delivered, max_ms, p50_ms, p90_ms, p95_ms
    FROM (SELECT run_id, count(*) AS sent FROM runs GROUP BY run_id)
    LEFT JOIN (SELECT run_id, count(*) AS delivered, max(latency_ms) AS max_ms,
                      quantile_disc(latency_ms, 0.5) AS p50_ms,
                      quantile_disc(latency_ms, 0.9) AS p90_ms,
                      quantile_disc(latency_ms, 0.95) AS p95_ms FROM got GROUP BY run_id)
      USING (run_id)""")
def fanout(spark, sf):
    """One load-test run per line number."""
    _, sends, receipts = _delivery(spark, sf)
    return fanout_stats(sends.withColumnRenamed("line", "run_id"), receipts)


# --- paging and grouping -----------------------------------------------------------------

@query("message_grouping", """
    WITH flagged AS (
      SELECT event_id AS message_id, user_id AS room_id, event_type AS sender_id, ts,
             CASE WHEN event_type = 'signup' THEN 'ai' ELSE 'user' END AS kind,
             lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_type
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    headed AS (
      SELECT *, prev_ts IS NULL OR CAST(prev_ts AS DATE) <> CAST(ts AS DATE) AS new_day,
             kind = 'ai' OR coalesce(prev_type = 'signup', false)
               OR prev_ts IS NULL OR CAST(prev_ts AS DATE) <> CAST(ts AS DATE)
               OR prev_type <> sender_id OR ts - prev_ts > INTERVAL 12 HOUR AS show_header
      FROM flagged)
    SELECT message_id, room_id, sender_id, new_day, show_header,
           CAST(sum(CAST(show_header AS INTEGER)) OVER (PARTITION BY room_id
             ORDER BY ts, message_id) AS BIGINT) AS run_id FROM headed""")
def message_grouping(spark, sf):
    """Each user's events as a room, event types as senders, a twelve-hour gap."""
    rows = b.table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), F.col("user_id").alias("room_id"),
        F.col("event_type").alias("sender_id"), F.col("ts").cast("timestamp")
        .alias("created_at"),
        F.when(F.col("event_type") == "signup", "ai").otherwise("user").alias("kind"))
    return paging.message_grouping(rows, 12 * 3600).drop("created_at", "kind")


@query("keyset_page", """
    WITH ranked AS (
      SELECT *, row_number() OVER (PARTITION BY room_id
               ORDER BY created_at DESC, message_id DESC) AS n,
             count(*) OVER (PARTITION BY room_id) AS total FROM b_messages)
    SELECT room_id, (n - 1) // 50 AS page, count(*) AS rows,
           arg_min(message_id, n) AS first_id, arg_max(message_id, n) AS last_id,
           CASE WHEN max(n) < max(total) THEN
             arg_max(left(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z_'
                     || message_id, n) END AS next_cursor
    FROM ranked GROUP BY ALL""")
def keyset_page(spark, sf):
    """Every page of 50 of every room, newest first."""
    return paging.all_pages(
        b.messages(spark, sf).select("room_id", "message_id", "created_at"), ["room_id"],
        [F.desc("created_at"), F.desc("message_id")], 50,
        paging.next_cursor_text(F.col("created_at"), F.col("message_id")), "message_id")


@query("id_cursor_page", """
    WITH rows AS (
      SELECT 'rooms' AS listing, CAST(0 AS BIGINT) AS room_id, r_regionkey AS id,
             row_number() OVER (ORDER BY r_regionkey) AS n, count(*) OVER () AS total,
             2 AS size FROM region WHERE r_regionkey <> 4
      UNION ALL
      SELECT 'documents', doc_id % 5, doc_id,
             row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id DESC),
             count(*) OVER (PARTITION BY doc_id % 5), 50 FROM documents)
    SELECT listing, room_id, (n - 1) // size AS page, count(*) AS rows,
           arg_min(id, n) AS first_id, arg_max(id, n) AS last_id,
           CASE WHEN max(n) < max(total) THEN CAST(arg_max(id, n) AS VARCHAR) END
             AS next_cursor
    FROM rows GROUP BY listing, room_id, (n - 1) // size""")
def id_cursor_page(spark, sf):
    """Room directory ascending, pages of 2; documents per room descending, pages of 50."""
    rooms = b.rooms(spark, sf).where(~F.col("is_dm")).select(
        F.lit("rooms").alias("listing"), F.lit(0).cast("bigint").alias("room_id"),
        F.col("room_id").alias("id"))
    documents = b.docs(spark, sf).select(
        F.lit("documents").alias("listing"), "room_id", F.col("doc_id").alias("id"))
    keys, text = ["listing", "room_id"], F.col("id").cast("string")
    return paging.all_pages(rooms, keys, ["id"], 2, text, "id").unionByName(
        paging.all_pages(documents, keys, [F.desc("id")], 50, text, "id"))


@query("last_n_chronological", """
    SELECT room_id, message_id,
           CAST(row_number() OVER (PARTITION BY room_id ORDER BY message_id) AS INTEGER)
             AS position
    FROM (SELECT room_id, message_id, row_number() OVER (PARTITION BY room_id
            ORDER BY message_id DESC) AS back FROM b_messages) WHERE back <= 200""")
def last_n_chronological(spark, sf):
    return paging.last_n_chronological(b.messages(spark, sf).select("room_id", "message_id"))


# --- presence, typing, invites -----------------------------------------------------------

_PRESENCE = f"""
    moves AS (SELECT user_id, ts, event_id,
                CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS delta
              FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error')),
    summed AS (SELECT *, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
               FROM moves),
    floored AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id
                  ORDER BY ts, event_id)) AS c FROM summed),
    stepped AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY user_id
                  ORDER BY ts, event_id), 0) AS before FROM floored),
    edges AS (SELECT * FROM stepped WHERE (before = 0 AND c = 1) OR (before = 1 AND c = 0)),
    spans AS (SELECT user_id, ts AS online_at, c,
                lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS offline_at
              FROM edges)"""


def _connections(spark, sf):
    return b.table(spark, sf, "events").where(F.col("event_type") != "signup").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("delta"))


@query("presence_intervals", f"""
    WITH {_PRESENCE}
    SELECT user_id, {_time('online_at')} AS online_at, {_time('offline_at')} AS offline_at
    FROM spans WHERE c = 1""")
def presence_intervals(spark, sf):
    """Clicks and views connect, purchases and errors disconnect."""
    return presence.presence_intervals(_connections(spark, sf))


@query("online_snapshot", f"""
    WITH {_PRESENCE}
    SELECT user_id FROM spans WHERE c = 1 AND online_at <= TIMESTAMP '2024-01-15'
      AND (offline_at IS NULL OR offline_at > TIMESTAMP '2024-01-15')
    ORDER BY user_id LIMIT 1000""")
def online_snapshot(spark, sf):
    return presence.online_snapshot(_connections(spark, sf), "2024-01-15 00:00:00")


@query("online_members", f"""
    WITH {_PRESENCE}
    SELECT room_id, count(*) AS online FROM b_memberships
    WHERE user_id IN (SELECT user_id FROM spans WHERE c = 1
      AND online_at <= TIMESTAMP '2024-01-15'
      AND (offline_at IS NULL OR offline_at > TIMESTAMP '2024-01-15'))
    GROUP BY room_id""")
def online_members(spark, sf):
    online = presence.online_users(_connections(spark, sf), "2024-01-15 00:00:00")
    return presence.online_members(b.memberships(spark, sf), online)


@query("typing_sessions", f"""
    WITH rows AS (
      SELECT user_id, ts, event_id, event_type = 'purchase' AS is_stop,
             lag(ts) OVER w AS prev_ts, lag(event_type = 'purchase') OVER w AS prev_stop
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (
      SELECT *, sum(CASE WHEN NOT is_stop AND (prev_ts IS NULL OR prev_stop
                  OR ts - prev_ts >= INTERVAL 30 MINUTE) THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM rows)
    SELECT user_id, CAST(session AS BIGINT) AS session,
           {_time('min(ts) FILTER (WHERE NOT is_stop)')} AS started_at,
           {_time("least(max(ts) FILTER (WHERE NOT is_stop) + INTERVAL 30 MINUTE, "
                  "min(ts) FILTER (WHERE is_stop))")} AS ended_at
    FROM numbered WHERE session > 0 GROUP BY user_id, session""")
def typing_sessions(spark, sf):
    """Purchases stop typing, everything else starts it; spans expire after 30 minutes."""
    rows = b.table(spark, sf, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (F.col("event_type") == "purchase").alias("is_stop"))
    return presence.typing_sessions(rows, 1800)


@query("invite_redemption", """
    WITH tries AS (
      SELECT o_orderkey AS attempt_id, c_mktsegment AS invite_id, o_custkey AS user_id,
             o_orderdate AS moment, o_orderdate < TIMESTAMP '2001-01-01'
               AND NOT (c_mktsegment = 'FURNITURE' AND o_orderdate >= TIMESTAMP '1995-02-01')
               AS alive
      FROM orders JOIN customer ON c_custkey = o_custkey),
    first AS (
      SELECT invite_id, user_id, moment, attempt_id,
             row_number() OVER (PARTITION BY invite_id ORDER BY moment, attempt_id) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY invite_id, user_id
                      ORDER BY moment, attempt_id) AS n FROM tries WHERE alive) WHERE n = 1)
    SELECT t.attempt_id, t.invite_id, t.user_id,
      CASE WHEN NOT t.alive THEN 'invalid'
           WHEN f.attempt_id = t.attempt_id THEN 'accepted'
           WHEN l.moment IS NOT NULL AND (t.moment, t.attempt_id) > (l.moment, l.attempt_id)
             THEN 'invalid'
           WHEN f.attempt_id IS NOT NULL THEN 'member' ELSE 'invalid' END AS outcome
    FROM tries t
    LEFT JOIN first f ON f.invite_id = t.invite_id AND f.user_id = t.user_id
                     AND f.place <= 100
    LEFT JOIN first l ON l.invite_id = t.invite_id AND l.place = 100""")
def invite_redemption(spark, sf):
    """Orders as redemption attempts on their segment's invite; one segment is revoked."""
    attempts = b.table(spark, sf, "orders").join(
        b.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("attempt_id"), F.col("c_mktsegment").alias("invite_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("attempted_at"))
    invites = b.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("invite_id")).distinct().withColumns({
            "max_redemptions": F.lit(100),
            "expires_at": F.to_timestamp(F.lit("2001-01-01")),
            "revoked_at": F.when(F.col("invite_id") == "FURNITURE",
                                 F.to_timestamp(F.lit("1995-02-01")))})
    return presence.invite_redemption(attempts, invites)


# Sixty invites to twelve rooms; some close early, users may be in three rooms and are in up to one.
@query("invite_redemption_rooms", """
    WITH RECURSIVE tries AS (
      SELECT event_id AS attempt_id, event_id % 60 AS invite_id, event_id % 12 AS room, user_id,
             row_number() OVER (ORDER BY ts, event_id) AS n,
             NOT (event_id % 60 = 7 AND ts >= TIMESTAMP '2024-01-10') AS alive,
             user_id % 12 = event_id % 12 AND user_id % 2 = 0 AS old,
             6 + event_id % 60 AS places, 3 - user_id % 2 AS free
      FROM events WHERE event_type IN ('click', 'signup')),
    walk AS (
      SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i BIGINT, u BIGINT, r BIGINT)[]) AS won,
             CAST(NULL AS VARCHAR) AS outcome
      UNION ALL
      SELECT n, CASE outcome WHEN 'accepted' THEN list_append(won, struct_pack(
               i := invite_id, u := user_id, r := room)) ELSE won END, outcome
      FROM (SELECT t.*, w.won, CASE
              WHEN NOT alive OR len(list_filter(w.won, lambda x: x.i = t.invite_id)) >= places
                THEN 'invalid'
              WHEN old OR len(list_filter(w.won, lambda x: x.u = t.user_id AND x.r = t.room)) > 0
                THEN 'member'
              WHEN len(list_filter(w.won, lambda x: x.u = t.user_id)) >= free THEN 'room_limit'
              ELSE 'accepted' END AS outcome
            FROM walk w JOIN tries t ON t.n = w.n + 1))
    SELECT attempt_id, invite_id, user_id, outcome FROM tries JOIN walk USING (n)""")
def invite_redemption_rooms(spark, sf):
    """Clicks and signups as attempts: several invites lead to a room and users try several rooms, so
    the places of an invite and the rooms of a user bind each other."""
    events = b.table(spark, sf, "events").where(F.col("event_type").isin("click", "signup"))
    attempts = events.select(
        F.col("event_id").alias("attempt_id"), (F.col("event_id") % 60).alias("invite_id"), "user_id",
        F.col("ts").cast("timestamp").alias("attempted_at"))
    invites = attempts.select("invite_id").distinct().withColumns({
        "room_id": F.col("invite_id") % 12, "max_redemptions": F.col("invite_id") + 10,
        "used": F.lit(4), "expires_at": F.to_timestamp(F.lit("2100-01-01")),
        "revoked_at": F.when(F.col("invite_id") == 7, F.to_timestamp(F.lit("2024-01-10")))})
    users = events.select("user_id").distinct()
    members = users.where("user_id % 2 = 0").select("user_id", (F.col("user_id") % 12).alias("invite_id"))
    joined = users.select("user_id", (F.col("user_id") % 2).alias("rooms"))
    return presence.invite_redemption(attempts, invites, members, joined=joined, room_limit=3)


# --- limits ------------------------------------------------------------------------------

@query("rate_limit", """
    WITH RECURSIVE ev AS (
      SELECT event_id, user_id, epoch_us(ts) AS t,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    st AS (
      SELECT event_id, user_id, rn, [t] AS log, CAST(0 AS BIGINT) AS mute, true AS allowed,
             CAST(0 AS BIGINT) AS retry FROM ev WHERE rn = 1
      UNION ALL
      SELECT event_id, user_id, rn,
        CASE WHEN t < mute THEN log WHEN len(kept) >= 3 THEN [] ELSE list_append(kept, t) END,
        CASE WHEN t >= mute AND len(kept) >= 3 THEN t + 21600000000 ELSE mute END,
        t >= mute AND len(kept) < 3,
        CASE WHEN t < mute THEN (mute - t + 500000) // 1000000
             WHEN len(kept) >= 3 THEN 21600 ELSE 0 END
      FROM (SELECT e.event_id, e.user_id, e.rn, e.t, st.log, st.mute,
                   list_filter(st.log, lambda x: x > e.t - 86400000000) AS kept
            FROM st JOIN ev e ON e.user_id = st.user_id AND e.rn = st.rn + 1))
    SELECT user_id, event_id, allowed, CAST(retry AS BIGINT) AS retry_after FROM st""")
def rate_limit(spark, sf):
    """Three actions a day, six hours' mute: the test users are slow."""
    events = b.table(spark, sf, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return limits.rate_limit(events, (3, 86_400, 21_600))


@query("rate_limit_split", PLAIN_SQL["rate_limit"])
def rate_limit_split(spark, sf):
    """The same by the parallel form, as for a key of more rows than one task may walk."""
    events = b.table(spark, sf, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return limits.rate_limit(events, (3, 86_400, 21_600), max_walk_rows=20, max_group_rows=500)


@query("unread_counts_split", PLAIN_SQL["unread_counts"])
def unread_counts_split(spark, sf):
    """Unread counts by ranges of a room's messages, as for a room of millions."""
    return activity.unread_counts(b.memberships(spark, sf), b.messages(spark, sf), max_group_rows=500)


@query("breaker_windows", f"""
    WITH RECURSIVE ev AS (
      SELECT stream_id, provider, epoch_us(created_at) AS t, ok,
             row_number() OVER (PARTITION BY provider ORDER BY created_at, stream_id) AS rn
      FROM b_ai_calls),
    st AS (
      SELECT stream_id, provider, rn, t, CASE WHEN ok THEN [] ELSE [t] END AS log,
             CAST(0 AS BIGINT) AS until, false AS opened FROM ev WHERE rn = 1
      UNION ALL
      SELECT stream_id, provider, rn, t,
        CASE WHEN ok OR (len(kept) >= 3 AND t >= until) THEN [] ELSE kept END,
        CASE WHEN NOT ok AND len(kept) >= 3 AND t >= until THEN t + 1800000000 ELSE until END,
        NOT ok AND len(kept) >= 3 AND t >= until
      FROM (SELECT e.stream_id, e.provider, e.rn, e.t, e.ok, st.until,
                   list_append(list_filter(st.log, lambda x: e.t - x < 3600000000), e.t)
                     AS kept
            FROM st JOIN ev e ON e.provider = st.provider AND e.rn = st.rn + 1))
    SELECT provider, stream_id, {_time('make_timestamp(t)')} AS opened_at,
           {_time('make_timestamp(t + 1800000000)')} AS open_until FROM st WHERE opened""")
def breaker_windows(spark, sf):
    """Three failures in an hour open for half an hour."""
    return limits.breaker_windows(b.ai_calls(spark, sf), 3, 3600, 1800)


@query("breaker_windows_split", PLAIN_SQL["breaker_windows"])
def breaker_windows_split(spark, sf):
    """The same by the parallel form, as for an outage of more failures than one task may walk."""
    return limits.breaker_windows(b.ai_calls(spark, sf), 3, 3600, 1800, max_walk_rows=5,
                                  max_group_rows=500)
