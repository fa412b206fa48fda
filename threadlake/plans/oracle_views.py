"""The bindings as DuckDB common table expressions, for the reference SQL."""

from __future__ import annotations

import re

from threadlake.constants import (
    BM25_B, BM25_K1, COMMAND_PREFIX, EMBED_DIMS, EMBED_STEP, LEG_LIMIT, NEAR_DUP_CHARS, PRICES,
    RRF_K, WIDE_SPACE,
)

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_ITEMS = ("'[' || array_to_string(list_transform(range({n}), "
          "lambda i: '{{\"index\":' || (i + 1) || '}}'), ',') || ']'")
_MODELS = "[" + ", ".join(f"'{m}'" for m, _, _ in PRICES) + ", 'unlisted']"

VIEWS: dict[str, str] = {
    "b_rooms": """
        SELECT CAST(r_regionkey AS BIGINT) AS room_id, r_name AS name, lower(r_name) AS slug,
               r_regionkey = 4 AS is_dm,
               CASE r_regionkey WHEN 3 THEN false WHEN 2 THEN NULL ELSE true END AS ai_enabled,
               CASE WHEN r_regionkey <> 0 THEN CAST(r_regionkey AS BIGINT) END AS creator_id
        FROM region""",
    "b_messages": f"""
        SELECT event_id AS message_id, event_id % 5 AS room_id, user_id AS sender_id,
               ts AS created_at, CAST({_K} AS VARCHAR) AS client_msg_id,
               CASE WHEN event_type = 'signup' THEN 'ai'
                    WHEN event_type = 'view' AND {_K} % 10 = 0 THEN NULL
                    ELSE 'user' END AS kind,
               event_type || ' ' || props AS body,
               CASE WHEN event_type = 'signup' THEN {_ITEMS.format(n=_K + ' % 4')} END
                   AS citations,
               CASE WHEN event_type = 'signup' THEN 'why ' || {_K} END AS ai_question
        FROM events""",
    "b_memberships": """
        SELECT user_id, event_id % 5 AS room_id,
               max(CASE WHEN event_type = 'view' THEN event_id END) AS last_read_message_id
        FROM events GROUP BY 1, 2
        HAVING arg_max(event_type, event_id)
               FILTER (WHERE event_type IN ('signup', 'error')) = 'signup'""",
    "b_ai_calls": f"""
        SELECT event_id AS stream_id, user_id, ts AS created_at,
               CASE event_type WHEN 'view' THEN 'global-ask' WHEN 'purchase' THEN 'catchup'
                    WHEN 'signup' THEN 'decisions' ELSE 'room-ask' END AS kind,
               'p' || ({_K} % 2) AS provider, {_MODELS}[{_K} % 7 + 1] AS model,
               {_K} * 10 AS tokens_in, {_K} AS tokens_out,
               CAST(round(value * 100) AS INTEGER) AS latency_ms,
               {_K} % 5 = 0 AS cached, event_type <> 'error' AS ok,
               CASE WHEN {_K} % 10 <= 2 THEN 'up' WHEN {_K} % 10 = 3 THEN 'down' END AS verdict,
               {_K} % 13 AS retrieval_hits, {_K} % 7 AS source_count,
               {_ITEMS.format(n=_K + ' % 7')} AS source_keys,
               'why ' || {_K} AS question, event_type || ' ' || props AS answer
        FROM events""",
    "b_texts": """
        SELECT conv_id * 100 + turn AS message_id, conv_id % 5 AS room_id,
               conv_id AS sender_id,
               CASE role WHEN 'assistant' THEN 'ai' ELSE 'user' END AS kind, text AS body,
               make_timestamp((1704067200 + (conv_id * 100 + turn) * 60) * 1000000)
                   AS created_at
        FROM conversations WHERE role <> 'system'""",
    "b_questions": """
        SELECT item_id AS query_id, item_id AS user_id, text AS question FROM benchmark""",
    "b_users": """
        SELECT c_custkey AS user_id, c_name AS username,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN min(o_orderdate) END
                   AS account_created_at,
               max(o_orderdate) AS last_seen_at
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey
        GROUP BY c_custkey, c_name, c_mktsegment""",
    "g_message": f"""
        SELECT CAST(message_id AS VARCHAR) AS message_id, CAST(room_id AS VARCHAR) AS room_id,
               CAST(sender_id AS VARCHAR) AS sender_id,
               CAST(strftime(created_at, '%Y%m%d') AS INTEGER) AS date_key, created_at, kind,
               kind = 'ai' AS is_ai_answer,
               CAST(length(body) AS INTEGER) AS body_length,
               CAST(len(regexp_split_to_array(trim(body), '\\s+')) AS INTEGER) AS word_count,
               citations IS NOT NULL AS has_citations,
               CAST(CASE WHEN json_valid(citations) AND json_type(citations) = 'ARRAY'
                    THEN json_array_length(citations) ELSE 0 END AS INTEGER) AS citation_count,
               ai_question IS NOT NULL AS has_ai_question, body
        FROM b_messages""",
    "g_ai_call": """
        SELECT CAST(stream_id AS VARCHAR) AS stream_id, CAST(user_id AS VARCHAR) AS user_id,
               CAST(strftime(created_at, '%Y%m%d') AS INTEGER) AS date_key, created_at, kind,
               provider, model, tokens_in,
               CASE WHEN kind = 'decisions' THEN 0 ELSE tokens_out END AS tokens_out,
               tokens_in + CASE WHEN kind = 'decisions' THEN 0 ELSE tokens_out END
                   AS total_tokens,
               latency_ms, kind <> 'decisions' AND cached AS cached, ok,
               CASE WHEN NOT ok THEN 'AI_FAILED' END AS error_code, verdict,
               CASE WHEN kind = 'decisions' THEN 0 ELSE retrieval_hits END AS retrieval_hits,
               CAST(source_count AS INTEGER) AS source_count,
               coalesce(verdict = 'up', false) AS is_thumbs_up,
               coalesce(verdict = 'down', false) AS is_thumbs_down
        FROM b_ai_calls""",
    "g_date": """
        SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS date
        FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)),
                                            date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d
              FROM events)""",
    "g_daily": """
        SELECT room_id, date_key, count(*) AS message_count,
               CAST(sum(CAST(is_ai_answer AS INTEGER)) AS BIGINT) AS ai_answer_count,
               count(DISTINCT sender_id) AS distinct_sender_count,
               CAST(sum(word_count) AS BIGINT) AS total_words
        FROM g_message GROUP BY room_id, date_key""",
    "k_messages": f"""
        SELECT m.* FROM b_messages m
        WHERE kind IS DISTINCT FROM 'ai' AND NOT starts_with(body, '{COMMAND_PREFIX}')""",
}

def tokens_sql(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), "
            "lambda t: length(t) > 1)")


def trimmed_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$', '', 'g')"


def normalized_sql(text: str) -> str:
    return (f"substr(trim(regexp_replace(lower({text}), '[{WIDE_SPACE}]+', ' ', 'g')), 1, "
            f"{NEAR_DUP_CHARS})")


def embedding_views(name: str, source: str) -> dict[str, str]:
    """Views that embed ``source(id, text)`` into ``<name>_vec(id, vec)``."""
    mask = "CAST(4294967295 AS UBIGINT)"
    word = "CAST({} AS UBIGINT)"
    return {
        f"{name}_parts": f"""
            SELECT id, unnest(CASE WHEN len(toks) > 0 THEN toks ELSE [text] END) AS tok
            FROM (SELECT id, text, {tokens_sql('text')} AS toks FROM {source})""",
        f"{name}_seed": f"""
            SELECT tok, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2)
                             || substr(h, 1, 2) AS UBIGINT) AS seed
            FROM (SELECT DISTINCT tok, sha256(tok) AS h FROM {name}_parts)""",
        f"{name}_mix": f"""
            SELECT tok, i, (xor(a, a >> 15) * (a | {word.format(1)})) & {mask} AS t
            FROM (SELECT tok, i, (seed + i * {word.format(EMBED_STEP)}) & {mask} AS a
                  FROM {name}_seed,
                       (SELECT CAST(unnest(range(1, {EMBED_DIMS + 1})) AS UBIGINT) AS i))""",
        f"{name}_val": f"""
            SELECT tok, i, xor(u, u >> 14) / 2147483648.0 - 1.0 AS v
            FROM (SELECT tok, i, xor(t, (t + ((xor(t, t >> 7) * (t | {word.format(61)}))
                                         & {mask})) & {mask}) AS u FROM {name}_mix)""",
        f"{name}_sum": f"""
            SELECT id, i, sum(v * n) AS v
            FROM (SELECT id, tok, count(*) AS n FROM {name}_parts GROUP BY id, tok)
            JOIN {name}_val USING (tok) GROUP BY id, i""",
        f"{name}_vec": f"""
            SELECT id, list(v / norm ORDER BY i) AS vec
            FROM (SELECT id, i, v, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm
                  FROM {name}_sum) GROUP BY id""",
    }


VIEWS.update({
    "r_scope": """
        SELECT q.query_id, m.room_id FROM b_questions q JOIN b_memberships m USING (user_id)
        JOIN b_rooms r USING (room_id) WHERE coalesce(r.ai_enabled, true)""",
    "r_corpus": f"""
        SELECT 'message:' || message_id AS key, message_id, room_id, sender_id, created_at,
               body FROM b_texts
        WHERE kind <> 'ai' AND NOT starts_with(body, '{COMMAND_PREFIX}')
          AND room_id IN (SELECT room_id FROM b_rooms WHERE coalesce(ai_enabled, true))""",
    "r_len": f"""
        SELECT key, room_id, {tokens_sql('body')} AS toks FROM r_corpus""",
    "r_tf": """
        SELECT key, room_id, len, tok, count(*) AS tf
        FROM (SELECT key, room_id, len(toks) AS len, unnest(toks) AS tok FROM r_len)
        GROUP BY ALL""",
    "r_weight": f"""
        SELECT t.key, t.room_id, t.tok,
               ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({BM25_K1} + 1)
               / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * len / mean)) AS weight
        FROM r_tf t JOIN (SELECT tok, count(*) AS df FROM r_tf GROUP BY tok) d USING (tok),
             (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(toks)) AS mean FROM r_len)""",
    "r_qtok": f"""
        SELECT query_id, unnest(list_distinct({tokens_sql('question')})) AS tok
        FROM b_questions""",
    "r_lex": f"""
        SELECT query_id, key, room_id, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank
          FROM (SELECT q.query_id, w.key, w.room_id, round(sum(weight), 6) AS score
                FROM r_qtok q JOIN r_weight w USING (tok) SEMI JOIN r_scope s
                  ON s.query_id = q.query_id AND s.room_id = w.room_id
                GROUP BY ALL)) WHERE rank <= {LEG_LIMIT}""",
    "r_ctext": "SELECT key AS id, body AS text FROM r_corpus",
    "r_qtext": "SELECT query_id AS id, question AS text FROM b_questions",
    "r_vleg": f"""
        SELECT query_id, key, room_id, score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank
          FROM (SELECT s.query_id, c.key, c.room_id,
                       round(list_dot_product(qv.vec, cv.vec), 6) AS score
                FROM r_scope s JOIN r_corpus c USING (room_id)
                JOIN q_vec qv ON qv.id = s.query_id JOIN c_vec cv ON cv.id = c.key))
        WHERE rank <= {LEG_LIMIT}""",
    "r_fused": f"""
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
                    vector_rank NULLS LAST, lexical_rank) AS fused_rank
        FROM (SELECT query_id, key, min(v) AS vector_rank, min(l) AS lexical_rank,
                     coalesce(1.0::DOUBLE / ({RRF_K} + min(v)), 0)
                     + coalesce(1.0::DOUBLE / ({RRF_K} + min(l)), 0) AS score
              FROM (SELECT query_id, key, rank AS v, NULL AS l FROM r_vleg
                    UNION ALL SELECT query_id, key, NULL, rank FROM r_lex)
              GROUP BY query_id, key)""",
    "r_once": f"""
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS final_rank
        FROM (SELECT f.*, c.room_id, c.sender_id, c.created_at, c.body, q.question,
                     row_number() OVER (PARTITION BY f.query_id, {normalized_sql('c.body')}
                                        ORDER BY fused_rank) AS copy
              FROM r_fused f JOIN r_corpus c USING (key) JOIN b_questions q USING (query_id))
        WHERE copy = 1""",
    "r_packed": """
        SELECT query_id, final_rank, source_index FROM (
          WITH RECURSIVE pick AS (
            SELECT query_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used,
                   CAST(0 AS BIGINT) AS source_index, false AS kept FROM b_questions
            UNION ALL
            SELECT p.query_id, p.r + 1,
                   CASE WHEN used + cost <= 400 THEN used + cost ELSE used END,
                   CASE WHEN used + cost <= 400 THEN source_index + 1 ELSE source_index END,
                   used + cost <= 400
            FROM pick p JOIN (
              SELECT query_id, final_rank, CAST(ceil(length(body) / 4.0) AS BIGINT) + 30 AS cost
              FROM r_once WHERE final_rank <= 12) o
              ON o.query_id = p.query_id AND o.final_rank = p.r + 1)
          SELECT query_id, r AS final_rank, source_index FROM pick WHERE kept)""",
    **embedding_views("c", "r_ctext"),
    **embedding_views("q", "r_qtext"),
})


def with_views(sql: str) -> str:
    """Put the views ``sql`` names, and the ones those name, in front as a WITH clause."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    if not views:
        return body
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if re.match(r"WITH\b", body):
        return f"WITH {views},\n{body[len('WITH'):]}"
    return f"WITH {views}\n{body}"
