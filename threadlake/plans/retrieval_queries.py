"""Registered queries: scalar functions, chunking, vectors, search, cache, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlake.constants import CACHE_ENTRIES, FUSED_LIMIT, LEG_LIMIT, RERANK_POOL
from threadlake.functions import scalar
from threadlake.functions.embedding import embed
from threadlake.operators.activity import catchup_window
from threadlake.operators import cache, evaluation, fusion, lsh, scope
from threadlake.operators.chunking import chunk_documents
from threadlake.operators.dedup import near_dup_collapse
from threadlake.operators.knn import vector_knn
from threadlake.operators.lexical import indexed_leg
from threadlake.plans import bindings as b
from threadlake.plans import search
from threadlake.plans.oracle_views import (
    embedding_views, normalized_sql, tokens_sql, trimmed_sql,
)
from threadlake.plans.registry import query
from threadlake.plans.stored import corpus
from threadlake.session import materialize, scratch_path
from threadlake.sources import points as point_table


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def _join(array: str) -> str:
    return f"array_to_string({array}, ',')"


# --- scalar functions --------------------------------------------------------------------

@query("scalar_pack", f"""
    SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS approx_tokens,
           {normalized_sql('text')} AS norm,
           regexp_replace(md5('msg:' || conv_id || '-' || turn),
             '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS point_id,
           'message:' || conv_id AS source_key, 'doc:' || conv_id || ':' || turn AS doc_key,
           sha256(text) AS token_hash, {_join(tokens_sql('text'))} AS tokens,
           {_join("list_sort(list_distinct(list_filter(list_transform(regexp_extract_all("
                  "text || ' [' || turn || '] [3] [1] [99] [250] [0]', "
                  "'\\[(\\d{1,2})\\]', 1), lambda d: CAST(d AS INTEGER)), "
                  "lambda n: n >= 1 AND n <= 5)))")} AS markers,
           substr(text, 1, 180) AS snippet,
           strftime(make_timestamp((1704067200 + (conv_id * 100 + turn) * 60) * 1000000),
                    '%Y-%m-%d %H:%M') AS header_time
    FROM conversations""")
def scalar_pack(spark, sf):
    """The text functions over every conversation turn."""
    turns = b.table(spark, sf, "conversations")
    text, turn = F.col("text"), F.col("turn").cast("string")
    answer = F.concat(text, F.lit(" ["), turn, F.lit("] [3] [1] [99] [250] [0]"))
    stamp = F.timestamp_seconds(F.lit(1704067200)
                                + (F.col("conv_id") * 100 + F.col("turn")) * 60)
    return turns.select(
        "conv_id", "turn", scalar.approx_tokens(text).alias("approx_tokens"),
        scalar.normalize_text(text).alias("norm"),
        scalar.point_id(F.concat(F.lit("msg:"), F.col("conv_id").cast("string"), F.lit("-"),
                                 turn)).alias("point_id"),
        scalar.message_key(F.col("conv_id")).alias("source_key"),
        scalar.doc_key(F.col("conv_id"), F.col("turn")).alias("doc_key"),
        scalar.token_hash(text).alias("token_hash"),
        F.array_join(scalar.tokenize(text), ",").alias("tokens"),
        F.array_join(F.transform(scalar.citation_markers(answer, F.lit(5)),
                                 lambda n: n.cast("string")), ",").alias("markers"),
        scalar.snippet(text).alias("snippet"), scalar.header_time(stamp).alias("header_time"))


@query("slugify", """
    WITH based AS (
      SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'),
               '^-+|-+$', '', 'g'), 1, 32) AS cut FROM pages),
    named AS (SELECT page_id, CASE WHEN cut = '' THEN 'room' ELSE cut END AS base FROM based)
    SELECT page_id, CASE WHEN page_id = min(page_id) OVER (PARTITION BY base) THEN base
      ELSE base || '-' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6) END AS slug
    FROM named""")
def slugify(spark, sf):
    """Slugs of page addresses; the first page keeps a slug, later ones get a suffix."""
    return scope.assign_slugs(b.table(spark, sf, "pages").select("page_id", "url"),
                              "page_id", "url")


@query("permission_fingerprint", """
    SELECT user_id AS query_id,
           substr(sha256('global|' || string_agg(CAST(room_id AS VARCHAR), ','
                         ORDER BY CAST(room_id AS VARCHAR))), 1, 32) AS fingerprint
    FROM b_memberships JOIN b_rooms USING (room_id)
    WHERE coalesce(ai_enabled, true) GROUP BY user_id""")
def permission_fingerprint(spark, sf):
    members = b.memberships(spark, sf)
    askers = members.select("user_id").distinct().withColumn("query_id", F.col("user_id"))
    return cache.scope_fingerprints(scope.permission_scope(askers, members, b.rooms(spark, sf)))


# --- chunks and vectors ------------------------------------------------------------------

_CHUNKS = f"""
    clean AS (SELECT doc_id, doc_id % 5 AS room_id, source AS filename, text AS raw,
                     {trimmed_sql("replace(text, chr(13) || chr(10), chr(10))")} AS text
              FROM documents),
    cut AS (
      SELECT doc_id, room_id, filename, raw, i,
             CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, i * 1700 + 1, 2000) END
               AS piece
      FROM (SELECT *, unnest(range(CASE WHEN length(text) <= 2000 THEN 1
              ELSE 1 + CAST(ceil((length(text) - 2000) / 1700.0) AS BIGINT) END)) AS i
            FROM clean)),
    chunks AS (
      SELECT doc_id, room_id, filename,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER)
               AS chunk_index,
             {trimmed_sql('piece')} AS text,
             CAST(greatest(1, least(i * 1700 // 3000 + 1,
                                    1 + greatest(length(raw) - 1, 0) // 3000)) AS INTEGER)
               AS page
      FROM cut WHERE length({trimmed_sql('piece')}) > 0)"""


@query("chunk_documents", f"WITH {_CHUNKS} SELECT * FROM chunks")
def chunk_documents_query(spark, sf):
    return chunk_documents(b.docs(spark, sf))


@query("hash_embed", """
    SELECT id AS message_id, array_to_string(list_transform(vec, lambda v:
             CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR)), ',') AS vector
    FROM c_vec""")
def hash_embed(spark, sf):
    """Vectors of all searchable texts, as integers of millionths."""
    kept = scope.knowledge_filter(b.texts(spark, sf), b.rooms(spark, sf))
    return kept.select(
        scalar.message_key(F.col("message_id")).alias("message_id"),
        F.array_join(F.transform(embed(F.col("body")), lambda v: F.round(v * 1_000_000)
                                 .cast("bigint").cast("string")), ",").alias("vector"))


def _vector_setup(spark, sf):
    vectors = b.table(spark, sf, "embeddings")
    points = vectors.select(F.col("vec_id").alias("point_id"),
                            F.col("label").cast("bigint").alias("room_id"),
                            F.col("embedding").alias("vector"))
    queries = vectors.select(F.col("vec_id").alias("query_id"),
                             F.col("embedding").alias("vector"))
    return points, queries


# Every vector asks in three of the ten rooms that the labels make, so all take part.
_KNN_SQL = f"""
    SELECT query_id, point_id, room_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank
      FROM (SELECT q.query_id, p.vec_id AS point_id, q.room_id,
                   round(list_dot_product(q.vec, CAST(p.embedding AS DOUBLE[]))
                         / sqrt(list_dot_product(q.vec, q.vec))
                         / sqrt(list_dot_product(CAST(p.embedding AS DOUBLE[]),
                                                 CAST(p.embedding AS DOUBLE[]))), 6) AS score
            FROM (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vec,
                         unnest([vec_id % 10, (vec_id + 3) % 10, (vec_id + 7) % 10]) AS room_id
                  FROM embeddings) q
            JOIN embeddings p ON p.label = q.room_id)) WHERE rank <= {LEG_LIMIT}"""


def _knn(spark, sf, **bounds):
    points, queries = _vector_setup(spark, sf)
    allowed = queries.select("query_id", F.explode(F.array(*[
        (F.col("query_id") + n) % 10 for n in (0, 3, 7)])).alias("room_id"))
    return vector_knn(queries, points, allowed, **bounds)


@query("vector_knn", _KNN_SQL)
def vector_knn_query(spark, sf):
    """Every vector asks in three rooms."""
    return _knn(spark, sf)


@query("vector_knn_bounded", _KNN_SQL)
def vector_knn_bounded(spark, sf):
    """The same with blocks so small that cells are skipped by their bounds."""
    return _knn(spark, sf, block_points=16, points_per_pivot=50)


@query("vector_knn_recall", f"""
    SELECT count(DISTINCT query_id) AS questions, count(*) AS exact_hits, true AS recall_reached
    FROM ({_KNN_SQL})""")
def vector_knn_recall(spark, sf):
    """Whether the hyperplane search finds at least 95 of 100 of the exact search's hits."""
    points, queries = _vector_setup(spark, sf)
    allowed = queries.select("query_id", F.explode(F.array(*[
        (F.col("query_id") + n) % 10 for n in (0, 3, 7)])).alias("room_id"))
    found = lsh.recall(vector_knn(queries, points, allowed), lsh.lsh_knn(queries, points, allowed))
    return found.select("questions", "exact_hits", (
        F.col("found_hits") >= 0.95 * F.col("exact_hits")).alias("recall_reached"))


@query("count_points", """
    SELECT CAST(count(*) AS BIGINT) AS points FROM embeddings""")
def count_points(spark, sf):
    return point_table.count_points(_vector_setup(spark, sf)[0])


@query("delete_points", """
    SELECT vec_id AS point_id, label AS room_id_int FROM embeddings
    WHERE label IN (SELECT CAST(room_id AS INTEGER) FROM b_rooms
                    WHERE coalesce(ai_enabled, true))""")
def delete_points(spark, sf):
    """The points of every room that is unknown or has memory off are deleted."""
    points, _ = _vector_setup(spark, sf)
    known = scope.enabled_rooms(b.rooms(spark, sf))
    gone = points.select("room_id").distinct().join(known, "room_id", "left_anti")
    return point_table.delete_by(points, "room_id", gone).select(
        "point_id", F.col("room_id").cast("int").alias("room_id_int"))


@query("upsert_points", """
    SELECT vec_id AS point_id, CASE WHEN label >= 5 THEN 'apple, edited' ELSE 'zebra' END
             AS version,
           array_to_string(list_transform(embedding, lambda v:
             CAST(CAST(round(CAST(v AS DOUBLE) * 1000000
                             * CASE WHEN label >= 5 THEN -1 ELSE 1 END) AS BIGINT) AS VARCHAR)),
             ',') AS vector
    FROM embeddings""")
def upsert_points(spark, sf):
    """A point table receives all vectors; then one batch brings the upper half of the labels as
    it was and as edited later, twice. The later edit wins, not the greater text."""
    vectors = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("label"), F.col("embedding").alias("vector"))
    store = point_table.PointTable(
        spark, scratch_path(spark, "points"),
        "point_id bigint, label int, version string, edited bigint, vector array<float>",
        order=("edited",))
    first = vectors.withColumns({"version": F.lit("zebra"), "edited": F.lit(1).cast("bigint")})
    store.upsert(first, 0)
    later = first.where("label >= 5").withColumns({
        "version": F.lit("apple, edited"), "edited": F.lit(2).cast("bigint"),
        "vector": F.transform("vector", lambda v: -v)})
    batch = first.where("label >= 5").unionByName(later)
    store.upsert(batch, 1)
    store.upsert(batch, 2)
    return store.read().select(
        "point_id", "version", F.array_join(F.transform("vector", lambda v: F.round(
            v.cast("double") * 1_000_000).cast("bigint").cast("string")), ",").alias("vector"))


def _suppliers(spark, sf):
    """Suppliers as the users who speak in the text corpus."""
    return b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("username"),
        F.col("s_name").alias("display_name"))


# --- search ------------------------------------------------------------------------------

def _setting(spark, sf):
    """Questions, scope, rooms, messages and the stored corpus."""
    rooms, messages = b.rooms(spark, sf), b.texts(spark, sf)
    questions = b.questions(spark, sf)
    allowed = scope.permission_scope(questions, b.memberships(spark, sf), rooms)
    return questions, allowed, rooms, messages, corpus(spark, sf)


@query("vector_leg", "SELECT query_id, key, room_id, score, CAST(rank AS INTEGER) AS rank "
                     "FROM r_vleg")
def vector_leg(spark, sf):
    questions, allowed, _, _, held = _setting(spark, sf)
    return search.vector_leg(questions, held.message_points, allowed)


_LEXICAL_SQL = "SELECT query_id, key, room_id, score, CAST(rank AS INTEGER) AS rank FROM r_lex"


@query("lexical_leg", _LEXICAL_SQL)
def lexical_leg(spark, sf):
    questions, allowed, rooms, messages, held = _setting(spark, sf)
    return search.message_lexical_leg(questions, messages, rooms, allowed, index=held.index)


@query("lexical_leg_bounded", _LEXICAL_SQL)
def lexical_leg_bounded(spark, sf):
    """The same by the bounds of the index's blocks, as for a volume beyond the direct join."""
    questions, allowed, _, _, held = _setting(spark, sf)
    return indexed_leg(questions, held.index, allowed, direct_pairs=0).withColumnRenamed(
        "doc_id", "key")


@query("rrf_fusion", """
    SELECT query_id, key, CAST(vector_rank AS INTEGER) AS vector_rank,
           CAST(lexical_rank AS INTEGER) AS lexical_rank, round(score, 9) AS score,
           CAST(fused_rank AS INTEGER) AS fused_rank FROM r_fused""")
def rrf_fusion(spark, sf):
    questions, allowed, rooms, messages, held = _setting(spark, sf)
    fused = fusion.rrf_fusion(
        search.vector_leg(questions, held.message_points, allowed),
        search.message_lexical_leg(questions, messages, rooms, allowed, index=held.index))
    return fused.withColumn("score", F.round("score", 9))


@query("near_dup_collapse", f"""
    SELECT conv_id AS query_id, turn, final_rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER)
                  AS final_rank
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, {normalized_sql('text')}
                                         ORDER BY turn) AS copy FROM conversations)
      WHERE copy = 1) WHERE final_rank <= {FUSED_LIMIT}""")
def near_dup_collapse_query(spark, sf):
    """Conversations as ranked lists, turns as ranks."""
    ranked = b.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), "turn", "text")
    return near_dup_collapse(ranked, FUSED_LIMIT, rank="turn").select(
        "query_id", "turn", "final_rank")


def _retrieved(spark, sf, limit: int = FUSED_LIMIT):
    questions, allowed, rooms, messages, held = _setting(spark, sf)
    return questions, search.hybrid_retrieve(questions, held.message_points, messages, rooms,
                                             allowed, limit, held.index)


@query("hybrid_search", """
    SELECT o.query_id, o.key, CAST(o.final_rank AS INTEGER) AS final_rank,
           coalesce(r.name, 'unknown') AS room_name,
           strftime(o.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, o.body AS text,
           coalesce(s.s_name, 'Deleted user') AS sender
    FROM r_once o LEFT JOIN b_rooms r USING (room_id)
    LEFT JOIN supplier s ON s.s_suppkey = o.sender_id WHERE o.final_rank <= 8""")
def hybrid_search(spark, sf):
    """Every passage as a search by its user: the eight best sources with their names."""
    found = _retrieved(spark, sf, 8)[1]
    named = scope.enrich_room_name(scope.source_sender(found, _suppliers(spark, sf)),
                                   b.rooms(spark, sf))
    return named.select("query_id", "key", "final_rank", "room_name", "created_at", "text",
                        "sender")


_OVERLAP = (f"len(list_filter({tokens_sql('body')}, lambda t: "
            f"list_contains({tokens_sql('question')}, t)))")


@query("rerank_overlap", f"""
    SELECT query_id, key, CAST(overlap AS INTEGER) AS overlap, CAST(rerank AS INTEGER) AS rerank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY CASE WHEN n > 6 THEN overlap END DESC, final_rank) AS rerank
          FROM (SELECT query_id, key, final_rank, {_OVERLAP} AS overlap,
                       count(*) OVER (PARTITION BY query_id) AS n
                FROM r_once WHERE final_rank <= {RERANK_POOL})) WHERE rerank <= 6""")
def rerank_overlap(spark, sf):
    return fusion.rerank_overlap(_retrieved(spark, sf, RERANK_POOL)[1]).select("query_id", "key", "overlap", "rerank")


def _packed(spark, sf):
    questions, found = _retrieved(spark, sf)
    # packing reads the list twice
    packed = fusion.pack_to_budget(materialize(found, "found"), ["query_id"], "final_rank", budget=400)
    return questions, packed.withColumn(
        "sender_name", F.concat(F.lit("user "), F.col("sender_id").cast("string")))


@query("pack_to_budget", """
    SELECT query_id, key, CAST(o.final_rank AS INTEGER) AS final_rank,
           CAST(p.source_index AS INTEGER) AS source_index
    FROM r_packed p JOIN r_once o USING (query_id, final_rank)""")
def pack_to_budget(spark, sf):
    """A budget of 400 tokens, so that large sources are passed over."""
    return _packed(spark, sf)[1].select("query_id", "key", "final_rank", "source_index")


@query("build_context", """
    SELECT query_id, '<sources>' || chr(10) || string_agg('[' || source_index
             || '] BEGIN SOURCE (message | user ' || sender_id || ' | '
             || strftime(created_at, '%Y-%m-%d %H:%M') || ')' || chr(10) || body || chr(10)
             || 'END SOURCE', chr(10) ORDER BY source_index)
           || chr(10) || '</sources>' || chr(10) || chr(10) || 'Question: ' || any_value(question)
             AS context
    FROM r_packed p JOIN r_once o USING (query_id, final_rank) GROUP BY query_id""")
def build_context(spark, sf):
    return fusion.build_context(_packed(spark, sf)[1])


@query("map_citations", """
    SELECT query_id, CAST(source_index AS INTEGER) AS index, 'message' AS kind, room_id, key,
           CAST(split_part(key, ':', 2) AS BIGINT) AS message_id, CAST(NULL AS BIGINT) AS doc_id,
           CAST(NULL AS INTEGER) AS chunk_index, CAST(NULL AS INTEGER) AS page,
           substr(body, 1, 180) AS snippet, 'user ' || sender_id AS sender_name,
           strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at
    FROM r_packed p JOIN r_once o USING (query_id, final_rank)
    WHERE source_index IN (1, 2, query_id % 10)""")
def map_citations(spark, sf):
    """An answer per question citing [2], [1], [99], [1] and the last digit of its number."""
    questions, packed = _packed(spark, sf)
    answers = questions.select("query_id", F.concat(
        F.lit("Raised [2], settled [1], unknown [99], again [1] and ["),
        (F.col("query_id") % 10).cast("string"), F.lit("]")).alias("answer"))
    return fusion.map_citations(answers, materialize(packed, "packed"))


@query("catchup_sources", """
    WITH RECURSIVE eligible AS (
      SELECT b.user_id, b.room_id, m.message_id, m.body,
             row_number() OVER (PARTITION BY b.user_id, b.room_id ORDER BY m.message_id) AS n
      FROM b_memberships b JOIN k_messages m ON m.room_id = b.room_id
       AND m.sender_id <> b.user_id AND m.message_id > coalesce(b.last_read_message_id, -1)),
    costed AS (SELECT *, CAST(ceil(length(body) / 4.0) AS BIGINT) + 30 AS cost
               FROM eligible WHERE n <= 200),
    pick AS (
      SELECT user_id, room_id, message_id, n, cost AS used, CAST(1 AS BIGINT) AS source_index,
             true AS kept FROM costed WHERE n = 1
      UNION ALL
      SELECT c.user_id, c.room_id, c.message_id, c.n,
             CASE WHEN used + cost <= 4000 THEN used + cost ELSE used END,
             CASE WHEN used + cost <= 4000 THEN source_index + 1 ELSE source_index END,
             used + cost <= 4000
      FROM pick p JOIN costed c ON c.user_id = p.user_id AND c.room_id = p.room_id
                               AND c.n = p.n + 1)
    SELECT user_id, room_id, message_id, CAST(source_index AS INTEGER) AS source_index
    FROM pick WHERE kept""")
def catchup_sources(spark, sf):
    """Catch-up windows packed into the default budget."""
    messages = b.messages(spark, sf)
    window = catchup_window(b.memberships(spark, sf), messages)
    sources = window.join(messages.select("message_id", F.col("body").alias("text")),
                          "message_id")
    packed = fusion.pack_to_budget(sources, ["user_id", "room_id"], "position")
    return packed.select("user_id", "room_id", "message_id", "source_index")


# The word list is a parameter: none of the real words occurs in the test prose, so the
# queries look for two words that do. The real list is covered by the unit tests.
_WORDS = r"(?i)\b(from|with)\b"
_DECISIONS = r"""
    recent AS (
      SELECT message_id, room_id, sender_id, created_at,
             replace(body, chr(10), ' ') AS line,
             row_number() OVER (PARTITION BY room_id ORDER BY message_id DESC) AS back
      FROM b_texts WHERE kind <> 'ai' AND NOT starts_with(body, '@recall ')),
    decisions AS (
      SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY message_id) AS position
      FROM recent WHERE back <= 200 AND length(line) > 0
        AND regexp_matches(line, '(?i)\b(from|with)\b'))"""


@query("extract_decisions", f"""
    WITH {_DECISIONS}
    SELECT room_id, CAST(position AS INTEGER) AS position, substr(line, 1, 160) AS decision,
           coalesce(s_name, 'Deleted user') AS decided_by,
           strftime(created_at, '%Y-%m-%d') AS date,
           CAST(message_id AS VARCHAR) AS source_ids
    FROM decisions LEFT JOIN supplier ON s_suppkey = sender_id WHERE position <= 10""")
def extract_decisions(spark, sf):
    found = fusion.extract_decisions(b.texts(spark, sf), _suppliers(spark, sf), _WORDS)
    return found.withColumn("source_ids", F.array_join(F.transform(
        "source_ids", lambda i: i.cast("string")), ","))


@query("citation_id_guard", f"""
    WITH {_DECISIONS}
    SELECT d.room_id, CAST(position AS INTEGER) AS position,
           CAST(message_id AS VARCHAR) AS source_ids
    FROM decisions d JOIN b_rooms r USING (room_id)
    WHERE position <= 10 AND coalesce(r.ai_enabled, true)""")
def citation_id_guard(spark, sf):
    """Each decision also claims an invented id; only memory-enabled rooms were shown."""
    texts, rooms = b.texts(spark, sf), b.rooms(spark, sf)
    claimed = fusion.extract_decisions(texts, _suppliers(spark, sf), _WORDS).withColumn(
        "source_ids", F.concat(F.array(F.lit(-1).cast("bigint")), F.col("source_ids")))
    kept = fusion.citation_id_guard(claimed, scope.knowledge_filter(texts, rooms))
    return kept.select("room_id", "position", F.array_join(F.transform(
        "source_ids", lambda i: i.cast("string")), ",").alias("source_ids"))


# --- cache -------------------------------------------------------------------------------

def _entries(spark, sf):
    """All vectors as cached answers of their label, stored in id order."""
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("entry_id"), F.col("label").alias("fingerprint"),
        F.col("vec_id").alias("stored_at"), F.col("embedding").alias("vector"))


_TRIMMED = f"""
    trimmed AS (SELECT * FROM (
      SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label
               ORDER BY vec_id DESC) AS recency FROM embeddings)
      WHERE recency <= {CACHE_ENTRIES})"""


@query("cache_trim", f"""
    WITH {_TRIMMED}
    SELECT vec_id AS entry_id, label AS fingerprint, CAST(recency AS INTEGER) AS recency
    FROM trimmed""")
def cache_trim(spark, sf):
    return cache.cache_trim(_entries(spark, sf)).select("entry_id", "fingerprint", "recency")


def _lookup_sql(threshold: float) -> str:
    return f"""
    WITH {_TRIMMED},
    scored AS (
      SELECT a.vec_id AS query_id, t.vec_id AS entry_id, t.recency,
             round(list_dot_product(CAST(a.embedding AS DOUBLE[]),
                                    CAST(t.embedding AS DOUBLE[])), 6) AS similarity
      FROM embeddings a JOIN trimmed t USING (label)),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, recency)
                  AS n FROM scored WHERE similarity >= {threshold})
    SELECT a.vec_id AS query_id, a.label AS fingerprint, best.entry_id, best.similarity
    FROM embeddings a LEFT JOIN best ON best.query_id = a.vec_id AND best.n = 1"""


def _asks(spark, sf):
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("fingerprint"),
        F.col("embedding").alias("vector"))


@query("semantic_cache_lookup", _lookup_sql(0.95))
def semantic_cache_lookup(spark, sf):
    """Every vector asked once more: repeats of the kept entries hit, the rest miss."""
    return cache.semantic_cache_lookup(_asks(spark, sf), _entries(spark, sf))


@query("semantic_cache_lookup_loose", _lookup_sql(0.25))
def semantic_cache_lookup_loose(spark, sf):
    """A low threshold, where similar but different entries hit too."""
    return cache.semantic_cache_lookup(_asks(spark, sf), _entries(spark, sf), 0.25)


@query("semantic_cache_lookup_at", f"""
    WITH e AS (
      SELECT vec_id, label, embedding, vec_id * 5 AS t,
             lead(vec_id * 5) OVER (PARTITION BY label ORDER BY vec_id) AS next FROM embeddings),
    seen AS (
      SELECT a.vec_id AS query_id, e.vec_id AS entry_id,
             round(list_dot_product(CAST(a.embedding AS DOUBLE[]),
                                    CAST(e.embedding AS DOUBLE[])), 6) AS similarity,
             row_number() OVER (PARTITION BY a.vec_id ORDER BY e.vec_id DESC) AS recency
      FROM e AS a JOIN e ON e.label = a.label AND e.t <= a.t - 1
      WHERE NOT EXISTS (SELECT 1 FROM e AS x WHERE x.label = a.label AND x.t >= e.t
                          AND x.t <= a.t - 1
                          AND least(coalesce(x.next, a.t - 1), a.t - 1) - x.t >= 24)),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, recency)
                  AS n FROM seen WHERE recency <= {CACHE_ENTRIES} AND similarity >= 0.05)
    SELECT a.vec_id AS query_id, a.label AS fingerprint, best.entry_id, best.similarity
    FROM embeddings a LEFT JOIN best ON best.query_id = a.vec_id AND best.n = 1""")
def semantic_cache_lookup_at(spark, sf):
    """An answer is stored every five hours; each vector asks an hour before its own, and
    fingerprints pause for longer than the day an entry lives."""
    hour = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 3600)
    entries = _entries(spark, sf).withColumn("stored_at", hour(F.col("entry_id") * 5))
    asks = _asks(spark, sf).withColumn("asked_at", hour(F.col("query_id") * 5 - 1))
    return cache.semantic_cache_lookup_at(asks, entries, 0.05)


# --- evaluation --------------------------------------------------------------------------

_EVAL = f"""
    WITH {_CHUNKS},
    src AS (SELECT 'doc:' || doc_id || ':' || chunk_index AS key, room_id, text FROM chunks),
    expected AS (
      SELECT q.query_id, 'doc:' || c.doc_id || ':' || min(c.chunk_index) AS key
      FROM b_questions q JOIN chunks c ON contains(c.text, q.question)
      GROUP BY q.query_id, c.doc_id),
    @EMBEDDING@,
    found AS (
      SELECT s.query_id, c.key, c.text, row_number() OVER (PARTITION BY s.query_id
               ORDER BY round(list_dot_product(qv.vec, dv.vec), 6) DESC, c.key) AS v
      FROM r_scope s JOIN src c USING (room_id) JOIN q_vec qv ON qv.id = s.query_id
      JOIN d_vec dv ON dv.id = c.key),
    legs AS (
      SELECT query_id, key, text, v, NULL AS l FROM found WHERE v <= 20
      UNION ALL SELECT query_id, key, body, NULL, rank FROM r_lex JOIN r_corpus USING (key)),
    fused AS (
      SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY score DESC, v NULLS LAST, l) AS fused_rank
      FROM (SELECT query_id, key, any_value(text) AS text, min(v) AS v, min(l) AS l,
                   coalesce(1.0::DOUBLE / (60 + min(v)), 0)
                   + coalesce(1.0::DOUBLE / (60 + min(l)), 0) AS score
            FROM legs GROUP BY query_id, key)),
    once AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, {normalized_sql('text')}
                                         ORDER BY fused_rank) AS copy FROM fused)
      WHERE copy = 1)"""


# Every message and every document is an anchor by some of its characters.
@query("anchor_join", f"""
    WITH {_CHUNKS},
    said AS (
      SELECT message_id AS query_id, room_id, substr(body, 3, 24) AS part FROM b_texts),
    written AS (
      SELECT doc_id AS query_id, doc_id % 5 AS room_id, substr(text, 3, 40) AS part FROM documents)
    SELECT s.query_id, 'said' AS anchor_id, 'message:' || min(t.message_id) AS key
    FROM said s JOIN b_texts t ON t.room_id = s.room_id AND contains(t.body, s.part) GROUP BY 1
    UNION ALL
    SELECT query_id, 'written', 'doc:' || c.doc_id || ':' || c.chunk_index
    FROM (SELECT w.query_id, min(struct_pack(doc_id := c.doc_id, chunk_index := c.chunk_index)) AS c
          FROM written w JOIN chunks c ON c.room_id = w.room_id AND contains(c.text, w.part)
          GROUP BY 1)""")
def anchor_join(spark, sf):
    """Anchors resolved to the first message, or first chunk, of their room that holds them."""
    messages, documents = b.texts(spark, sf), b.docs(spark, sf)
    anchors = messages.select(
        F.col("message_id").alias("query_id"), F.lit("said").alias("anchor_id"), "room_id",
        F.substring("body", 3, 24).alias("contains"), F.lit("message").alias("kind")).unionByName(
        documents.select(F.col("doc_id").alias("query_id"), F.lit("written").alias("anchor_id"),
                         "room_id", F.substring("text", 3, 40).alias("contains"),
                         F.lit("doc").alias("kind")))
    return evaluation.resolve_anchors(anchors, messages, corpus(spark, sf).chunks)


def _eval_sql(tail: str) -> str:
    views = ",\n".join(f"{n} AS ({sql})" for n, sql in embedding_views(
        "d", "(SELECT key AS id, text FROM src)").items())
    return _EVAL.replace("@EMBEDDING@", views) + tail


_SCORED = """,
    scored AS (
      SELECT q.query_id, count(e.key) AS expected,
             count(*) FILTER (WHERE o.rank <= 5) AS found, min(o.rank) AS best
      FROM b_questions q LEFT JOIN expected e USING (query_id)
      LEFT JOIN kept o ON o.query_id = e.query_id AND o.key = e.key GROUP BY q.query_id)"""
_KEPT = ", kept AS (SELECT * FROM once WHERE rank <= 12)"
_OVERLAP_DOC = (f"len(list_filter({tokens_sql('text')}, lambda t: "
                f"list_contains({tokens_sql('question')}, t)))")
_RERANKED = f""",
    kept AS (
      SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY
               CASE WHEN n > 6 THEN overlap END DESC, rank) AS rank
      FROM (SELECT o.*, {_OVERLAP_DOC} AS overlap, count(*) OVER (PARTITION BY query_id) AS n
            FROM once o JOIN b_questions USING (query_id) WHERE rank <= 20)
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY
               CASE WHEN n > 6 THEN overlap END DESC, rank) <= 6)"""


def _eval_setting(spark, sf, pool: int):
    """Passages as questions over document chunks and messages; expected are the first chunks
    that hold the passage, document by document."""
    questions, allowed, rooms, messages, held = _setting(spark, sf)
    found = search.hybrid_retrieve_sources(
        questions, held.chunk_points, search.message_sources(messages, rooms), messages, rooms,
        allowed, pool, held.index)
    expected = evaluation.first_chunk_keys(questions, held.chunks)
    return questions, expected, found


def _everything_sql() -> str:
    views = ",\n".join(f"{n} AS ({sql})" for n, sql in embedding_views(
        "d", "(SELECT key AS id, text FROM src)").items())
    return f"""
    WITH {_CHUNKS},
    src AS (SELECT 'doc:' || doc_id || ':' || chunk_index AS key, 'doc' AS kind, room_id, text,
                   CAST(NULL AS BIGINT) AS sender_id, filename, page,
                   CAST(NULL AS TIMESTAMP) AS created_at FROM chunks),
    {views},
    sources AS (
      SELECT key, kind, room_id, text, sender_id, filename, page, created_at, vec
      FROM src JOIN d_vec ON d_vec.id = src.key
      UNION ALL SELECT key, 'message', room_id, body, sender_id, NULL, NULL, created_at, vec
      FROM r_corpus JOIN c_vec ON c_vec.id = r_corpus.key),
    found AS (
      SELECT s.query_id, c.key, row_number() OVER (PARTITION BY s.query_id
               ORDER BY round(list_dot_product(qv.vec, c.vec), 6) DESC, c.key) AS v
      FROM r_scope s JOIN sources c USING (room_id) JOIN q_vec qv ON qv.id = s.query_id),
    fused AS (
      SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY score DESC, v NULLS LAST, l) AS fused_rank
      FROM (SELECT query_id, key, min(v) AS v, min(l) AS l,
                   coalesce(1.0::DOUBLE / (60 + min(v)), 0)
                   + coalesce(1.0::DOUBLE / (60 + min(l)), 0) AS score
            FROM (SELECT query_id, key, v, NULL AS l FROM found WHERE v <= {LEG_LIMIT}
                  UNION ALL SELECT query_id, key, NULL, rank FROM r_lex)
            GROUP BY query_id, key)),
    once AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS final_rank
      FROM (SELECT f.query_id, f.fused_rank, s.*, row_number() OVER (
                     PARTITION BY f.query_id, {normalized_sql('s.text')} ORDER BY fused_rank) AS copy
            FROM fused f JOIN sources s USING (key)) WHERE copy = 1)
    SELECT o.query_id, o.key, o.kind, CAST(o.final_rank AS INTEGER) AS final_rank,
           coalesce(r.name, 'unknown') AS room_name, o.filename, o.page,
           CASE WHEN o.kind = 'message' THEN coalesce(s.s_name, 'Deleted user') END AS sender,
           strftime(o.created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, substr(o.text, 1, 180) AS snippet
    FROM once o LEFT JOIN b_rooms r USING (room_id) LEFT JOIN supplier s ON s.s_suppkey = o.sender_id
    WHERE o.final_rank <= {FUSED_LIMIT}"""


@query("hybrid_search_documents", _everything_sql())
def hybrid_search_documents(spark, sf):
    """Every passage as a search of messages and documents together, with what a hit shows of each:
    the sender and time of a message, the file and page of a document's chunk."""
    questions, allowed, rooms, messages, held = _setting(spark, sf)
    points = held.message_points.unionByName(held.chunk_points)
    found = search.hybrid_retrieve(questions, points, messages, rooms, allowed, FUSED_LIMIT,
                                   held.index)
    named = scope.enrich_room_name(scope.source_sender(found, _suppliers(spark, sf)), rooms)
    return named.select(
        "query_id", "key", "kind", "final_rank", "room_name", "filename", "page",
        F.when(F.col("kind") == "message", F.col("sender")).alias("sender"), "created_at",
        F.substring("text", 1, 180).alias("snippet"))


@query("eval_retrieval", _eval_sql(_KEPT + _SCORED + """
    SELECT query_id, expected, found,
           round(coalesce(found / nullif(expected, 0)::DOUBLE, 0), 6) AS recall_at_5,
           round(coalesce(1.0::DOUBLE / best, 0), 6) AS reciprocal_rank FROM scored"""))
def eval_retrieval(spark, sf):
    questions, expected, found = _eval_setting(spark, sf, FUSED_LIMIT)
    return evaluation.retrieval_eval(questions, expected,
                                     found.withColumnRenamed("final_rank", "rank"))


@query("eval_compare", _eval_sql(_KEPT.replace("kept", "plain") + _RERANKED + """,
    both_runs AS (SELECT 'off' AS rerank, query_id, key, rank FROM plain
                  UNION ALL SELECT 'on', query_id, key, rank FROM kept),
    scored AS (
      SELECT m.rerank, q.query_id, count(e.key) AS expected,
             count(*) FILTER (WHERE o.rank <= 5) AS found, min(o.rank) AS best
      FROM b_questions q CROSS JOIN (VALUES ('off'), ('on')) m(rerank)
      LEFT JOIN expected e USING (query_id)
      LEFT JOIN both_runs o ON o.rerank = m.rerank AND o.query_id = e.query_id
                           AND o.key = e.key
      GROUP BY m.rerank, q.query_id)
    SELECT rerank, count(*) AS questions,
           round(avg(round(coalesce(found / nullif(expected, 0)::DOUBLE, 0), 6)), 4)
             AS recall_at_5,
           round(avg(round(coalesce(1.0::DOUBLE / best, 0), 6)), 4) AS mrr
    FROM scored GROUP BY rerank"""))
def eval_compare(spark, sf):
    """Recall and MRR over all questions, with the rerank stage off and on."""
    questions, expected, pool = _eval_setting(spark, sf, RERANK_POOL)
    pool = materialize(pool, "pool")
    plain = pool.where(F.col("final_rank") <= FUSED_LIMIT).withColumnRenamed(
        "final_rank", "rank")
    reranked = fusion.rerank_overlap(pool).withColumn("rank", F.col("rerank"))
    return evaluation.eval_summary(evaluation.retrieval_eval(questions, expected, plain)) \
        .withColumn("rerank", F.lit("off")).unionByName(
        evaluation.eval_summary(evaluation.retrieval_eval(questions, expected, reranked))
        .withColumn("rerank", F.lit("on")))
