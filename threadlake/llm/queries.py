"""Registered queries of the operators and, where SQL can say it, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import (
    chat, chunkprint, decontaminate, langid, mixing, passages, pii, ranked, repair, secrets,
    sharding, simhash, toxicity,
)
from threadlake.llm.common import materialize, table
from threadlake.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def register(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(use_utc(spark), sf_dir)
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


# Shares are resharing solved in one step: the sources with the lowest bound per weight are held.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM rows GROUP BY source),
steps AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS remaining
  FROM sources
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, place
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (
  SELECT rest, remaining FROM steps WHERE cap * remaining > rest * weight
  ORDER BY cap / weight, place LIMIT 1),
goals AS (
  SELECT s.source, s.source_size,
         CASE WHEN s.cap * s.remaining > s.rest * s.weight
                OR s.cap / s.weight > f.rest / f.remaining
              THEN (f.rest * s.weight)::DOUBLE / f.remaining::DOUBLE
              ELSE s.cap::DOUBLE END AS target
  FROM steps s LEFT JOIN free f ON true),
sums AS (
  SELECT r.*, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END::BIGINT AS epochs,
         count(*) OVER (PARTITION BY r.source, r.k) AS n,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k
           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS before
  FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(
         (floor(target)::BIGINT - epochs * source_size - before) / n))))::BIGINT AS taken
FROM sums
"""


@query("op1_mixing", MIX_SQL)
def op1(spark, sf_dir):
    """Words that the mix takes of every document."""
    return mixing.plan(table(spark, sf_dir, "documents"))


@query("op2_passages")
def op2(spark, sf_dir):
    """Passages that documents share with an earlier document."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_sharding")
def op3(spark, sf_dir):
    """Shard and slot of every document; equal texts stay together, sizes are near equal.

    Small groups enter the bins in bundles of up to 1/512 of a shard, larger ones by themselves, so the
    packing task is bounded; an item that fits no bin's room goes to the emptiest one.
    """
    return sharding.plan(table(spark, sf_dir, "documents")).withColumns({
        "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("sharding_capacity", """
    WITH sizes AS (
      SELECT coalesce(strlen(text), 0) + 1 AS size, coalesce(text, chr(0) || 'null') AS same FROM documents),
    groups AS (SELECT same, sum(size)::BIGINT AS size FROM sizes GROUP BY same)
    SELECT count(*) AS groups, sum(size)::BIGINT AS bytes, true AS all_fit, true AS few_shards FROM groups""")
def sharding_capacity(spark, sf_dir):
    """The fewest shards of 256 KiB for all groups of equal texts: whether every shard holds to the
    capacity (a larger group is alone), and whether they are at most 11/9 of the least possible
    number, and one a zone."""
    capacity = 1 << 18
    groups = materialize(table(spark, sf_dir, "documents").select(
        sharding.size_bytes(F.col("text")).alias("_size"),
        sharding.group_key(F.col("text")).alias("_group")).groupBy("_group").agg(
        F.sum("_size").alias("_size")), "groups")
    shards = groups.join(sharding.pack(groups, capacity), "_group").groupBy("_shard").agg(
        F.sum("_size").alias("held"), F.count(F.lit(1)).alias("n"), F.max("_size").alias("largest"))
    # a group above the capacity fills the shards that its size would
    least = F.ceil(F.sum("held") / capacity)
    zones = F.ceil(F.sum("held") / (capacity * sharding.ZONE_SHARDS))
    return shards.agg(
        F.sum("n").alias("groups"), F.sum("held").cast("bigint").alias("bytes"),
        F.every((F.col("held") <= capacity) | (F.col("n") == 1)).alias("all_fit"),
        (F.count(F.lit(1)) <= 11 * least / 9 + zones).alias("few_shards"))


@query("op4_secrets")
def op4(spark, sf_dir):
    """Secrets in every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query("op5_decontaminate")
def op5(spark, sf_dir):
    """Benchmark texts found in documents: one row per document and text."""
    return decontaminate.matches(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "benchmark"))


@query("op6_language")
def op6(spark, sf_dir):
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2,
                      F.lit(False))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), F.col("verdict.lang").alias("lang_pred"),
        F.col("verdict.score").alias("score"), F.col("verdict.accepted").alias("accepted"))


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
said AS (
  SELECT *, CASE WHEN contains(role, '<|turn|>') OR contains(role, '<|text|>')
                   OR contains(text, '<|turn|>') OR contains(text, '<|end|>')
            THEN 1 ELSE 0 END AS level FROM rows),
shown AS (
  SELECT *, '<|turn|>' || level
            || CASE level WHEN 1 THEN replace(role, '<|', '<||') ELSE role END || '<|text|>'
            || CASE level WHEN 1 THEN replace(text, '<|', '<||') ELSE text END || '<|end|>' AS line
  FROM said),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, line) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, line)
                  FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(line))::BIGINT AS formatted_chars
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM whole
"""


@query("op7_chat", CHAT_SQL)
def op7(spark, sf_dir):
    """Every conversation, and one made of control strings, formatted and read back."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the two rows as a relation of the plan
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"))
    return chat.digest(chat.format_turns(talks.unionByName(extra)))


@query("op8_simhash")
def op8(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op9_fingerprint")
def op9(spark, sf_dir):
    """Fingerprint of every document and of its edited text, with likenesses."""
    return chunkprint.edited_neighbours(table(spark, sf_dir, "documents"))


def _pii_sql() -> str:
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN substr({digits}, -i, 1)::INT
           ELSE 2 * substr({digits}, -i, 1)::INT
                - CASE WHEN substr({digits}, -i, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
    plain = "replace(hit, ' ', '')"
    mod97 = f"""list_reduce(list_prepend(0, list_transform(
      string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c:
      CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
      lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1"""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
               "list_max(list_transform(string_split(hit, '.'), lambda p: p::DOUBLE)) <= 255"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        "iban": (pii.EXPRESSIONS["iban"],
                 f"NOT touched AND length({plain}) BETWEEN 15 AND 34 AND {mod97}"),
    }

    def hits(kind, expression, keep):
        known = " OR ".join(f"contains(near, '{w}')" for w in pii.CONTEXT[kind])
        return f"""
SELECT rid, '{kind}' AS kind, start, hit,
       round({pii.SCORES[kind]}::DOUBLE + CASE WHEN {known} THEN {pii.CONTEXT_BONUS} ELSE 0 END, 2)
         AS score
FROM (SELECT rid, i, hits[i] AS hit, lower(right(gaps[i], {pii.CONTEXT_CHARS})) AS near,
             list_sum(list_transform(gaps[1:i], lambda g: length(g)))
             + CASE WHEN i > 1 THEN list_sum(list_transform(hits[1:i - 1], lambda h: length(h)))
                    ELSE 0 END AS start,
             regexp_matches(right(gaps[i], 1), '[A-Za-z0-9]')
             OR regexp_matches(left(gaps[i + 1], 1), '[A-Za-z0-9]') AS touched
      FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
            FROM (SELECT rid, regexp_extract_all(t, '{expression}') AS hits,
                         string_split_regex(t, '{expression}') AS gaps FROM d)))
WHERE {keep}"""

    union = "\nUNION ALL ".join(hits(k, *v) for k, v in kinds.items())
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    filled = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)
    order = "ORDER BY list_position(['email', 'ip', 'card', 'phone', 'iban'], kind), start"
    line = "kind || ':' || start || ':' || (start + length(hit))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({union}),
sums AS (
  SELECT rid, {counts}, string_agg({line}, ',' {order}) AS spans,
         string_agg(score::VARCHAR, ',' {order}) AS scores,
         string_agg({line}, ',' {order}) FILTER (WHERE kind <> 'iban') AS base
  FROM found GROUP BY rid)
SELECT doc_id, {filled}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN sums USING (rid)
"""


@query("op10_pii", _pii_sql())
def op10(spark, sf_dir):
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs))


RANK_SQL = r"""
WITH docs AS (
  SELECT rid, doc_id, ws FROM (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents)
  WHERE len(ws) > 0),
wanted AS (
  SELECT DISTINCT ino, item_id, w FROM (
    SELECT row_number() OVER () AS ino, item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark)),
sums AS (SELECT count(*)::BIGINT AS n_all, sum(len(ws))::BIGINT AS l_all FROM docs),
held AS (
  SELECT rid, doc_id, len(ws)::BIGINT AS n, w, count(*)::BIGINT AS tf
  FROM (SELECT rid, doc_id, ws, unnest(ws) AS w FROM docs)
  WHERE w IN (SELECT w FROM wanted) GROUP BY rid, doc_id, ws, w),
worth AS (
  SELECT w, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM held, sums GROUP BY w, n_all),
scores AS (
  SELECT ino, item_id, rid, doc_id, sum(weight * ((1000000000 * tf)
           // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_all) // l_all)))))::BIGINT AS score
  FROM wanted JOIN held USING (w) JOIN worth USING (w), sums
  GROUP BY ino, item_id, rid, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY ino ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank
  FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op11_ranked", RANK_SQL)
def op11(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _repair_sql() -> str:
    crc = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(said, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: xor(a >> 8, crc_table[1 + (xor(a, b) & 255)])))"""
    far = 1 << 40

    def state(name):  # states: nothing said, after the system, a user, an assistant row
        return f"struct_pack(c := {name}.c, a := {name}.a, r := {name}.r)"

    def grown(name, cost, letter, line=None):
        said = f"{name}.r" if line is None else f"list_append({name}.r, {line})"
        return f"struct_pack(c := {name}.c + {cost}, a := {name}.a || '{letter}', r := {said})"

    def where(condition, name, cost, letter, line):
        return f"CASE WHEN {condition} THEN {grown(name, cost, letter, line)} END"

    kept, user, assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    first, extra = "left(role, 1)", "CASE fault WHEN 3 THEN 3 ELSE 0 END"
    deleted = {x: grown(x, 4, "D") for x in ("t0", "t1", "t2", "t3")}
    same = {"s0": "t0", "s1": "t1", "s2": "t2", "s3": "t3"}
    ways = {
        "s0": [deleted["t0"]],
        "s1": [deleted["t1"], where(f"{first} = 's'", "t0", extra, "K", kept)],
        "s2": [deleted["t2"], *[where(f"{first} = 'u'", x, extra, "K", kept) for x in ("t0", "t1", "t3")],
               *[where("true", x, f"3 + {extra}", "R", user) for x in ("t0", "t1", "t3")]],
        "s3": [deleted["t3"], where(f"{first} = 'a'", "t2", extra, "K", kept),
               where("true", "t2", f"3 + {extra}", "R", assistant)]}
    step = ", ".join(
        # rows that must go leave the states as they were before any insertion
        f"CASE WHEN fault IN (1, 2) THEN {grown(x.replace('s', 'p'), 4, 'D')} "
        f"ELSE list_min([{', '.join(ways[x])}]) END AS {x}" for x in same)
    user_in = [grown(x, 3, "I", "'user:'") for x in ("s0", "s1", "s3")]
    inserted = f"""SELECT conv, i, s0 AS p0, s1 AS p1, s2 AS p2, s3 AS p3, s0 AS t0, s1 AS t1, t2,
             list_min([s3, {grown('t2', 3, 'I', "'assistant:'")}]) AS t3
      FROM (SELECT *, list_min([s2, {', '.join(user_in)}]) AS t2 FROM walk)"""
    never = f"struct_pack(c := {far}::BIGINT, a := '', r := []::VARCHAR[])"
    return rf"""
WITH RECURSIVE crcs AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc_table),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said
  FROM conversations),
marked AS (
  SELECT conv_id, turn, role, text, xor({crc}, 4294967295) % 20 AS kind FROM keyed, crcs),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
           AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE kind <> 0),
convs AS (
  SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT conv, turn, role, text, row_number() OVER (
           PARTITION BY conv ORDER BY turn NULLS FIRST, role,
           md5(length(role) || ':' || role || text)) AS i
  FROM damaged d JOIN convs c ON d.conv_id IS NOT DISTINCT FROM c.conv_id),
judged AS (
  SELECT *, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
      WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    left(lag(role) OVER (PARTITION BY conv ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed),
walk AS (
  SELECT conv, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', r := []::VARCHAR[]) AS s0,
         {never} AS s1, {never} AS s2, {never} AS s3 FROM convs
  UNION ALL
  SELECT t.conv, j.i,
         {step}
  FROM ({inserted}) t JOIN judged j ON j.conv = t.conv AND j.i = t.i + 1),
least AS (
  SELECT conv, list_min([p0, t3]) AS best FROM ({inserted}) t
  QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1),
sums AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(array_to_string(best.r, chr(10))) AS repaired_sha256
FROM convs JOIN least USING (conv) LEFT JOIN sums USING (conv)
"""


@query("op12_repair", _repair_sql())
def op12(spark, sf_dir):
    """Every conversation, damaged and repaired: its faults, least edits and what is left."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.digest(turns, repair.repair(repair.damage(turns)))


@query("op13_toxicity")
def op13(spark, sf_dir):
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="score").select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))
