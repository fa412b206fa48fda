"""The warehouse job: bronze folder in, gold folder out, reports as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators import star
from threadlake.session import materialize
from threadlake.sources.bronze import read_bronze
from threadlake.sources.gold import read_gold, register_gold, replace_days, write_gold

# The reports as SQL over the gold views. ``:as_of`` takes the place of today's date.
REPORTS = {
    "token_spend": """
        WITH spend AS (
          SELECT date_key, provider, model, count(*) AS calls, sum(total_tokens) AS tokens,
                 sum(latency_ms) AS ms, count_if(cached) AS cache_hits
          FROM fact_ai_call GROUP BY ALL)
        SELECT date, provider, model, calls, tokens,
               ((ms * 20 + calls) DIV (calls * 2)) / 10D AS avg_latency_ms, cache_hits
        FROM spend JOIN dim_date USING (date_key)
        ORDER BY date DESC, tokens DESC, provider, model""",
    "answer_quality": """
        WITH votes AS (
          SELECT kind, count(*) AS answers, count_if(is_thumbs_up) AS up,
                 count_if(is_thumbs_down) AS down,
                 count_if(is_thumbs_up OR is_thumbs_down) AS rated
          FROM fact_ai_call WHERE ok GROUP BY kind)
        SELECT kind, answers, up, down,
               ((up * 2000 + rated) DIV nullif(rated * 2, 0)) / 10D AS pct_positive
        FROM votes ORDER BY answers DESC, kind""",
    "active_rooms": """
        WITH recent AS (
          SELECT a.* FROM fact_room_activity_daily a LEFT SEMI JOIN dim_date d
            ON d.date_key = a.date_key
           AND d.date >= CAST(:as_of AS DATE) - INTERVAL 30 DAY)
        SELECT name, is_dm, ai_enabled, sum(message_count) AS messages,
               sum(ai_answer_count) AS ai_answers,
               max(distinct_sender_count) AS peak_daily_speakers
        FROM recent JOIN dim_room USING (room_id)
        GROUP BY name, is_dm, ai_enabled
        ORDER BY messages DESC, name, is_dm, ai_enabled LIMIT 20""",
    "retrieval_health": """
        WITH health AS (
          SELECT source_count, count(*) AS answers, sum(retrieval_hits) AS hits,
                 count_if(is_thumbs_up) AS up
          FROM fact_ai_call WHERE kind IN ('room-ask', 'global-ask', 'catchup')
          GROUP BY source_count)
        SELECT source_count, answers, ((hits * 20 + answers) DIV (answers * 2)) / 10D AS avg_hits,
               ((up * 2000 + answers) DIV (answers * 2)) / 10D AS pct_up
        FROM health ORDER BY source_count""",
    "signup_cohort": """
        SELECT year(account_created_at) AS year, month(account_created_at) AS month,
               count(*) AS signups
        FROM dim_user WHERE account_created_at IS NOT NULL GROUP BY ALL ORDER BY year, month""",
}


def build_gold(users: DataFrame, rooms: DataFrame, messages: DataFrame, calls: DataFrame,
               include_text: bool = False) -> dict[str, DataFrame]:
    """All gold tables as DataFrames, in catalog order."""
    fact_message = star.fact_message(messages, include_text)
    fact_ai_call = star.fact_ai_call(calls, include_text)
    return {
        "dim_date": star.dim_date(fact_message, fact_ai_call),
        "dim_user": star.dim_user(users),
        "dim_room": star.dim_room(rooms),
        "fact_message": fact_message,
        "fact_ai_call": fact_ai_call,
        "fact_room_activity_daily": star.room_activity_daily(fact_message),
    }


def run_warehouse(spark: SparkSession, bronze_root: str, gold_root: str,
                  include_text: bool = False) -> dict[str, int]:
    """Transform bronze into gold. The facts are written first; the calendar and the rollup
    then read the written facts instead of repeating the de-duplication."""
    gold = build_gold(*[read_bronze(spark, bronze_root, name)
                        for name in ("users", "rooms", "messages", "aicalls")], include_text)
    counts = {name: write_gold(gold[name], gold_root, name)
              for name in ("dim_user", "dim_room", "fact_message", "fact_ai_call")}
    facts = {name: spark.read.schema(gold[name].schema).parquet(f"{gold_root}/{name}")
             for name in ("fact_message", "fact_ai_call")}
    counts["dim_date"] = write_gold(star.dim_date(*facts.values()), gold_root, "dim_date")
    counts["fact_room_activity_daily"] = write_gold(
        star.room_activity_daily(facts["fact_message"]), gold_root, "fact_room_activity_daily")
    return counts


def refresh_messages(spark: SparkSession, bronze_root: str, gold_root: str,
                     changed: DataFrame) -> list[int]:
    """Bring the message facts and their rollup up to date after an extract; returns the days written.

    ``changed(id)`` are the messages of which bronze has new versions. The days they were on and the
    days they are on now are written anew, from the old facts of other messages and the newest
    versions of these; other day folders keep their files.
    """
    ids = materialize(changed.select(F.col("id").cast("string").alias("message_id")).distinct(), "changed")
    versions = read_bronze(spark, bronze_root, "messages").join(
        ids.withColumnRenamed("message_id", "id"), "id", "left_semi")
    fresh = materialize(star.fact_message(versions), "fresh")
    old = spark.read.schema(fresh.schema).parquet(f"{gold_root}/fact_message")
    touched = old.join(ids, "message_id", "left_semi").select("date_key").union(
        fresh.select("date_key")).distinct()
    days = sorted(r[0] for r in touched.where("date_key IS NOT NULL").collect())  # days, not rows
    if days:
        kept = old.where(F.col("date_key").isin(days)).join(ids, "message_id", "left_anti")
        replace_days(kept.unionByName(fresh), gold_root, "fact_message", days)
        now = spark.read.schema(fresh.schema).parquet(f"{gold_root}/fact_message")
        replace_days(star.room_activity_daily(now.where(F.col("date_key").isin(days))), gold_root,
                     "fact_room_activity_daily", days)
        calls = read_gold(spark, gold_root, "fact_ai_call")
        write_gold(materialize(star.dim_date(now, calls), "dates"), gold_root, "dim_date")
    return days


def run_report(spark: SparkSession, name: str, as_of: str | None = None) -> DataFrame:
    """One named report over the registered gold views."""
    text = REPORTS[name]
    return spark.sql(text, args={"as_of": as_of} if ":as_of" in text else None)


def run_all_reports(spark: SparkSession, gold_root: str, as_of: str) -> dict[str, DataFrame]:
    register_gold(spark, gold_root)
    return {name: run_report(spark, name, as_of) for name in REPORTS}
