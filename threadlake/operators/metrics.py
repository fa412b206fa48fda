"""Operational metrics: call log summary, quotas, ceilings, fan-out statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.constants import DAILY_TOKEN_QUOTA, PRICES
from threadlake.functions.scalar import cost_usd, ratio_1dp
from threadlake.operators.ordered import nearest_rank, windowed


def price_lookup(calls: DataFrame, prices: list[tuple[str, str, str]] = PRICES) -> DataFrame:
    """Add the decimal cost of every call; models without a price cost nothing.

    The price list is a fixed literal of a few rows, so broadcasting it is always safe.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("model"),
                              F.lit(i).cast("decimal(12,6)").alias("price_in"),
                              F.lit(o).cast("decimal(12,6)").alias("price_out"))
                     for m, i, o in prices])
    table = calls.sparkSession.range(1).select(F.inline(rows))
    return calls.join(F.broadcast(table), "model", "left").withColumn(
        "cost_millionths", cost_usd(F.col("tokens_in"), F.col("tokens_out"),
                                    F.col("price_in"), F.col("price_out"))
    ).drop("price_in", "price_out")


def _dollars(millionths) -> F.Column:
    return F.round(F.coalesce(millionths, F.lit(0)).cast("double") / 1e6, 6)


def ai_call_metrics(calls: DataFrame, as_of, hours: int = 168) -> DataFrame:
    """One row over the calls of the last ``hours``.

    Model answers are calls that succeeded and were not served from cache; latency, tokens
    and cost describe those. The hit rate is over all calls; the saved cost is what the
    cached ones would have cost.
    """
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = price_lookup(calls.where(F.col("created_at") >= since))
    answer = F.col("ok") & ~F.col("cached")
    flagged = recent.withColumns({"answer": answer, "scope": F.lit("all")})
    n_answers = F.count_if("answer")
    totals = flagged.groupBy("scope").agg(
        F.count(F.lit(1)).alias("requests"),
        n_answers.alias("answers"),
        F.count_if("cached").alias("cache_hits"),
        F.count_if(~F.col("ok")).alias("failures"),
        ratio_1dp(F.sum(F.when(answer, F.col("tokens_in"))), n_answers).alias("avg_tokens_in"),
        ratio_1dp(F.sum(F.when(answer, F.col("tokens_out"))), n_answers)
        .alias("avg_tokens_out"),
        _dollars(F.sum(F.when(answer, F.col("cost_millionths")))).alias("total_cost"),
        F.when(n_answers > 0, F.round(
            F.sum(F.when(answer, F.col("cost_millionths"))).cast("double") / 1e6 / n_answers,
            6)).otherwise(0.0).alias("cost_per_answer"),
        ratio_1dp(F.count_if("cached") * 100, F.count(F.lit(1))).alias("hit_rate_pct"),
        _dollars(F.sum(F.when(F.col("cached"), F.col("cost_millionths")))).alias("cost_saved"),
    )
    latency = nearest_rank(flagged.where("answer"), ["scope"], "latency_ms",
                           {"latency_p50": 50, "latency_p95": 95})
    # two one-row results side by side, without a join
    both = totals.unionByName(latency, allowMissingColumns=True).drop("scope")
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).na.fill(
        0, ["latency_p50", "latency_p95"])


def calls_by_kind(calls: DataFrame) -> DataFrame:
    return calls.groupBy("kind").agg(F.count(F.lit(1)).alias("calls"))


def public_stats(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: messages ever sent, questions answered."""
    each = messages.agg(F.count(F.lit(1)).alias("messages"), F.lit(0).cast("bigint")
                        .alias("answers")).unionByName(
        calls.agg(F.lit(0).cast("bigint").alias("messages"),
                  F.count_if("ok").alias("answers")))
    return each.agg(F.sum("messages").alias("messages"), F.sum("answers").alias("answers"))


def daily_token_usage(calls: DataFrame, quota: int = DAILY_TOKEN_QUOTA) -> DataFrame:
    """Tokens used and left per user and UTC day."""
    tokens = F.greatest(F.lit(0), F.col("tokens")).cast("bigint")
    return (calls.groupBy("user_id", F.to_date("created_at").alias("day"))
            .agg(F.sum(tokens).alias("used"))
            .withColumn("remaining", F.greatest(F.lit(0), F.lit(quota) - F.col("used"))))


def quota_decisions(calls: DataFrame, quota: int = DAILY_TOKEN_QUOTA,
                    **split) -> DataFrame:
    """Allow a call while the day's earlier calls stay under the quota.

    The check comes before the call, so the last allowed one may overshoot. Refused calls use
    nothing, yet the running sum over all earlier calls gives the same answers: once it has
    reached the quota every later call of the day is refused.
    """
    rows = calls.withColumns({
        "day": F.to_date("created_at"),
        "_tokens": F.greatest(F.lit(0), F.col("tokens")).cast("bigint")})
    run = windowed(rows, ["user_id", "day"], ["created_at", "stream_id"],
                   {"used_before": ("sum_before", "_tokens")}, **split)
    used = F.coalesce("used_before", F.lit(0)).cast("bigint")
    return run.withColumn("used_before", used).withColumn(
        "allowed", F.col("used_before") < quota).drop("_tokens")


def ceiling_audit(rows: DataFrame, owner: str, ceiling: int) -> DataFrame:
    """Owners that have reached a per-owner ceiling."""
    counts = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("owned"))
    return counts.where(F.col("owned") >= ceiling)


def fanout_stats(sends: DataFrame, receipts: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: messages sent, deliveries, and nearest-rank delivery latencies."""
    sent = sends.groupBy(run).agg(F.count(F.lit(1)).alias("sent"))
    got = receipts.join(sends.select("message_id", run), "message_id").withColumn(
        "latency_ms", F.col("latency_ms").cast("bigint"))
    delivered = got.groupBy(run).agg(F.count(F.lit(1)).alias("delivered"),
                                     F.max("latency_ms").alias("max_ms"))
    ranks = nearest_rank(got, [run], "latency_ms", {"p50_ms": 50, "p90_ms": 90, "p95_ms": 95})
    return sent.join(delivered, run, "left").join(ranks, run, "left").na.fill(
        0, ["delivered"])
