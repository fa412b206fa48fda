"""Sliding-window rate limits and circuit-breaker windows over event logs.

Both are small state machines per key, and a busy key may hold a large share of all rows. The
timelines are therefore cut at pauses long enough for the state to be empty again; the pieces
are spread over all tasks and each task walks its sorted pieces row by row with a few
numbers of state. Nothing collects a group. A rate-limited key that never pauses would still
be one long walk; ``_refusals`` finds its refusals in parallel instead.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.constants import (
    BREAKER_COOLDOWN_SECONDS, BREAKER_THRESHOLD, BREAKER_WINDOW_SECONDS, MESSAGE_RATE,
)
from threadlake.operators.ordered import largest_group, rank_within, windowed
from threadlake.session import materialize


# Rows of one stretch that a single task may walk.
MAX_WALK_ROWS = 20_000_000


class SlidingWindow:
    """State of one key: accepted times inside the window and the end of a mute (micros)."""

    def __init__(self, limit: int, window: int, mute: int):
        self.limit, self.window, self.mute = limit, window, mute
        self.times: deque[int] = deque()
        self.muted_until = 0

    def offer(self, now: int) -> tuple[bool, int]:
        """(allowed, seconds to wait)."""
        if now < self.muted_until:
            return False, (self.muted_until - now + 500_000) // 1_000_000
        while self.times and self.times[0] <= now - self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            self.muted_until = now + self.mute
            self.times.clear()
            return False, self.mute // 1_000_000
        self.times.append(now)
        return True, 0


def _pieces(rows: DataFrame, keys: list[str], order: list[str], pause: int,
            **split) -> DataFrame:
    """Number the stretches of a key's timeline that lie between pauses."""
    split.setdefault("largest", largest_group(rows, keys))
    marked = rows.withColumn("_at", F.struct("_us"))
    prev = windowed(marked, keys, order, {"_prev": ("lag", "_at")}, **split)
    cut = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev")["_us"] >= pause)
    return windowed(prev.withColumn("_cut", cut.cast("bigint")), keys, order,
                    {"_piece": ("sum", "_cut")}, **split).drop("_at", "_prev", "_cut")


def _chunks(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    at = F.desc("_j") if descending else F.asc("_j")
    return rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", at)


def _refusals(ranked: DataFrame, key: str, limit: int, window: int, mute: int,
              chunk_rows: int, **split) -> DataFrame:
    """(key, _pos): the actions that start a mute, for timelines too long to walk.

    Action j can start a mute when its ``limit`` predecessors lie inside the window and its
    phase began before all of them. The next phase begins at the first action after the mute,
    so the following mute starts at the first such action ``limit`` places later.
    """
    earlier = ranked.select(key, (F.col("_pos") + limit).alias("_pos"),
                            F.col("_us").alias("_then"))
    full = materialize(ranked.join(earlier, [key, "_pos"]).where(
        F.col("_us") - F.col("_then") < window).select(key, "_pos", "_us"), "full")
    return _chain(ranked, full, key, mute, F.col("_n") + 1 + limit, chunk_rows, **split)


def _openings(ranked: DataFrame, key: str, threshold: int, window: int, cooldown: int,
              chunk_rows: int, **split) -> DataFrame:
    """(key, _pos): the failures that open a breaker, for outages too long to walk.

    Failure j can open it when it and the ``threshold - 1`` before it are of one run and inside the
    window. Then the failures start anew, so the next opening is the first such failure
    ``threshold`` places later that comes after the cooldown.
    """
    earlier = ranked.select(key, (F.col("_pos") + threshold - 1).alias("_pos"),
                            F.col("_us").alias("_then"), F.col("_run").alias("_then_run"))
    full = materialize(ranked.join(earlier, [key, "_pos"]).where(
        (F.col("_us") - F.col("_then") < window) & (F.col("_run") == F.col("_then_run"))).select(
        key, "_pos", "_us"), "full")
    return _chain(ranked, full, key, cooldown,
                  F.greatest(F.col("_n") + 1, F.col("_tie") + threshold), chunk_rows, **split)


def _chain(ranked: DataFrame, full: DataFrame, key: str, hold: int, least: Column,
           chunk_rows: int, **split) -> DataFrame:
    """(key, _pos): the candidates ``full(key, _pos, _us)`` that really happen.

    After candidate ``_tie`` the next one is the first at position ``least`` or later, where ``_n``
    is the number of rows before its hold is over: a link that depends on the candidate alone. What
    happens is the chain of links from the key's first candidate. It is followed in parallel: every
    chunk of positions reduces to a few steps (entry range -> exit), one pass over these steps finds
    each chunk's entry, and the chunks mark their part of the chain.
    """
    none = F.lit(None).cast("bigint")
    ends = full.select(key, (F.col("_us") + hold).alias("_at"), F.lit(0).alias("_side"),
                       F.col("_pos").alias("_tie"), F.lit(0).cast("bigint").alias("_one"))
    timeline = ends.unionByName(ranked.select(
        key, F.col("_us").alias("_at"), F.lit(1).alias("_side"), F.col("_pos").alias("_tie"),
        F.lit(1).cast("bigint").alias("_one")))
    passed = windowed(timeline, [key], ["_at", "_side", "_tie"], {"_n": ("sum", "_one")},
                      **split).where("_side = 0")
    seek = passed.select(key, least.alias("_at"), F.lit(1).alias("_side"),
                         F.col("_tie").alias("_j"), none.alias("_found"))
    targets = full.select(key, F.col("_pos").alias("_at"), F.lit(0).alias("_side"),
                          F.col("_pos").alias("_j"), F.col("_pos").alias("_found"))
    found = windowed(seek.unionByName(targets), [key], [F.desc("_at"), "_side", "_j"],
                     {"_next": ("min", "_found")}, **split).where("_side = 1")
    chunk = F.call_function("div", F.col("_j"), F.lit(chunk_rows).cast("bigint"))
    links = materialize(found.select(
        key, "_j", F.coalesce("_next", F.lit(-1).cast("bigint")).alias("_next"),
        chunk.alias("_chunk")), "links")
    kind = ranked.schema[key].dataType.simpleString()

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, exits, run = None, {}, None
        for batch in batches:
            out = []
            for who, part, j, nxt in zip(batch[key], batch["_chunk"], batch["_j"],
                                         batch["_next"]):
                if (who, part) != current:
                    if run:
                        out.append(run)
                    current, exits, run = (who, part), {}, None
                exits[j] = exits.get(nxt, nxt)
                if run and run[4] == exits[j]:
                    run[2] = j
                else:
                    if run:
                        out.append(run)
                    run = [who, part, j, j, exits[j]]
            yield pd.DataFrame(out, columns=[key, "_chunk", "_low", "_high", "_exit"])
        if run:
            yield pd.DataFrame([run], columns=[key, "_chunk", "_low", "_high", "_exit"])

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, at = None, -1
        for batch in batches:
            out = []
            for who, part, low, high, leave in zip(*[batch[c] for c in (
                    key, "_chunk", "_low", "_high", "_exit")]):
                if who != current:
                    current, at = who, low
                if low <= at <= high:
                    out.append((who, part, at))
                    at = leave
            yield pd.DataFrame(out, columns=[key, "_chunk", "_entry"])

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, at = None, -1
        for batch in batches:
            hit = []
            for who, part, j, nxt, entry in zip(*[batch[c] for c in (
                    key, "_chunk", "_j", "_next", "_entry")]):
                if (who, part) != current:
                    current, at = (who, part), entry
                hit.append(j == at)
                if j == at:
                    at = nxt
            yield batch.loc[hit, [key, "_j"]].rename(columns={"_j": "_pos"})

    short = _chunks(links, key, descending=True).mapInPandas(
        steps, f"{key} {kind}, _chunk bigint, _low bigint, _high bigint, _exit bigint")
    entry = short.repartition(key).sortWithinPartitions(key, "_low").mapInPandas(
        entries, f"{key} {kind}, _chunk bigint, _entry bigint")
    return _chunks(links.join(entry, [key, "_chunk"]), key).mapInPandas(
        follow, f"{key} {kind}, _pos bigint")


def _limit_in_parallel(rows: DataFrame, key: str, limit: int, window: int, mute: int,
                       chunk_rows: int, **split) -> DataFrame:
    order = ["_us", "event_id"]
    ranked = materialize(rank_within(rows, [key], order, "_pos", **split), "ranked")
    mutes = _refusals(ranked, key, limit, window, mute, chunk_rows, **split)
    marked = ranked.join(mutes.withColumn("_mutes", F.lit(True)), [key, "_pos"], "left")
    marked = marked.withColumn("_hit", F.when(F.col("_mutes"), F.col("_us")))
    last = windowed(marked, [key], order, {"_last": ("max", "_hit")}, **split)
    left = F.col("_last") + mute - F.col("_us")
    allowed = F.col("_last").isNull() | (left <= 0)
    return last.select(
        key, "event_id", allowed.alias("allowed"),
        F.when(allowed, F.lit(0).cast("bigint")).otherwise(F.call_function(
            "div", left + 500_000, F.lit(1_000_000).cast("bigint"))).alias("retry_after"))


def rate_limit(events: DataFrame, rate: tuple[int, int, int] = MESSAGE_RATE,
               key: str = "user_id", max_walk_rows: int = MAX_WALK_ROWS,
               **split) -> DataFrame:
    """Allow or refuse every action of a key, in (ts, event_id) order.

    ``rate`` is (limit, window seconds, mute seconds). While muted every action is refused
    with the seconds left; an action over the limit starts a mute and clears the window.
    Stretches without a pause longer than ``max_walk_rows`` are solved in parallel.
    """
    limit, window, mute = rate[0], rate[1] * 1_000_000, rate[2] * 1_000_000
    rows = events.select(key, "event_id", F.unix_micros("ts").alias("_us"))
    split.setdefault("largest", largest_group(rows, [key]))
    pieces = _pieces(rows, [key], ["_us", "event_id"], max(window, mute), **split)
    if (split["largest"] > max_walk_rows
            and largest_group(pieces, [key, "_piece"]) > max_walk_rows):
        return _limit_in_parallel(rows, key, limit, window, mute, max_walk_rows,
                                  **{k: v for k, v in split.items() if k != "largest"})
    ordered = pieces.repartition(key, "_piece").sortWithinPartitions(
        key, "_piece", "_us", "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            answers = []
            for who, piece, now in zip(batch[key], batch["_piece"], batch["_us"]):
                if (who, piece) != current:
                    current, state = (who, piece), SlidingWindow(limit, window, mute)
                answers.append(state.offer(now))
            out = batch[[key, "event_id"]].copy()
            out["allowed"] = [a for a, _ in answers]
            out["retry_after"] = [s for _, s in answers]
            yield out

    kind = events.schema[key].dataType.simpleString()
    return ordered.mapInPandas(
        walk, f"{key} {kind}, event_id bigint, allowed boolean, retry_after bigint")


class Breaker:
    """State of one provider: recent failure times and the end of the open phase (micros)."""

    def __init__(self, threshold: int, window: int, cooldown: int):
        self.threshold, self.window, self.cooldown = threshold, window, cooldown
        # the last ones are enough: the window holds ``threshold`` if it holds the first of these
        self.failures: deque[int] = deque(maxlen=threshold)
        self.open_until = 0

    def success(self) -> None:
        self.failures.clear()

    def failure(self, now: int) -> bool:
        """True when this failure opens the breaker."""
        self.failures.append(now)
        if (len(self.failures) == self.threshold and now - self.failures[0] < self.window
                and now >= self.open_until):
            self.open_until = now + self.cooldown
            self.failures.clear()
            return True
        return False


def breaker_windows(calls: DataFrame, threshold: int = BREAKER_THRESHOLD,
                    window_seconds: int = BREAKER_WINDOW_SECONDS,
                    cooldown_seconds: int = BREAKER_COOLDOWN_SECONDS,
                    max_walk_rows: int = MAX_WALK_ROWS, **split) -> DataFrame:
    """Open phases per provider.

    A success clears the failure list, so only unbroken runs of at least ``threshold``
    failures can open the breaker. Successes and shorter runs are dropped before anything is
    walked; what is left is rare outside outages. Outages of more than ``max_walk_rows`` failures
    without a pause are solved in parallel.
    """
    window, cooldown = window_seconds * 1_000_000, cooldown_seconds * 1_000_000
    rows = calls.select("provider", "stream_id", "ok", F.unix_micros("created_at").alias("_us"),
                        F.col("ok").cast("bigint").alias("_ok"))
    split.setdefault("largest", largest_group(rows, ["provider"]))
    runs = windowed(rows, ["provider"], ["_us", "stream_id"], {"_run": ("sum", "_ok")}, **split)
    failures = runs.where(~F.col("ok")).drop("ok", "_ok")
    long_runs = failures.groupBy("provider", "_run").agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= threshold)
    risky = materialize(failures.join(long_runs, ["provider", "_run"], "left_semi"), "risky")
    split["largest"] = largest_group(risky, ["provider"])
    pieces = _pieces(risky, ["provider"], ["_us", "stream_id"], max(window, cooldown), **split)
    times = (F.timestamp_micros("_us").alias("opened_at"),
             F.timestamp_micros(F.col("_us") + cooldown).alias("open_until"))
    if (split["largest"] > max_walk_rows
            and largest_group(pieces, ["provider", "_piece"]) > max_walk_rows):
        rest = {k: v for k, v in split.items() if k != "largest"}
        ranked = materialize(rank_within(risky, ["provider"], ["_us", "stream_id"], "_pos", **rest),
                             "ranked")
        opened = _openings(ranked, "provider", threshold, window, cooldown, max_walk_rows, **rest)
        return ranked.join(opened, ["provider", "_pos"]).select("provider", "stream_id", *times)
    ordered = pieces.repartition("provider", "_piece").sortWithinPartitions(
        "provider", "_piece", "_us", "stream_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, run, state = None, None, None
        for batch in batches:
            opened = []
            for provider, piece, this_run, now in zip(
                    batch["provider"], batch["_piece"], batch["_run"], batch["_us"]):
                if (provider, piece) != current:
                    current, state = (provider, piece), Breaker(threshold, window, cooldown)
                elif this_run != run:
                    state.success()
                run = this_run
                opened.append(state.failure(now))
            yield batch.loc[opened, ["provider", "stream_id", "_us"]]

    return ordered.mapInPandas(walk, "provider string, stream_id bigint, _us bigint").select(
        "provider", "stream_id", *times)
