"""Exact top-k by cosine inside permitted rooms, without pairing every query and point as rows.

A room's points and the queries allowed in it are dealt over tasks of bounded size, so no hot room
reaches one task whole, and a vector travels once for each of the other side's parts. Inside a task
points are grouped by their nearest pivot. A cell's widest angle from its pivot gives an upper bound on
the similarity any of its points can have with a query (triangle inequality of angles). Cells are
visited from the most promising on; those that cannot beat a query's k-th best score so far are
skipped. The result is exact. What is left is matrix products that emit k rows per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.constants import LEG_LIMIT
from threadlake.operators.ordered import top_within

BLOCK_POINTS = 4096
MAX_PIVOTS = 1024
POINTS_PER_PIVOT = 16_384
# Points and queries of one task, and queries multiplied at once.
TASK_POINTS, TASK_QUERIES, QUERY_ROWS = 16_384, 16_384, 512
# Scores are compared after rounding to six decimals; bounds leave room for that.
_SLACK = 2e-6


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def best_rows(scores: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, positions of the k greatest values; equal values keep column order."""
    out = []
    for row in scores:
        if len(row) > k:
            floor = np.partition(row, len(row) - k)[len(row) - k]
            near = np.flatnonzero(row >= floor)
        else:
            near = np.arange(len(row))
        out.append(near[np.argsort(-row[near], kind="stable")][:k])
    return out


def units(vectors: pd.Series) -> np.ndarray:
    """The vectors in double precision at length one; zero stays zero."""
    values = _stack(vectors)
    size = np.sqrt(np.cumsum(values * values, axis=1)[:, -1:])
    return np.divide(values, size, out=values, where=size > 0)


def _pivots(points: DataFrame, count: int) -> np.ndarray:
    """A spread-out sample of at most MAX_PIVOTS vectors; the only data kept on the driver."""
    rows = points.orderBy(F.xxhash64("point_id"), "point_id").limit(count).collect()
    return units(pd.Series([r["vector"] for r in rows]))


class Best:
    """The k best (score, smaller position) of each row, of candidates added bit by bit."""

    def __init__(self, rows: int, k: int):
        self.k, self.pending = k, 0
        self.floor, self.last = np.full(rows, -np.inf), np.full(rows, -1, dtype=np.int64)
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]

    def add(self, rows: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(scores, 6)
        able = (scores > self.floor[rows]) | (scores == self.floor[rows]) & (places < self.last[rows])
        self.found.append((rows[able], places[able], scores[able]))
        self.pending += int(able.sum())
        if self.pending > 2 * self.k * len(self.floor) or np.isinf(self.floor).any():
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, places, scores = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((places, -scores, rows))
        first = np.searchsorted(rows[order], rows[order], "left")
        rank = np.arange(len(order)) - first
        kept = order[rank < self.k]
        full = order[rank == self.k - 1]
        self.floor[rows[full]], self.last[rows[full]] = scores[full], places[full]
        self.found, self.pending = [(rows[kept], places[kept], scores[kept])], 0
        return self.found[0]


def nearest(pivots: np.ndarray | None, block_points: int):
    """``(asked, held, k) -> (row, place, score)``: exact, by cells if there are pivots."""

    def run(asked: np.ndarray, held: np.ndarray, k: int):
        order = np.arange(len(held))
        starts = np.arange(0, len(held), block_points)
        if pivots is not None:
            cosines = np.clip(held @ pivots.T, -1.0, 1.0)
            cell = cosines.argmax(axis=1)
            order = np.argsort(cell, kind="stable")
            held, cell, angle = held[order], cell[order], np.arccos(cosines[order, cell[order]])
            new = np.flatnonzero(np.diff(cell, prepend=-1))
            starts = np.concatenate([np.arange(low, high, block_points) for low, high in zip(
                new, [*new[1:], len(held)])])
            radius = np.maximum.reduceat(angle, starts)
        ends = np.append(starts[1:], len(held))
        out = []
        for low in range(0, len(asked), QUERY_ROWS):
            some = asked[low:low + QUERY_ROWS]
            best, bound, visits = Best(len(some), k), None, [[i] for i in range(len(starts))]
            if pivots is not None:
                angles = np.arccos(np.clip(some @ pivots.T, -1.0, 1.0))
                bound = np.cos(np.maximum(0.0, angles[:, cell[starts]] - radius))
                ranked = np.argsort(-bound.mean(axis=0))
                early = int(np.searchsorted(np.cumsum((ends - starts)[ranked]), 8 * k)) + 1
                visits = [ranked[:early].tolist(), *[[i] for i in ranked[early:].tolist()]]
            for cells in visits:
                live = np.arange(len(some)) if bound is None else np.flatnonzero(
                    bound[:, cells].max(axis=1) >= best.floor - _SLACK)
                if not len(live):
                    continue
                places = np.concatenate([np.arange(starts[i], ends[i]) for i in cells])
                scores = some[live] @ held[places].T
                least = best.floor[live]
                if len(places) > k and np.isinf(least).any():
                    least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
                r, c = np.nonzero(scores >= (least - _SLACK)[:, None])
                best.add(live[r], order[places[c]], scores[r, c])
            r, c, scores = best.settle()
            out.append((r + low, c, scores))
        return tuple(np.concatenate(c) for c in zip(*out))

    return run


def score_rooms(queries: DataFrame, points: DataFrame, scope: DataFrame, k: int, task_points: int,
                best) -> DataFrame:
    """Top k of every query and part of a room, by ``best`` over the unit vectors of a task."""
    parts = scope.groupBy("room_id").agg(F.count(F.lit(1)).alias("_q")).join(
        points.groupBy("room_id").agg(F.count(F.lit(1)).alias("_n")), "room_id").select(
        "room_id", F.ceil(F.col("_n") / F.lit(task_points)).cast("int").alias("_blocks"),
        F.ceil(F.col("_q") / F.lit(TASK_QUERIES)).cast("int").alias("_chunks"))

    def dealt(rows: DataFrame, id_: str, own: str, other: str) -> DataFrame:
        return rows.join(parts, "room_id").select(
            id_, "room_id", "vector",
            F.pmod(F.xxhash64(id_), F.col(f"_{own}s")).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(f"_{other}s") - 1)).alias(other))

    asked = dealt(scope.join(queries.select("query_id", "vector"), "query_id"), "query_id", "chunk", "block")
    held = dealt(points.select("point_id", "room_id", "vector"), "point_id", "block", "chunk")
    schema = (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
              f"point_id {points.schema['point_id'].dataType.simpleString()}, "
              f"room_id {points.schema['room_id'].dataType.simpleString()}, score double")

    def multiply(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "point_id": [], "room_id": [], "score": []})
        held = held.sort_values("point_id")
        rows, places, scores = best(units(asked["vector"]), units(held["vector"]), k)
        return pd.DataFrame({
            "query_id": asked["query_id"].to_numpy()[rows],
            "point_id": held["point_id"].to_numpy()[places],
            "room_id": held["room_id"].iloc[0], "score": scores})

    keys = ["room_id", "block", "chunk"]
    # both sides may descend from the same table: fresh names keep their columns apart
    held = held.select("point_id", "vector", F.col("room_id"), *[F.col(c).alias(f"_{c}") for c in keys])
    return asked.groupBy(*keys).cogroup(held.groupBy(*[f"_{c}" for c in keys])).applyInPandas(
        multiply, schema)


def vector_knn(queries: DataFrame, points: DataFrame, scope: DataFrame, k: int = LEG_LIMIT,
               block_points: int = BLOCK_POINTS,
               points_per_pivot: int = POINTS_PER_PIVOT) -> DataFrame:
    """(query_id, point_id, room_id, score, rank): exact top k over the rooms in scope.

    ``queries(query_id, vector)``, ``points(point_id, room_id, vector)``,
    ``scope(query_id, room_id)``. The score is the cosine with six decimals, whatever the length
    of the vectors; ties go to the smaller point id.
    """
    points = points.select("point_id", "room_id", "vector")
    total = points.count()
    if total == 0:
        return points.sparkSession.createDataFrame(
            [], "query_id {}, point_id {}, room_id {}, score double, rank int".format(
                queries.schema["query_id"].dataType.simpleString(),
                points.schema["point_id"].dataType.simpleString(),
                points.schema["room_id"].dataType.simpleString()))
    order = [F.desc("score"), "point_id"]
    few = total <= block_points * 16  # a handful of blocks: no bounds
    pivots = None if few else _pivots(points, max(1, min(MAX_PIVOTS, total // points_per_pivot)))
    hits = score_rooms(queries, points, scope, k, TASK_POINTS, nearest(pivots, block_points))
    return top_within(hits, ["query_id"], order, k, "rank")
