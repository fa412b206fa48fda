"""Ranked lexical search by pipelined term partitioning.

The terms of the items are owned by ``STAGES`` stages, rare terms first. Items travel in bundles; a
bundle meets one stage after the other and carries a sparse accumulator for each item and document
it has met so far. Documents are cut into slices, so a step is a cogroup of the accumulators and the
stage's postings by (bundle, slice): whatever share of all documents a term holds, no task gets more
than a slice of it. A stage adds its integer contributions; the best are selected after the last.

Accumulators stay sparse by an exact bound. A contribution is less than a million weights, so before
a stage it is known how much an item can still gain. Accumulators that cannot reach the item's tenth
best partial score any more are dropped, and once a document met for the first time could not reach
it either, the item takes no new documents.

Documents are read once a pass: a task keeps the terms of the pass that a text holds. A pass holds
items of ``PASS_TERMS`` pairs of item and term (an item's terms are never split), so what the driver
and the broadcast hold is bounded whatever the number of items; more items take more passes.

Scores. N documents have a term, L is the number of all their terms, n of one document's; df
documents hold a term, tf times. The term's weight is ``floor(1000 ln((2N+2)/(2df+1)))``, the
document's ``m = 10 + (90 n N) div L``, and a term adds ``weight ((10^9 tf) div (1000 tf + 8 m))``.
Numbers are 64-bit integers.

Cases. Null or empty text on either side, text without a term: no rows, and not counted in N. Null
ids: ranked like others, after every id on equal scores. Repeated documents: a row each. Repeated
items: ranked each by itself. Terms of an item count once. Empty tables: no rows. Extra columns:
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.session import materialize

STAGES = 4
SLICE_ROWS, BUNDLE_ITEMS, PASS_TERMS = 1024, 256, 1 << 18
TOP = 10
# A contribution is less than this many weights.
MOST = 1_000_000
# Pairs of posting and item that a task adds at once.
_AT_ONCE = 1 << 21
_SPLIT = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c
               for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Terms of UTF-8 text in order: runs of ASCII letters, digits and other characters, A-Z lowered."""
    return (text or b"").translate(_SPLIT).split()


def weight(total: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * held + 1)))


def _spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class Lists:
    """A list of numbers for each term, one after the other."""
    first: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, size: int, keys: np.ndarray, values: np.ndarray) -> Lists:
        order = np.argsort(keys, kind="stable")
        return cls(np.searchsorted(keys[order], np.arange(size + 1)), values[order])

    def expand(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key and each of its values: place of the key, value."""
        counts = self.first[keys + 1] - self.first[keys]
        return (np.repeat(np.arange(len(keys)), counts),
                self.values[np.repeat(self.first[keys], counts) + _spans(counts)])


@dataclass
class Plan:
    """What the tasks of one pass need; its size is bounded by PASS_TERMS."""
    weights: np.ndarray          # of each term
    owner: np.ndarray            # stage of each term
    bundles: Lists               # term -> bundles with an item that has it
    items: list[Lists]           # bundle -> term -> items
    names: list[np.ndarray]      # bundle -> numbers of the items
    rest: list[np.ndarray]       # bundle -> (stages, items): most that later stages can add
    total: int
    length: int
    slices: int


def _tokenise(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        wanted = known.keys()
        for batch in batches:
            keep, sizes, terms, counts = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = words(text.as_py())
                if found:
                    held = Counter(found)
                    both = held.keys() & wanted
                    keep.append(i)
                    sizes.append(len(found))
                    terms.append([known[w] for w in both])
                    counts.append([held[w] for w in both])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "tf"])

    return run


def _held(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(total[found])], names=["term", "df"])

    return run


def _mixed(rows: np.ndarray, slices: int) -> np.ndarray:
    """Slice of each row: its number, scattered."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(slices)).astype(
            np.int64)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _blocks(shared, stage: int):
    """Postings of the terms that a stage owns, as one row per (bundle, slice) and batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            rows, ids, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            lengths = pc.list_value_length(batch.column(3)).to_numpy()
            doc = np.repeat(np.arange(len(rows)), lengths)
            terms, tf = (batch.column(i).flatten().to_numpy() for i in (3, 4))
            own = np.flatnonzero(plan.owner[terms] == stage)
            doc, terms, tf = doc[own], terms[own], tf[own]
            m = 10 + 90 * n[doc] * plan.total // plan.length
            gain = (1_000_000_000 * tf // (1000 * tf + 8 * m)).astype(np.int32)
            at, bundle = plan.bundles.expand(terms)
            doc = doc[at]
            part = _mixed(rows, plan.slices)[doc]
            order = np.lexsort((doc, part, bundle))
            if not len(order):
                continue
            at, bundle, doc, part = at[order], bundle[order], doc[order], part[order]
            block = np.diff(bundle, prepend=-1).astype(bool) | np.diff(part, prepend=-1).astype(bool)
            new = block | np.diff(doc, prepend=-1).astype(bool)
            first = np.flatnonzero(block)
            docs = np.add.reduceat(new.astype(np.int64), first)
            sizes = np.diff(np.append(first, len(order)))
            place = np.cumsum(new) - 1 - np.repeat(np.cumsum(docs) - docs, sizes)
            kept = doc[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bundle[first].astype(np.int32)), pa.array(part[first]),
                 _lists(pa.array(rows[kept]), docs), _lists(ids.take(pa.array(kept)), docs),
                 _lists(pa.array(place.astype(np.int32)), sizes),
                 _lists(pa.array(terms[at].astype(np.int32)), sizes),
                 _lists(pa.array(gain[at]), sizes)],
                names=["bundle", "slice", "rows", "ids", "at", "term", "gain"])

    return run


def _flat(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return (pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray)
            else column).flatten()


def _documents(tables: list[pa.Table]) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """Distinct rows of some tables, their ids, and for each table the place of its entries."""
    rows = [_flat(t, "rows").to_numpy() for t in tables]
    distinct, first, where = np.unique(np.concatenate(rows), return_index=True,
                                       return_inverse=True)
    ids = pa.concat_arrays([_flat(t, "ids") for t in tables]).take(pa.array(first))
    out, done = [], 0
    for table, own in zip(tables, rows):
        counts = pc.list_value_length(table["rows"]).to_numpy()
        entries = pc.list_value_length(table["at"]).to_numpy()
        base = np.repeat(np.cumsum(counts) - counts, entries)
        out.append(where[done:done + len(own)][base + _flat(table, "at").to_numpy()])
        done += len(own)
    return distinct, ids, out


def _tenth(scores: np.ndarray, top: int) -> np.ndarray:
    """The ``top``-th greatest number of each row, 0 if there are fewer."""
    if scores.shape[1] < top:
        return np.zeros(len(scores), np.int64)
    return np.partition(scores, scores.shape[1] - top, axis=1)[:, -top]


def _step(shared, stage: int, least: list[np.ndarray], top: int, last: bool):
    """Add a stage's contributions to the accumulators of a bundle and a slice."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        plan, bundle = shared.value, key[0].as_py()
        names, floor = plan.names[bundle], least[bundle]
        tables = [t for t in (left, right) if t.num_rows]
        rows, ids, places = _documents(tables)
        scores = np.zeros((len(names), len(rows)), np.int64)
        alive = np.zeros(scores.shape, bool)
        open_ = (plan.rest[bundle][stage - 1] >= floor) if stage else np.ones(len(names), bool)
        if left.num_rows:
            item = _flat(left, "item").to_numpy()
            scores[item, places[0]] = _flat(left, "score").to_numpy()
            alive[item, places[0]] = True
        if right.num_rows:
            term, gain = _flat(right, "term").to_numpy(), _flat(right, "gain").to_numpy()
            worth = plan.weights[term] * gain
            used = open_ | alive.any(axis=1)
            flat, size = scores.reshape(-1), len(rows)
            for start in range(0, len(term), step := max(1, _AT_ONCE // max(1, len(names)))):
                some = slice(start, start + step)
                at, item = plan.items[bundle].expand(term[some])
                chosen = used[item]
                at, item = at[chosen], item[chosen]
                np.add.at(flat, item * size + places[-1][some][at], worth[some][at])
        alive |= open_[:, None] & (scores > 0)
        scores[~alive] = 0
        bar = np.maximum(floor, _tenth(scores, top))
        alive &= scores + plan.rest[bundle][stage][:, None] >= bar[:, None]
        item, at = np.nonzero(alive)
        found = scores[item, at]
        if not last:
            used, at = np.unique(at, return_inverse=True)
            return pa.table({
                "bundle": pa.array([bundle], pa.int32()), "slice": pa.array([key[1].as_py()]),
                "rows": _lists(pa.array(rows[used]), np.array([len(used)])),
                "ids": _lists(ids.take(pa.array(used)), np.array([len(used)])),
                "at": _lists(pa.array(at.astype(np.int32)), np.array([len(at)])),
                "item": _lists(pa.array(item.astype(np.int32)), np.array([len(at)])),
                "score": _lists(pa.array(found), np.array([len(at)]))}).slice(
                    0, int(len(at) > 0))
        table = pa.table({"item": pa.array(names[item]), "row": pa.array(rows[at]),
                          "id": ids.take(pa.array(at)), "score": pa.array(found)})
        return table.filter(pc.greater(table["score"], 0))

    return run


def _leaders(top: int):
    """The best partial scores of each item in a task's slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for bundle, items, scores in zip(batch.column(0).to_pylist(), batch.column(1),
                                             batch.column(2)):
                items, scores = (x.values.to_numpy() for x in (items, scores))
                order = np.lexsort((-scores, items))
                items, scores = items[order], scores[order]
                first = np.flatnonzero(np.diff(items, prepend=-1))
                for a, b in zip(first, np.append(first[1:], len(items))):
                    key = (bundle, int(items[a]))
                    some = scores[a:min(b, a + top)]
                    if key in best:
                        some = np.sort(np.concatenate((best[key], some)))[::-1][:top]
                    best[key] = some
        rows = [(b, i, int(s)) for (b, i), found in best.items() for s in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in
             enumerate((pa.int32(), pa.int32(), pa.int64()))], names=["bundle", "item", "score"])

    return run


def _terms_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(words(t.as_py()))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["no", "terms"])


def _search(docs: DataFrame, wanted: list, top: int, stages: int, slice_rows: int,
            bundle_items: int) -> DataFrame | None:
    """``item, row, id, score``: for each item number the candidates that hold its ``top`` best."""
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    vocabulary = {w: i for i, w in enumerate(sorted({w for r in wanted for w in r["terms"]}))}
    postings = materialize(docs.mapInArrow(
        _tokenise(spark.sparkContext.broadcast(vocabulary)),
        f"id {kind}, n bigint, terms array<int>, tf array<bigint>").withColumn(
        "row", F.monotonically_increasing_id()), "postings")
    total, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total:
        return None
    size = len(vocabulary)
    held = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(_held(size), "term int, df bigint").groupBy(
            "term").agg(F.sum("df").alias("df")).collect():  # at most the pass's vocabulary
        held[r["term"]] = r["df"]
    weights = np.array([weight(total, int(n)) for n in held], np.int64)
    # Rare terms first; the stages own near equal numbers of postings.
    order = np.argsort(held, kind="stable")
    owner = np.zeros(size, np.int64)
    owner[order] = np.minimum(stages - 1, stages * (np.cumsum(held[order]) - held[order])
                              // max(1, int(held.sum())))
    pairs = [(i // bundle_items, i % bundle_items, vocabulary[w])
             for i, r in enumerate(wanted) for w in r["terms"]]
    bundle, item, term = (np.array(c, np.int64) for c in zip(*pairs))
    count = int(bundle[-1]) + 1
    names = [np.array([r["no"] for r in wanted[b * bundle_items:(b + 1) * bundle_items]], np.int64)
             for b in range(count)]
    rest = [np.zeros((stages, len(n)), np.int64) for n in names]
    for b, i, t in zip(bundle, item, term):
        rest[b][:owner[t], i] += weights[t] * MOST
    both = np.unique(np.stack((term, bundle)), axis=1)
    edges = np.searchsorted(bundle, np.arange(count + 1))
    plan = Plan(weights, owner, Lists.of(size, *both),
                [Lists.of(size, term[a:b], item[a:b]) for a, b in zip(edges, edges[1:])],
                names, rest, total, length, -(-total // slice_rows))
    shared = spark.sparkContext.broadcast(plan)
    source = postings.select("row", "id", "n", "terms", "tf")
    block = (f"bundle int, slice bigint, rows array<bigint>, ids array<{kind}>, at array<int>, "
             "term array<int>, gain array<int>")
    carried = (f"bundle int, slice bigint, rows array<bigint>, ids array<{kind}>, at array<int>, "
               "item array<int>, score array<bigint>")
    key = ("bundle", "slice")
    state = spark.createDataFrame([], carried)
    least = [np.zeros(len(n), np.int64) for n in names]
    for stage in range(stages):
        last = stage == stages - 1
        blocks = source.mapInArrow(_blocks(shared, stage), block)
        grown = state.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(
            _step(shared, stage, least, top, last),
            f"item bigint, row bigint, id {kind}, score bigint" if last else carried)
        if last:
            return grown
        state = materialize(grown, "accumulators")
        place = Window.partitionBy("bundle", "item").orderBy(F.desc("score"))
        for r in state.select("bundle", "item", "score").mapInArrow(
                _leaders(top), "bundle int, item int, score bigint").withColumn(
                "nth", F.row_number().over(place)).where(F.col("nth") == top).collect():
            least[r["bundle"]][r["item"]] = r["score"]  # one row per item of the pass


def search(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id", top: int = TOP, stages: int = STAGES,
           slice_rows: int = SLICE_ROWS, bundle_items: int = BUNDLE_ITEMS,
           pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item_id, rank, id, score``: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    named = materialize(items.select(
        F.col(item_id).alias("item"), F.col(item_text).cast("binary").alias("text")).withColumn(
        "no", F.monotonically_increasing_id()), "items")
    terms = materialize(named.select("no", "text").mapInArrow(
        _terms_of_items, "no bigint, terms array<binary>").where("size(terms) > 0"), "terms")
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    pairs = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-pairs // pass_terms)
    found = spark.createDataFrame(
        [], f"item bigint, row bigint, id {docs.schema[id_col].dataType.simpleString()}, score bigint")
    for nth in range(passes):
        wanted = terms.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == nth).orderBy("no").collect()
        some = _search(source, wanted, top, stages, slice_rows, bundle_items) if wanted else None
        found = found if some is None else found.unionByName(some)
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumnRenamed("item", "no").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top).join(
        named.select("no", "item"), "no").select(
        F.col("item").alias(item_id), "rank", F.col("id").alias(id_col), "score")
