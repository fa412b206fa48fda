"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group, and a group goes to one shard whole. Groups are packed in two steps, so
that the packing itself stays bounded however many groups there are: groups far smaller than a shard
are first bundled (by size class, then by hash inside the class) into bundles of at most about
``1 / resolution`` of a shard's share; large groups are their own bundle. The bundles, at most a few
times ``shards * resolution``, then enter the bins in order of falling size, each into the bin with
the tightest remaining room that still holds it, found in a balanced search tree.

``assign`` packs into a fixed number of shards: a group larger than its fair share gets a shard for
itself and the others share the rest evenly. ``pack`` minimises the number of shards of a fixed
capacity: bundles are dealt to zones of a bounded number of shards, and each zone is packed in its
own task; at most one shard per zone stays part empty, and a group above the capacity is alone.

Cases. Null text: size 1, one group of all null texts, distinct from the empty text. Repeated rows:
the same group, a slot each. Null ids: allowed. Empty table: no rows. Extra columns are carried by
``shard_rows``; they cannot clash, because every working column is renamed until it is new.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm.common import fresh, materialize, running_before

SHARDS = 16
RESOLUTION = 512
ZONE_SHARDS = 64


class RoomTree:
    """A treap of (room, bin) pairs: insert, and take the least pair with room for a size."""

    def __init__(self) -> None:
        self.root = None  # a node is [key, priority, left, right]

    def insert(self, room: int, bin_: int) -> None:
        key = (room, bin_)
        # a fixed mix of the key serves as the random priority, so that reruns agree
        node = [key, hash((room * 2654435761 + bin_ * 40503) & 0xFFFFFFFF ^ 0x5BD1E995) *
                2246822519 & 0xFFFFFFFF, None, None]
        less, more = self._cut(self.root, key)
        self.root = self._join(self._join(less, node), more)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the pair with the least room that is at least ``size``."""
        found, at = None, self.root
        while at is not None:
            if at[0][0] >= size:
                found, at = at[0], at[2]
            else:
                at = at[3]
        if found is not None:
            self._drop(found)
        return found

    def take_largest(self) -> tuple[int, int]:
        at = self.root
        while at[3] is not None:
            at = at[3]
        self._drop(at[0])
        return at[0]

    def _drop(self, key) -> None:
        less, rest = self._cut(self.root, key)
        _, more = self._cut(rest, (key[0], key[1] + 1))
        self.root = self._join(less, more)

    def _cut(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], more = self._cut(node[3], key)
            return node, more
        less, node[2] = self._cut(node[2], key)
        return less, node

    def _join(self, less, more):
        if less is None or more is None:
            return more if less is None else less
        if less[1] > more[1]:
            less[3] = self._join(less[3], more)
            return less
        more[2] = self._join(less, more[2])
        return more


def even_rooms(sizes: list[int], shards: int) -> list[int]:
    """Room of each shard: items above an even share stand alone, the others share the rest."""
    rooms, rest, left = [], sum(sizes), shards
    for size in sizes:  # falling
        if left <= 1 or size * left <= rest:
            break
        rooms.append(size)
        rest, left = rest - size, left - 1
    return rooms + [-(-rest // left)] * left


def best_fit(sizes: list[int], rooms: list[int] | None, capacity: int = 0) -> list[int]:
    """Bin of each item, items given in falling size.

    With ``rooms`` the bins are fixed, and an item that fits nowhere goes where most room is left
    (that may be below zero). Without, bins of ``capacity`` are opened as they are needed.
    """
    tree, out, opened = RoomTree(), [], 0
    for bin_, room in enumerate(rooms or []):
        tree.insert(room, bin_)
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if rooms is not None:
                found = tree.take_largest()
            else:
                found = (max(capacity, size), opened)
                opened += 1
        tree.insert(found[0] - size, found[1])
        out.append(found[1])
    return out


def group_key(text: Column) -> Column:
    """Digest of a text; null has one of its own that no text can give."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def size_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _bundles(groups: DataFrame, share: Column) -> DataFrame:
    """Adds ``_class`` and ``_bundle`` to groups; ``share`` is the wanted size of a bundle.

    The class is the power of two below the size. A class whose sizes sum up to t is dealt by hash
    to ceil(t / share) bundles; a group of at least the share is a bundle by itself.
    """
    classed = groups.withColumn("_class", F.floor(F.log2("_size")).cast("int"))
    sums = classed.groupBy("_class").agg(F.sum("_size").alias("_total"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_total") / share)).cast("bigint")
    own = F.col("_size") >= share
    return classed.join(F.broadcast(sums), "_class").withColumn(  # at most 64 classes
        "_bundle", F.when(own, F.col("_group")).otherwise(F.concat_ws(
            "/", F.col("_class"), F.pmod(F.xxhash64("_group"), parts)))).drop("_total")


def _fixed(shards: int):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_size", "_bundle"], ascending=[False, True])
        sizes = [int(s) for s in batch["_size"]]
        bins = best_fit(sizes, even_rooms(sizes, shards))
        return pd.DataFrame({"_bundle": batch["_bundle"], "_shard": bins})

    return run


def _open(capacity: int):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["_size", "_bundle"], ascending=[False, True])
        bins = best_fit([int(s) for s in batch["_size"]], None, capacity)
        return pd.DataFrame({"_bundle": batch["_bundle"], "_zone": batch["_zone"],
                             "_bin": bins})

    return run


def assign(groups: DataFrame, shards: int = SHARDS, resolution: int = RESOLUTION) -> DataFrame:
    """``_group, _size`` (one row per group, stored) to ``_group, _shard`` in 0..shards-1.

    The one packing task gets at most 2 * shards * resolution + 64 bundles.
    """
    total = groups.agg(F.sum("_size")).first()[0] or 0
    placed = _bundles(groups, F.lit(max(1, total // (shards * resolution))))
    sums = placed.groupBy("_bundle").agg(F.sum("_size").alias("_size"))
    packed = sums.groupBy(F.lit(0).alias("_all")).applyInPandas(
        _fixed(shards), "_bundle string, _shard int")
    return placed.join(materialize(packed, "bins"), "_bundle").select("_group", "_shard")


def pack(groups: DataFrame, capacity: int, resolution: int = 64,
         zone_shards: int = ZONE_SHARDS) -> DataFrame:
    """``_group, _size`` to ``_group, _shard`` (bigint from 0) with as few shards as packing finds.

    A zone gets about ``zone_shards`` capacities, so at most some 2 * zone_shards * resolution
    bundles; zones are packed by different tasks.
    """
    total = groups.agg(F.sum("_size")).first()[0] or 0
    zones = max(1, -(-total // (capacity * zone_shards)))
    placed = _bundles(groups, F.lit(max(1, capacity // resolution)))
    sums = placed.groupBy("_bundle").agg(F.sum("_size").alias("_size")).withColumn(
        "_zone", F.pmod(F.xxhash64("_bundle"), F.lit(zones)))
    packed = materialize(sums.groupBy("_zone").applyInPandas(
        _open(capacity), "_bundle string, _zone bigint, _bin int"), "bins")
    used = packed.groupBy("_zone").agg((F.max("_bin") + 1).alias("_used"))
    # one row per zone, so a zone count is what this window sees, not the data
    first = used.select("_zone", F.coalesce(F.sum("_used").over(
        Window.orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ).alias("_first"))
    numbered = packed.join(first, "_zone").select(
        "_bundle", (F.col("_first") + F.col("_bin")).cast("bigint").alias("_shard"))
    return placed.join(numbered, "_bundle").select("_group", "_shard")


def plan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = SHARDS,
         resolution: int = RESOLUTION, slices: int = 1024) -> DataFrame:
    """One row per document: ``id, size, text_crc32, shard, slot``.

    Slots count the rows of a shard from 0 in a hash-random order; they are built from sums per
    (shard, slice), so no task sees a whole shard.
    """
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), size_bytes(F.col(text)).alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("bigint").alias("_crc"),
        group_key(F.col(text)).alias("_group")), "sizes")
    groups = materialize(rows.groupBy("_group").agg(F.sum("_size").alias("_size")), "groups")
    placed = materialize(
        rows.join(assign(groups, shards, resolution), "_group").select(
            "_id", "_size", "_crc", "_shard", "_group",
            F.md5(F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")),
                              "_group")).alias("_key"), F.lit(1).alias("_one")), "placed")
    slots = running_before(placed, ["_shard"], "_key", ["_id", "_group"], {"_slot": "_one"},
                           slices)
    return slots.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"), F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").cast("bigint").alias("slot"))


def shard_rows(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
               shards: int = SHARDS, resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` with a column ``shard`` (renamed if the name is taken)."""
    group, name = fresh(docs, "_text_group"), fresh(docs, "shard")
    rows = docs.withColumn(group, group_key(F.col(text)))
    sums = materialize(docs.select(group_key(F.col(text)).alias("_group"),
                                   size_bytes(F.col(text)).alias("_size"))
                       .groupBy("_group").agg(F.sum("_size").alias("_size")), "groups")
    chosen = assign(sums, shards, resolution).select(
        F.col("_group").alias(group), F.col("_shard").cast("int").alias(name))
    return rows.join(chosen, group).select(*docs.columns, name)
