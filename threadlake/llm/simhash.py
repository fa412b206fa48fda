"""SimHash near-duplicates by multi-index hashing.

A text becomes a 64-bit fingerprint: the bitwise majority of the hashes of its word shingles. Two
fingerprints link if they differ in at most three bits. Then one of their 32-bit halves differs in
at most one bit, so each half is a table key, and a fingerprint probes the table of each half with
its own half and with every half one bit away. Of two halves that differ in one bit, only the one
that has the bit set probes (with the bit cleared), which halves the probes. Matches are verified
by the complete distance.

Equal texts and equal fingerprints are folded before, so copies cost nothing. A key under which
very many different fingerprints lie (a large cloud of near copies) is refined: under it the other
half is split in two quarters and probed in the same way, after which at most 2**16 different
fingerprints can share a key; there a task compares blocks of bits and gives back only links that
join what was apart, so neither rows nor tasks grow with the square of the cloud.

Cases. Null or empty text, text without words: fingerprint zero, linked like any other. Fewer words
than a shingle: the whole sequence is one shingle. Null ids: grouped by fingerprint like others,
null only where a whole component has no id. Repeated rows: a row each. Empty table: no rows. Extra
columns: ignored by ``fingerprints``, kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import fresh
from threadlake.llm.components import components
from threadlake.session import materialize

SHINGLE, SEED, MAX_BITS = 3, 42, 3
# Table rows under one key of a half above which the key is refined.
DENSE = 512
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over the shingles of the lower-cased words."""
    words = (text or "").encode().lower().split()  # bytes split at 32 and 9 to 13 only
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _BLOCK):
        hashes = np.array([digest(flat[i:j], seed) for i, j in
                           zip(first[at:at + _BLOCK], last[at:at + _BLOCK])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first)).view(">u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({
            "id": batch.column(0),
            "fp": _signed([fingerprint(t.as_py()) for t in batch.column(1)]),
            **{"hash": c for c in batch.columns[2:]}})


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                 hashed: bool = False) -> DataFrame:
    """``id, fp`` (signed bigint) and, if asked for, ``hash`` of the text for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = [F.xxhash64(text).alias("hash")] if hashed else []
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *more).mapInArrow(
        _fingerprints, f"id {kind}, fp bigint" + ", hash bigint" * hashed)


_HALVES = """explode(array(
    struct(0 AS seg, shiftrightunsigned(fp, 32) AS half, fp & 4294967295L AS rest),
    struct(1 AS seg, fp & 4294967295L AS half, shiftrightunsigned(fp, 32) AS rest)))"""
_BALL = """explode(concat(array(struct(half AS key, 0 AS used)), transform(
    filter(sequence(0, 31), i -> (shiftrightunsigned(half, i) & 1) = 1),
    i -> struct(half ^ shiftleft(1L, i) AS key, 1 AS used))))"""
_QUARTERS = """explode(array(
    struct(0 AS sub, shiftrightunsigned(rest, 16) AS quarter),
    struct(1 AS sub, rest & 65535L AS quarter)))"""
_QUARTER_BALL = """explode(concat(array(quarter), transform(
    sequence(0, 15), i -> quarter ^ shiftleft(1L, i))))"""


def _spanning(left: np.ndarray, right: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of at most ``bits`` between two sets, reduced to those that join something new."""
    values, where = np.unique(np.concatenate((left, right)), return_inverse=True)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, split = [], len(left)
    step = max(1, (1 << 22) // max(1, len(right)))
    for at in range(0, split, step):
        near = np.bitwise_count(left[at:at + step, None] ^ right[None, :]) <= bits
        for i, j in zip(*np.nonzero(near)):
            a, b = root(where[at + i]), root(where[split + j])
            if a != b:
                parent[a] = b
                out.append((int(left[at + i]), int(right[j])))
    return out


def _dense_links(bits: int):
    def run(probes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = _spanning(probes["fp"].to_numpy(np.int64).view(np.uint64),
                          rows["c_fp"].to_numpy(np.int64).view(np.uint64), bits)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def links(distinct: DataFrame, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """``a, b``: linked fingerprints of the stored table ``fp`` (distinct); connectivity is whole.

    Under keys up to ``dense`` rows every pair within ``bits`` is given; under denser keys enough
    of them that the same fingerprints are connected.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two halves cover at most three differing bits")
    table = distinct.select("fp", F.expr(_HALVES).alias("h")).select(
        "fp", "h.seg", "h.half", "h.rest")
    probes = table.select("*", F.expr(_BALL).alias("p")).select(
        "seg", F.col("p.key").alias("half"), "p.used", "fp", "rest")
    crowded = materialize(table.groupBy("seg", "half").count().where(
        F.col("count") > dense).select("seg", "half"), "crowded")
    rows = table.select("seg", "half", F.col("fp").alias("b"), F.col("rest").alias("rest_b"))
    thin = rows.join(crowded, ["seg", "half"], "left_anti")
    # With one bit used in the half, the whole distance is still what counts; of equal halves the
    # pair is met from both sides and kept once.
    pairs = probes.join(thin, ["seg", "half"]).where(
        ((F.col("used") == 1) | (F.col("fp") < F.col("b")))
        & (F.bit_count(F.col("rest").bitwiseXOR(F.col("rest_b"))) + F.col("used") <= bits)
    ).select(F.col("fp").alias("a"), "b")
    key = ["seg", "half", "sub", "quarter"]
    cloud = table.join(crowded, ["seg", "half"], "left_semi").select(
        "*", F.expr(_QUARTERS).alias("q")).select(
        "seg", "half", "q.sub", "q.quarter", "fp")
    seekers = probes.join(crowded, ["seg", "half"], "left_semi").select(
        "*", F.expr(_QUARTERS).alias("q")).select(
        "seg", "half", "fp", "q.sub", "q.quarter").select(
        "seg", "half", "sub", F.expr(_QUARTER_BALL).alias("quarter"), "fp")
    cloud = cloud.select(*[F.col(c).alias(f"c_{c}") for c in (*key, "fp")])
    near = seekers.groupBy(*key).cogroup(cloud.groupBy(*[f"c_{c}" for c in key])).applyInPandas(
        _dense_links(bits), "a bigint, b bigint")
    return pairs.unionByName(near)


def groups(prints: DataFrame, bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """``fp, component_id, root`` for every fingerprint of ``id, fp``.

    The component_id is the least id of the component, the root one fingerprint of it.
    """
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), bits, dense))
    placed = materialize(classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root").select("fp", "component_id", "root")


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """``id, fingerprint, component_id`` for every row."""
    prints = materialize(fingerprints(docs, text, id_col), "prints")
    return prints.join(groups(prints, bits, dense), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, then text hash.

    A component without any id keeps one row as well. Rows equal in id and text are one document.
    """
    prints = materialize(fingerprints(docs, text, id_col, hashed=True), "prints")
    stay = prints.join(groups(prints), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("row"))
    name = fresh(docs, "_hash")
    stay = stay.select(F.col("row.id").alias(f"{name}_id"), F.col("row.hash").alias(f"{name}_of"))
    kept = docs.withColumn(name, F.xxhash64(text)).join(
        stay, F.col(id_col).eqNullSafe(F.col(f"{name}_id"))
        & (F.col(name) == F.col(f"{name}_of")), "left_semi")
    return kept.dropDuplicates([id_col, name]).drop(name)
