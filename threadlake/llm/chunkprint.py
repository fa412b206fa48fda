"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where its top bits are zero. Cutting is
normalised: up to the normal size more bits must be zero than after it, so sizes gather round the
normal one, between a least and a greatest size. As the hash sees the last 32 bytes only, boundaries
move with the content: an insertion changes the chunks it touches and no others. The fingerprint is
the set of chunk digests with the chunk lengths; the likeness of one fingerprint to another is the
share of its length that lies in chunks of the other (containment).

``edited_neighbours`` builds for each document a text that is half its own and half the next
document's. Documents are range-sorted by id once; a task walks its range holding two documents, and
the last document of each range meets the first of the next one in a second, small job.

Cases. Null text: as empty. Two empty fingerprints are alike by 1, an empty and another by 0. A
single document is its own neighbour. Repeated ids: ordered by a hash of the text. Null ids: last.
Very long texts: a few arrays of the text's size. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadlake.session import materialize

LEAST, NORMAL, GREATEST = 16, 48, 255
HARD_BITS, EASY_BITS = 7, 4
# One pseudo-random word per byte value; the rule is the seeded generator.
GEAR = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """End of every chunk, in order; the last one is the length of ``data``."""
    size = len(data)
    if size <= LEAST:
        return [size] if size else []
    rolled = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sum of gear[byte] << age over the last 32 bytes
        rolled[step:] += rolled[:-step] << np.uint32(step)
    easy = np.flatnonzero(rolled >> np.uint32(32 - EASY_BITS) == 0)
    hard = easy[rolled[easy] >> np.uint32(32 - HARD_BITS) == 0].tolist()
    easy, out, at = easy.tolist(), [], 0
    while size - at > LEAST:
        middle, far = min(at + NORMAL, size), min(at + GREATEST, size)
        i = bisect_left(hard, at + LEAST)
        if i < len(hard) and hard[i] < middle:
            end = hard[i] + 1
        else:
            i = bisect_left(easy, middle)
            end = easy[i] + 1 if i < len(easy) and easy[i] < far else far
        out.append(end)
        at = end
    if at < size:
        out.append(size)
    return out


def chunks(text: str) -> set[int]:
    """32 bits of digest and 8 bits of length of every chunk."""
    data, out, at = text.encode(), set(), 0
    for end in boundaries(data):
        part = data[at:end]
        out.add(xxhash.xxh32_intdigest(part) << 8 | len(part))
        at = end
    return out


def pack(parts: set[int]) -> bytes:
    """The set in order, five bytes a chunk."""
    return np.array(sorted(parts), ">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def containment(a: set[int], b: set[int]) -> float:
    """Share of the length of ``a`` in chunks that ``b`` has."""
    if not a:
        return float(not b)
    return sum(x & 0xFF for x in a & b) / sum(x & 0xFF for x in a)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _row(id_, text: str, own: set[int], following: str, theirs: set[int]) -> tuple:
    changed = edited(text, following)
    after = chunks(changed)
    return (id_, len(text), hashlib.sha256(changed.encode()).hexdigest(), pack(own), pack(after),
            containment(own, after), containment(own, theirs))


RESULT = T.StructType([
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fp", T.BinaryType()), T.StructField("edited_fp", T.BinaryType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
_ARROW = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_EDGE = [pa.int32(), pa.int32(), pa.string()]
NAMES = [f.name for f in RESULT.fields]


def _batch(ids: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [ids, *_ARROW, *_EDGE]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        names=["id", *NAMES, "edge", "part", "text"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all documents of a sorted range but its last; its first and last as edges."""
    part, held, ids = TaskContext.get().partitionId(), None, None
    for batch in batches:
        ids, rows = batch.schema.field(0).type, []
        for id_, text in zip(batch.column(0), batch.column(1)):
            id_, text = id_.as_py(), text.as_py()
            own = chunks(text)
            if held is None:
                rows.append((id_, *[None] * len(NAMES), 0, part, text))
            else:
                rows.append((*_row(*held, text, own), None, None, None))
            held = id_, text, own
        if rows:
            yield _batch(ids, rows)
    if held is not None:
        yield _batch(ids, [(held[0], *[None] * len(NAMES), 1, part, held[1])])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.schema.field(0).type, []
        for id_, text, following in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append((*_row(id_, text, chunks(text), following, chunks(following)),
                         None, None, None))
        if rows:
            yield _batch(ids, rows)


def _line(packed: str) -> F.Column:
    """Base 64 in one line."""
    return F.translate(F.base64(packed), "\r\n", "")


def edited_neighbours(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                      ranges: int | None = None) -> DataFrame:
    """Per row: fingerprint, that of its edited text, and likeness to it and to the next document.

    The next document is the one that follows in falling id; the first follows the last.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", kind), *RESULT.fields, T.StructField("edge", T.IntegerType()),
        T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])
    walked = materialize(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .mapInArrow(_walk, schema), "walked")
    # Two rows per range: the number of ranges bounds what is windowed and joined here.
    firsts = walked.where("edge = 0").select("part", F.col("text").alias("following"))
    order = firsts.select("part").withColumn("after", F.coalesce(
        F.lead("part").over(Window.orderBy("part")),
        F.min("part").over(Window.orderBy("part"))))
    pairs = walked.where("edge = 1").select("id", "text", "part").join(order, "part").join(
        firsts.withColumnRenamed("part", "after"), "after").select("id", "text", "following")
    met = pairs.mapInArrow(_meet, schema)
    return walked.where("edge is null").unionByName(met).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        _line("fp").alias("fingerprint"), _line("edited_fp").alias("edited_fingerprint"),
        "near_edited", "near_next")
