"""Row validation, validity of invites and tokens, substring search."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from threadlake.functions.scalar import wide_trim
from threadlake.session import spread

# Fixed formats.
OBJECT_ID = "^[a-f0-9]{24}$"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
USERNAME = "(?i)^[a-z0-9_]+$"


def _size(text: Column, low: int, high: int) -> Column:
    return F.length(wide_trim(text)).between(low, high)


def message_rules() -> list[tuple[str, Column]]:
    return [("roomId", F.col("room_id").rlike(OBJECT_ID)),
            ("clientMsgId", F.col("client_msg_id").rlike(UUID)),
            ("body", _size(F.col("body"), 1, 2000))]


def question_rules() -> list[tuple[str, Column]]:
    return [("question", _size(F.col("question"), 3, 600))]


def user_rules() -> list[tuple[str, Column]]:
    return [("username", _size(F.col("username"), 3, 24)
             & wide_trim(F.col("username")).rlike(USERNAME)),
            ("displayName", _size(F.col("display_name"), 1, 48))]


def room_rules() -> list[tuple[str, Column]]:
    return [("name", _size(F.col("name"), 1, 48))]


def row_validation(df: DataFrame, rules: list[tuple[str, Column]],
                   name: str = "error_path") -> DataFrame:
    """Path of the first rule a row fails, null for a valid row; a missing value fails."""
    verdict = F.lit(None).cast("string")
    for path, ok in reversed(rules):
        verdict = F.when(F.coalesce(ok, F.lit(False)), verdict).otherwise(F.lit(path))
    return df.withColumn(name, verdict)


def split_valid(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    checked = row_validation(df, rules)
    return (checked.where(F.col("error_path").isNull()).drop("error_path"),
            checked.where(F.col("error_path").isNotNull()))


def valid_invites(invites: DataFrame, as_of) -> DataFrame:
    return invites.where(F.col("revoked_at").isNull()
                         & (F.col("expires_at") > F.lit(as_of))
                         & (F.col("redemption_count") < F.col("max_redemptions")))


def valid_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("revoked_at").isNull())


def name_contains(df: DataFrame, column: str, needle: str) -> DataFrame:
    return df.where(F.lower(column).contains(needle.lower()))


# Bytes of the needles that one automaton, and so one reading of the texts, looks for.
NEEDLE_BYTES = 8 << 20


class _Needles:
    """Aho-Corasick automaton of distinct needles, built once in each worker.

    ``rows[i]`` lists the places (and groups) of the needle rows with the text ``needles[i]``.
    """

    def __init__(self, found: list[tuple[str, int, object]]):
        places: dict[str, list[tuple[int, object]]] = {}
        for text, place, group in found:
            places.setdefault(text, []).append((place, group))
        self.empty = places.pop("", [])
        self.needles, self.rows = list(places), list(places.values())
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def within(self, text: str) -> Iterator[tuple[int, object]]:
        """Needle rows whose text occurs in ``text``."""
        if self._automaton is None and self.needles:
            self._automaton = ahocorasick.Automaton()
            for i, needle in enumerate(self.needles):
                self._automaton.add_word(needle, i)
            self._automaton.make_automaton()
        yield from self.empty
        if self.needles:
            for i in {i for _, i in self._automaton.iter(text)}:
                yield from self.rows[i]


# Hits that a task holds before it hands them on.
HELD_HITS = 1 << 16


def _occurrences(shared, needle_type: pa.DataType, grouped: bool, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, ids = shared.value
        ids = pa.array(ids, needle_type)
        for batch in batches:
            rows, places = [], []

            def hits() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())),
                     ids.take(pa.array(places, pa.int64()))], names=["text_id", "needle_id"])
                rows.clear()
                places.clear()
                return out

            for row, text in enumerate(batch.column(1)):  # one text at a time becomes a Python string
                if not text.is_valid:
                    continue
                group = batch.column(2)[row].as_py() if grouped else None
                for place, own in automaton.within(text.as_py()):
                    if not grouped or own == group:
                        rows.append(row)
                        places.append(place)
                        if len(rows) == held:
                            yield hits()
            yield hits()

    return run


# Characters fingerprinted at once, and needles whose marks one reading of the texts looks for.
BLOCK, MARKED = 1 << 16, 1 << 24
_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = (np.cumprod(np.append(np.uint64(1), np.full(BLOCK, b, np.uint64))) for b in (
    np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))


def _fingerprints(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the fingerprints of all stretches of so many characters; at most ``BLOCK`` characters."""
    sums = np.append(np.uint64(0), np.cumsum(codes * _POWERS[:len(codes)], dtype=np.uint64))
    for size in sizes:
        count = len(codes) - size + 1
        if count > 0:
            yield size, (sums[size:] - sums[:count]) * _INVERSE[:count]


def _spots(prints: np.ndarray, salts: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a field of 2 to the ``width`` bits for each fingerprint of ``size`` characters."""
    x = prints + salts + np.uint64(size)
    for shift, by in ((32, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(32)
    return x >> np.uint64(64 - width), x & np.uint64((1 << width) - 1)


def _is_set(field: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (field[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)


def _marks(width: int):
    """The spots of needles: of the text of the first column, salted by the second."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = batch.column(1).to_numpy().view(np.uint64)
            codes = [_codes(needle.as_py()) for needle in batch.column(0)]
            sizes, out = np.array([len(c) for c in codes]), []
            for size in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == size)
                prints = np.zeros(len(which), np.uint64)
                for column, power in zip(np.stack([codes[i] for i in which]).T, _POWERS):
                    prints += column * power
                out += [s.astype(np.uint32) for s in _spots(prints, salts[which], size, width)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).tobytes()])], names=["spots"])

    return run


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(batch: pa.RecordBatch, overlap: int, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, salt, characters) of every text; a long one in parts that overlap."""
    for row, (text, salt) in enumerate(zip(batch.column(1), batch.column(2))):
        if text.is_valid and salt.is_valid:
            codes = _codes(text.as_py())
            for low in range(0, max(len(codes) - overlap, 1), most - overlap):
                yield row, salt.as_py(), codes[low:low + most]


def _blocks(batch: pa.RecordBatch, overlap: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces of texts by blocks of ``most`` characters: (rows, salts, sizes, characters)."""
    held, count = [], 0
    for piece in _pieces(batch, overlap, most):
        if held and count + len(piece[2]) > most:
            yield _block(held)
            held, count = [], 0
        held.append(piece)
        count += len(piece[2])
    if held:
        yield _block(held)


def _block(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    rows, salts, codes = zip(*held)
    return (np.array(rows), np.array(salts, np.int64).view(np.uint64),
            np.array([len(c) for c in codes]), np.concatenate(codes))


def _stretches(shared, sizes: list[int], held: int, block: int):
    """The different stretches of each text that may be needles, with the row's other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, field = shared.value
        for batch in batches:
            met, rows, found = set(), [], []

            def hits() -> pa.RecordBatch:
                which = pa.array(rows, pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), pa.array(found, pa.string()),
                     *[batch.column(c).take(which) for c in range(3, batch.num_columns)]],
                    names=["text_id", "stretch", "group"][:batch.num_columns - 1])
                rows.clear()
                found.clear()
                return out

            for no, salts, lengths, codes in _blocks(batch, max(sizes) - 1, block):
                ends = np.repeat(np.cumsum(lengths), lengths)
                piece = np.repeat(np.arange(len(lengths)), lengths)
                salts = salts[piece]
                for size, prints in _fingerprints(codes, sizes):
                    one, two = _spots(prints, salts[:len(prints)], size, width)
                    at = np.flatnonzero(_is_set(field, one))
                    at = at[_is_set(field, two[at]) & (at + size <= ends[at])]
                    for p, row in zip(at.tolist(), no[piece[at]].tolist()):
                        stretch = codes[p:p + size].tobytes()
                        if (row, stretch) not in met:
                            met.add((row, stretch))
                            rows.append(row)
                            found.append(stretch.decode("utf-32-le", "surrogatepass"))
                            if len(rows) == held:
                                yield hits()
            yield hits()

    return run


def _sizes_of_many(rows: DataFrame, needle: str, needle_bytes: int) -> tuple[list[int], int | None]:
    """Lengths whose needles are looked for by fingerprints, if that is less work; bytes of any others.

    Fingerprints of one length take some 25 ns a character, a reading with an automaton 50 to 200, by its
    size. Up to an eighth of ``needle_bytes`` an automaton does.
    """
    weights = {r["size"]: r["bytes"] for r in rows.groupBy(F.length(needle).alias("size")).agg(
        F.sum("_bytes").alias("bytes")).collect()}
    left = total = sum(weights.values())
    if 8 * total <= needle_bytes:
        return [], total
    heaviest = sorted((size for size in weights if 0 < size <= BLOCK // 2), key=lambda size: -weights[size])
    least, many = 2 * -(-total // needle_bytes) + 6 * total / needle_bytes, 0
    for k, size in enumerate(heaviest, 1):
        left -= weights[size]
        cost = 1 + k + (2 * (-(-left // needle_bytes) or 1) + 6 * left / needle_bytes if k < len(weights) else 0)
        if cost < least:
            least, many = cost, k
    others = weights.keys() - set(heaviest[:many])
    return sorted(heaviest[:many]), sum(weights[size] for size in others) if others else None


def _by_fingerprints(read: DataFrame, rows: DataFrame, names: tuple[str, ...], schema: T.StructType,
                     sizes: list[int]) -> DataFrame:
    """``text_contains`` of needles of a few lengths: texts are read once for some ``MARKED`` of them.

    Stretches whose two spots are set in a field of bits that the needles mark are joined with them.
    """
    text_id, text, needle_id, needle, *also = names
    spark = read.sparkSession
    alike = bool(also) and read.schema[also[0]].dataType == rows.schema[also[0]].dataType and isinstance(
        read.schema[also[0]].dataType, (T.IntegralType, T.StringType))
    if also:
        read = read.where(F.col(also[0]).isNotNull())
    salt = F.xxhash64(also[0]) if alike else F.lit(0).cast("bigint")
    texts = read.select(text_id, text, salt.alias("_salt"), *also)
    stretch = T.StructType([T.StructField("text_id", schema["text_id"].dataType), T.StructField(
        "stretch", T.StringType()), *[T.StructField("group", read.schema[c].dataType) for c in also]])
    found, count = None, rows.count()
    readings = -(-count // MARKED) or 1
    width = min(max(16, (64 * -(-count // readings)).bit_length()), 29)
    for nth in range(readings):
        part = rows.where(F.pmod(F.xxhash64(needle), F.lit(readings)) == nth)
        field = np.zeros(1 << width >> 3, np.uint8)
        for r in part.select(needle, salt.alias("_salt")).mapInArrow(_marks(width), "spots binary").collect():
            spots = np.frombuffer(r["spots"], np.uint32)
            np.bitwise_or.at(field, spots >> np.uint32(3), np.uint8(1) << (spots & np.uint32(7)).astype(np.uint8))
        shared = spark.sparkContext.broadcast((width, field))  # at most 64 MB
        some = texts.mapInArrow(_stretches(shared, sizes, HELD_HITS, BLOCK), stretch).alias("t").join(
            part.alias("n"), [F.col("t.stretch") == F.col(f"n.`{needle}`"),
                              *[F.col("t.group") == F.col(f"n.`{c}`") for c in also]]).select(
            F.col("t.text_id"), F.col(f"n.`{needle_id}`").alias("needle_id"))
        found = some if found is None else found.unionByName(some)
    return found


def text_contains(texts: DataFrame, needles: DataFrame, text_id: str, text: str,
                  needle_id: str, needle: str, group: str | None = None,
                  needle_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """(text_id, needle_id) wherever the needle occurs literally in the text.

    Every text is read once against an automaton of all needles. An automaton holds needles of
    ``needle_bytes`` at most (or a single longer one). Of many needles, those of lengths that many have are
    looked for by fingerprints of all stretches of that length, in one reading for some ``MARKED`` of them;
    the others take as many readings as automata. The empty needle occurs in every text, a null one in none. With ``group``, a
    column of both tables, a needle is only looked for in the texts of its own group.
    """
    spark = texts.sparkSession
    also = [group] if group else []
    rows = needles.where(F.col(needle).isNotNull()).select(
        needle_id, needle, *also, F.octet_length(needle).alias("_bytes"))
    if group:
        rows = rows.where(F.col(group).isNotNull())
    many, others = _sizes_of_many(rows, needle, needle_bytes)
    kinds = {name: df.schema[c].dataType for name, df, c in (
        ("text_id", texts, text_id), ("needle_id", needles, needle_id))}
    schema = T.StructType([T.StructField(n, kind) for n, kind in kinds.items()])
    read = spread(texts).select(text_id, text, *also)
    found = None
    if many:
        found = _by_fingerprints(read, rows.where(F.length(needle).isin(many)), (
            text_id, text, needle_id, needle, *also), schema, many)
        rows = rows.where(~F.length(needle).isin(many))
        if others is None:
            return found.select(F.col("text_id").alias(text_id), F.col("needle_id").alias(needle_id))
    readings = -(-others // needle_bytes) or 1
    for nth in range(readings):
        part = rows.where(F.pmod(F.xxhash64(needle), F.lit(readings)) == nth).collect()
        shared = spark.sparkContext.broadcast((  # bounded by needle_bytes
            _Needles([(r[needle], i, r[group] if group else None) for i, r in enumerate(part)]),
            [r[needle_id] for r in part]))
        some = read.mapInArrow(_occurrences(
            shared, to_arrow_type(kinds["needle_id"]), bool(group), HELD_HITS), schema)
        found = some if found is None else found.unionByName(some)
    return found.select(F.col("text_id").alias(text_id), F.col("needle_id").alias(needle_id))
