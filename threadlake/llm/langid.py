"""Language ID with interpolated Kneser-Ney character models.

One model per language over the letters of a text (lower case, any run of other characters read as
one blank). Grams of each order are kept as sorted hash arrays with the finished interpolated
log-probability in every language, and the backoff weight of the gram as a context; a gram that no
language has falls back to its shorter suffix. A text goes to the language of the lowest
cross-entropy per symbol. Each language has a bound, calibrated on labelled texts that were not
counted: it lies ``REACH`` of the way from the mean of the language's own texts to the mean of texts
in the other languages, wider for short texts. A text beyond the bound of its best language, which
so looks like none of the languages known, is not accepted.

What is fitted on a bounded sample: the counts and the bounds, on the first ``SAMPLE_ROWS`` rows of
each language in hash order, whole texts, up to ``SAMPLE_CHARS`` characters per language. Every text
is scored whole.

Cases. Null text or text without a letter: ``und``, score 0, not accepted. Null label or null id:
never learned from. No labelled row at all: everything is ``und``. Equal cross-entropies: the language
whose name comes first. Repeated rows: each by itself.
Empty table: no rows. Extra columns: kept by ``identify`` and ``keep_known``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadlake.llm.common import fresh

ORDER = 4
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 3_000_000
# One sample row in so many calibrates the bounds and is not counted.
CALIBRATION = 5
# Place of the bound between own and foreign texts, and standard errors added for short texts.
REACH, ERRORS = 0.7, 3.0
# Symbols that count as evidence in the score; more would only push it to 1.
EVIDENCE = 40
UNKNOWN = "und"
EDGE, BLANK = 1, 32
_MULTIPLIER = 0x9E3779B97F4A7C15
_LETTER_BITS = np.packbits(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool,
                                       0x110000))


def symbols(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Code points of the text as the models read it, after ``ORDER - 1`` edges; None if no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = letters[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    body = np.where(letter, codes, np.uint32(BLANK))[keep]
    return np.concatenate((np.full(ORDER - 1, EDGE, np.uint32), body)).astype(np.uint64)


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """For n = 1 to ORDER the hash of the n symbols that end at each position."""
    out, factor = [codes + np.uint64(1)], 1
    for n in range(1, ORDER):
        factor = factor * _MULTIPLIER & (1 << 64) - 1
        longer = out[-1].copy()
        longer[n:] += (codes[:-n] + np.uint64(1)) * np.uint64(factor)
        out.append(longer)
    return out


@dataclass
class Model:
    langs: list[str]
    hashes: list[np.ndarray]   # per order, sorted
    logs: list[np.ndarray]     # per order: (grams, languages) log-probability
    weights: list[np.ndarray]  # per order: (grams, languages) log backoff weight as a context
    floor: np.ndarray          # log-probability of a symbol that nothing has seen
    letters: np.ndarray        # packed bits: which code points are letters
    bounds: np.ndarray | None = None  # (languages, 2): cross-entropy bound, variance of symbols

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.letters).astype(bool)

    def _find(self, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.hashes[n - 1]
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return at, own[at] == wanted

    def _log(self, n: int, hashes: list[np.ndarray], where: np.ndarray) -> np.ndarray:
        at, hit = self._find(n, hashes[n - 1][where])
        out = self.logs[n - 1][at]
        miss = ~hit
        if miss.any():
            if n == 1:
                out[miss] = self.floor
            else:
                rest = where[miss]
                context, known = self._find(n - 1, hashes[n - 2][rest - 1])
                out[miss] = (np.where(known[:, None], self.weights[n - 2][context], 0.0)
                             + self._log(n - 1, hashes, rest))
        return out

    def entropies(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cross-entropy per symbol in each language, its variance, and the number of symbols."""
        hashes = gram_hashes(codes)
        first = ORDER - 1
        _, where, counts = np.unique(hashes[-1][first:], return_index=True, return_counts=True)
        logs = self._log(ORDER, hashes, where + first)
        size = len(codes) - first
        mean = counts @ logs / size
        return -mean, counts @ (logs - mean) ** 2 / size, size

    def judge(self, text: str | None, letters: np.ndarray) -> tuple[str, float, bool]:
        codes = symbols(text, letters)
        if codes is None or not self.langs:
            return UNKNOWN, 0.0, False
        loss, _, size = self.entropies(codes)
        best = int(loss.argmin())
        score = 1.0 / np.exp((loss[best] - loss) * min(size, EVIDENCE)).sum()
        return self.langs[best], float(score), self.accepts(best, loss[best], size)

    def accepts(self, lang: int, loss: float, size: int) -> bool:
        if self.bounds is None:
            return True
        bound, variance = self.bounds[lang]
        return bool(loss <= bound + ERRORS * np.sqrt(variance / size))


def _codes(grams: np.ndarray) -> np.ndarray:
    """Code points of equally long grams, a row each."""
    return grams.view(np.uint32).reshape(len(grams), -1)


def _texts(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(f"U{codes.shape[1]}").ravel()


def kneser_ney(counts: pd.DataFrame, langs: list[str]) -> Model:
    """The models from a table of ``lang, gram, n`` with grams of ``ORDER`` characters."""
    width, tables = len(langs), {}
    grams = np.unique(counts["gram"].to_numpy(f"U{ORDER}"))
    table = np.zeros((len(grams), width))
    np.add.at(table, (np.searchsorted(grams, counts["gram"].to_numpy(f"U{ORDER}")),
                      counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)),
              counts["n"].to_numpy(float))
    tables[ORDER] = grams, table
    for n in range(ORDER - 1, 0, -1):  # the lower orders count different left neighbours
        suffixes, prefixes = _texts(_codes(grams)[:, 1:]), _texts(_codes(grams)[:, :-1])
        shorter = np.unique(np.concatenate((suffixes, prefixes)))
        lower = np.zeros((len(shorter), width))
        np.add.at(lower, np.searchsorted(shorter, suffixes), (table > 0).astype(float))
        grams, table = shorter, lower
        tables[n] = grams, table
    model = Model(langs, [], [], [], np.zeros(width), _LETTER_BITS)
    alphabet = len(tables[1][0]) + 1
    probability = None
    for n in range(1, ORDER + 1):
        grams, table = tables[n]
        ones, twos = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.clip(np.where(ones + twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5),
                           0.1, 0.95)
        if n == 1:
            contexts, at = np.array([""]), np.zeros(len(grams), int)
            lower = np.full((len(grams), width), 1.0 / alphabet)
        else:
            contexts = tables[n - 1][0]
            at = np.searchsorted(contexts, _texts(_codes(grams)[:, :-1]))
            lower = probability[np.searchsorted(contexts, _texts(_codes(grams)[:, 1:]))]
        total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
        np.add.at(total, at, table)
        np.add.at(kinds, at, (table > 0).astype(float))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        own = np.maximum(table - discount, 0) / np.maximum(total[at], 1)
        probability = own + weight[at] * lower
        if n == 1:
            model.floor = np.log(weight[0] / alphabet)
        else:
            model.weights.append(np.log(np.maximum(weight, 1e-12))[order])
        codes = _codes(grams).astype(np.uint64)
        hashes = np.zeros(len(grams), np.uint64)
        factor = 1
        for column in range(n - 1, -1, -1):
            hashes += (codes[:, column] + np.uint64(1)) * np.uint64(factor)
            factor = factor * _MULTIPLIER & (1 << 64) - 1
        order = np.argsort(hashes, kind="stable")
        model.hashes.append(hashes[order])
        model.logs.append(np.log(probability)[order])
    return model


def _grams(letters_packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.unpackbits(letters_packed).astype(bool)
        for batch in batches:
            found = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = symbols(text, letters)
                if codes is not None:
                    line = codes.astype(np.uint32).tobytes().decode("utf-32-le")
                    found.update((lang, line[i:i + ORDER])
                                 for i in range(len(line) - ORDER + 1))
            if found:
                yield pa.RecordBatch.from_pydict({
                    "lang": [k[0] for k in found], "gram": [k[1] for k in found],
                    "n": pa.array(found.values(), pa.int64())})

    return run


def _losses(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = model.unpacked()
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = symbols(text, letters)
                if codes is not None:
                    loss, variance, size = model.entropies(codes)
                    rows += [(own, own == lang, float(a), float(b), size)
                             for own, a, b in zip(model.langs, loss, variance)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), (
                        pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.int64()))],
                    names=["lang", "own", "loss", "variance", "size"])

    return run


def in_training(id_col: str = "doc_id") -> Column:
    """Labelled rows that may be learned from: CRC-32 of the id's text modulo 4 is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Counts in Spark over the bounded sample; smoothing of the counted grams on the driver."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"),
                           F.col(text).alias("text")).where(
        in_training("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.md5(F.concat(F.lit("language:"), F.col("id").cast("string")))
    first = Window.partitionBy("lang").orderBy("key", "id")
    keyed = labelled.select("id", "lang", key.alias("key"), F.length("text").alias("chars"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # one row per language
    # Keys are uniform: the first rows of a language lie in a small part of their range, so what
    # is ordered in one task is a few times the sample whatever the language's size.
    place = F.conv(F.substring("key", 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    # (every language has its model in memory, so a row for each is small to broadcast)
    chosen = keyed.join(F.broadcast(sizes), "lang").where(
        place * F.col("rows") <= 2 * sample_rows + 100) \
        .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample_rows) \
        .withColumn("upto", F.sum("chars").over(first.rowsBetween(Window.unboundedPreceding, 0))) \
        .where((F.col("upto") <= sample_chars) | (F.col("nth") == 1)) \
        .select("id", "lang", "nth").distinct()
    # at most sample_rows ids per language
    sample = labelled.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "text", "nth")
    sample = sample.persist()
    spare = (F.col("nth") % CALIBRATION == 0) & (F.col("nth") > CALIBRATION)
    counts = sample.where(~spare).select("lang", "text").mapInArrow(
        _grams(_LETTER_BITS), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    if not langs:
        return Model([], [], [], [], np.zeros(0), _LETTER_BITS)
    model = kneser_ney(counts, langs)
    seen = sample.where(spare & F.col("lang").isin(langs)).select("lang", "text").mapInArrow(
        _losses(model), "lang string, own boolean, loss double, variance double, size bigint"
    ).groupBy("lang", "own").agg(  # every symbol weighs the same
        (F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("mean"),
        (F.sum(F.col("variance") * F.col("size")) / F.sum("size")).alias("variance")).toPandas()
    sample.unpersist()
    mean = {(r.lang, r.own): r.mean for r in seen.itertuples()}
    variance = {r.lang: r.variance for r in seen.itertuples() if r.own}
    bounds = np.tile([np.inf, 0.0], (len(langs), 1))  # without calibration all is accepted
    for i, lang in enumerate(langs):
        if (lang, True) in mean:
            # with one language only, foreign is what has no pattern: all letters alike
            foreign = mean.get((lang, False), np.log(len(model.hashes[0])))
            low = mean[lang, True]
            bounds[i] = low + REACH * max(foreign - low, 0.5), variance[lang]
    model.bounds = bounds
    return model


VERDICT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("accepted", T.BooleanType())])


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "verdict") -> DataFrame:
    """``docs`` with a struct ``into``: (lang, score, accepted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, VERDICT)])
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        letters = own.unpacked()
        for batch in batches:
            judged = [own.judge(t.as_py(), letters) for t in batch.column(at)]
            column = pa.array([dict(zip(("lang", "score", "accepted"), j)) for j in judged], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column],
                                             names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang",
               id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    verdict = fresh(docs, "_verdict")
    return identify(docs, fit(docs, text, lang, id_col), text, verdict).where(
        F.col(f"{verdict}.accepted")).select(*docs.columns)
