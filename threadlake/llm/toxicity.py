"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the first ``STEM`` letters of longer ones, hashed into
``BUCKETS`` rows. A text is read as blocks of ``BLOCK`` words; each pair of neighbouring blocks is a
window, and the distinct terms of a block each count once. The machine gives a window

    bias + sum of weights + sum over pairs of terms of the product of their factors

so a pair of terms that is toxic only together (an insult and the group it is aimed at) is learned
from the pairs, where additive weights would have to blame one of them alone. The score of a text is
that of its worst window, through the logistic function: what matters is local, and a long text does
not wash out one insult. Training goes the same way: the gradient of a text reaches the window that
scores highest (multiple-instance learning), with AdaGrad steps.

What is fitted on a bounded sample: weights and factors, on at most ``SAMPLE_ROWS`` labelled texts of
each class in hash order, whole texts; the bias is corrected for the share of the classes among all
labelled rows. The features are made in Spark, the fit runs in one task that holds the sample's terms
only. The model has at most ``BUCKETS`` rows, whatever the corpus. Every text is scored whole.

Cases. Null or empty text, text without words: one empty window, so the score is the bias. Null id:
scored, never learned from. Null label: never learned from; several labels of one id: toxic if any
is. No labelled row, or one class only: the share of toxic rows (a half without any) is every text's
score. Repeated rows: each by itself. Empty table: no rows. Extra columns: kept by ``score``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake.session import materialize

BUCKETS, SEED, STEM = 1 << 20, 13, 4
BLOCK = 16
FACTORS = 8
SAMPLE_ROWS = 6_000
EPOCHS, BATCH, RATE = 20, 128, 0.1
# Pull of weights and factors towards zero.
SHRINK = 1e-3
# Standard errors by which the log odds of a term in toxic and other texts must differ from zero for
# the term to be in the model. A term that is toxic only beside another one is so more often in
# toxic texts, too; terms that tell nothing would only add noise.
ERRORS = 3.0
TOXIC = 0.7
# Words whose terms a task remembers.
_REMEMBERED = 1 << 20
_CAPITALS = bytes(range(65, 91))
_SPLIT = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if c in _CAPITALS else c
               for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text, A to Z lower-cased; every ASCII sign but letters and digits separates."""
    return (text or b"").translate(_SPLIT).split()


def terms_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and, if it is longer, of its beginning."""
    letters = word.decode()
    whole = xxhash.xxh64_intdigest(word, SEED) % BUCKETS
    if len(letters) <= STEM:
        return (whole,)
    return whole, xxhash.xxh64_intdigest(letters[:STEM].encode() + b"*", SEED) % BUCKETS


def blocks(found: list[bytes], known) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each block, ordered by block, and the block of each.

    ``known`` gives the terms of a word that are to be counted.
    """
    terms, at = [], []
    for i in range(0, len(found), BLOCK):
        here = {t for w in found[i:i + BLOCK] for t in known(w)}
        terms.extend(here)
        at.extend([i // BLOCK] * len(here))
    return np.array(terms, np.int64), np.array(at, np.int64)


def _sums(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by ascending group numbers below ``size``."""
    out = np.zeros((size, *values.shape[1:]), np.float64)
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] = np.add.reduceat(values, first, axis=0)
    return out


@dataclass
class Model:
    """Bias, and for each known term (sorted buckets) its weight and factors."""
    bias: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def logits(self, rows: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Value of each window of ``size`` blocks of one or more texts, and the blocks' sums of factors.

        ``rows`` are places in ``terms``, ``at`` their blocks. Window ``i`` is block ``i`` and the next.
        """
        factors = self.factors[rows]
        line = _sums(self.weights[rows], at, size)
        sums, squares = _sums(factors, at, size), _sums((factors ** 2).sum(axis=1), at, size)
        pair = lambda x: x + np.concatenate((x[1:], np.zeros_like(x[:1])))
        both = pair(sums)
        return self.bias + pair(line) + 0.5 * ((both ** 2).sum(axis=1) - pair(squares)), both

    def lookup(self):
        """word -> places of its known terms, remembered."""
        place = {t: i for i, t in enumerate(self.terms.tolist())}
        seen: dict[bytes, tuple[int, ...]] = {}

        def known(word: bytes) -> tuple[int, ...]:
            out = seen.get(word)
            if out is None:
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                out = seen[word] = tuple(place[t] for t in terms_of(word) if t in place)
            return out

        return known

    def score(self, text: bytes | None, known) -> float:
        """Probability of the worst window of a text."""
        found = words(text)
        rows, at = blocks(found, known)
        values, _ = self.logits(rows, at, max(1, -(-len(found) // BLOCK)))
        return float(1 / (1 + np.exp(-np.clip(values.max(), -30, 30))))


def _held(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray):
    """Terms, and how many toxic and how many other texts hold each."""
    each = [np.unique(t) for t, _ in texts]
    terms, where = np.unique(np.concatenate(each), return_inverse=True)
    label = np.repeat(toxic, [len(t) for t in each])
    return (terms, np.bincount(where, label, len(terms)),
            np.bincount(where, 1 - label, len(terms)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, share: float,
          factors: int = FACTORS) -> Model:
    """A model from texts as ``blocks`` gives them, their labels, and the toxic share of all rows."""
    odds = float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share >= 1 else -30.0)
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Model(odds, factors=np.zeros((0, factors)))
    # Warm start: the log odds less their error, so that the first windows that count are telling.
    held, bad, fine = _held(texts, toxic)
    odds_of = np.log((bad + 1) / (toxic.sum() + 2)) - np.log((fine + 1) / ((toxic == 0).sum() + 2))
    error_of = np.sqrt(1 / (bad + 1) + 1 / (fine + 1))
    telling = np.abs(odds_of) >= ERRORS * error_of
    terms, odds_of, error_of = held[telling], odds_of[telling], error_of[telling]
    rng = np.random.Generator(np.random.PCG64(SEED))
    there = float(toxic.mean())
    model = Model(float(np.log(there / (1 - there))), terms,
                  np.sign(odds_of) * (np.abs(odds_of) - error_of),
                  rng.normal(0, 0.03, (len(terms), factors)))
    kept = []
    for found, at in texts:
        place = np.minimum(np.searchsorted(terms, found), max(0, len(terms) - 1))
        hit = terms[place] == found if len(terms) else np.zeros(len(found), bool)
        kept.append((place[hit], at[hit], int(at[-1]) + 1 if len(at) else 1))
    bias_step, weight_step = 1e-8, np.full(len(terms), 1e-8)
    factor_step = np.full((len(terms), factors), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(kept))
        for start in range(0, len(order), BATCH):
            batch = [kept[i] for i in order[start:start + BATCH]]
            # an empty block after each text keeps its last window to itself
            first = np.concatenate(([0], np.cumsum([n + 1 for _, _, n in batch])))
            rows = np.concatenate([r for r, _, _ in batch])
            at = np.concatenate([a + f for (_, a, _), f in zip(batch, first)])
            values, sums = model.logits(rows, at, int(first[-1]))
            values[first[1:] - 1] = -np.inf
            worst = np.array([f + int(values[f:e].argmax()) for f, e in zip(first, first[1:])])
            error = 1 / (1 + np.exp(-values[worst])) - toxic[order[start:start + BATCH]]
            # the terms of the worst window of each text
            lows, highs = np.searchsorted(at, worst), np.searchsorted(at, worst + 2)
            used = np.concatenate([rows[a:b] for a, b in zip(lows, highs)])
            owner = np.repeat(np.arange(len(batch)), highs - lows)
            touched, where = np.unique(used, return_inverse=True)
            by_weight = np.bincount(where, error[owner], len(touched)).astype(float)
            slope = error[owner, None] * (sums[worst][owner] - model.factors[used])
            by_weight += SHRINK * model.weights[touched]
            by_factor = SHRINK * model.factors[touched]
            for k in range(factors):
                by_factor[:, k] += np.bincount(where, slope[:, k], len(touched))
            bias_step += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(bias_step)
            weight_step[touched] += by_weight ** 2
            model.weights[touched] -= RATE * by_weight / np.sqrt(weight_step[touched])
            factor_step[touched] += by_factor ** 2
            model.factors[touched] -= RATE * by_factor / np.sqrt(factor_step[touched])
    model.bias += odds - float(np.log(there / (1 - there)))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks(words(t.as_py()), terms_of) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.list_(pa.int64())),
             pa.array([a for _, a in found], pa.list_(pa.int64())),
             pa.array(np.zeros(batch.num_rows, np.int32))],
            names=["key", "toxic", "terms", "at", "sample"])


def _fit(share: float, factors: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("toxic", "ascending")])
        texts = [(t.values.to_numpy(), a.values.to_numpy()) for t, a in zip(
            table["terms"], table["at"])]  # views of the table
        model = train(texts, table["toxic"].to_numpy().astype(float), share, factors)
        out = io.BytesIO()
        np.savez(out, bias=model.bias, terms=model.terms, weights=model.weights,
                 factors=model.factors)
        return pa.table({"model": pa.array([out.getvalue()], pa.binary())})

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: CRC-32 of the id's text modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id",
        toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS, factors: int = FACTORS) -> Model:
    """The model of the labelled texts that may be learned from."""
    known = labels.where(~held_out(id_col) & F.col(toxic).isNotNull()).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    key = F.md5(F.concat(F.lit("toxic:"), F.col("id").cast("string")))
    rows = materialize(texts.select("id").join(known, "id").select(
        "id", "toxic", key.alias("key")).distinct(), "labelled")
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    chosen = rows.where("toxic = 1").orderBy("key", "id").limit(sample_rows).unionByName(
        rows.where("toxic = 0").orderBy("key", "id").limit(sample_rows))
    # at most two samples of ids; copies of one id are learned from once
    sample = texts.join(F.broadcast(chosen), "id").groupBy("key", "toxic").agg(
        F.min("text").alias("text")).select("key", "toxic", F.col("text").cast("binary"))
    made = sample.mapInArrow(
        _features, "key string, toxic int, terms array<bigint>, at array<bigint>, sample int"
    ).groupBy("sample").applyInArrow(_fit(share, factors), "model binary").collect()
    if not made:
        return train([], np.zeros(0), share, factors)
    stored = np.load(io.BytesIO(made[0]["model"]))
    return Model(float(stored["bias"]), stored["terms"], stored["weights"], stored["factors"])


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with the toxicity of each text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS terms
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known = own.lookup()
        for batch in batches:
            values = [own.score(t.as_py(), known) for t in batch.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             names=[*batch.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields,
                                              T.StructField(into, T.DoubleType())]))
