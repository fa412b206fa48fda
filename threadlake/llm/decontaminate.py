"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into passages of at most ``WINDOW`` words. Their TF-IDF rows, with document
frequencies counted over the whole corpus, are factored by a distributed randomised SVD: tasks hold
rows and return partial sums of A'AQ, the driver holds the small factor only. Every document is read
as overlapping windows of words; a window is projected through the same factor and compared with
every passage by cosine, in which no word of the window outweighs the mean word of the passage, so that
its recall does not fall as rare words gain weight in a larger corpus. The few windows above ``COSINE`` are checked word by word: the longest
common subsequence of the benchmark text and the neighbourhood of the window must cover ``COPIED``
of the text, or ``PARAPHRASED`` of it with the answer (the last sentence) found word for word.

Benchmark texts are indexed in blocks of ``BLOCK_ITEMS`` texts and ``SPREAD * RANK`` passages at most, each
with a factor of its own of rank ``RANK``; scores are calibrated by the share of a passage that the
factor holds, so that whole copies score as without the reduction. A pass over the corpus searches
``PASS_BLOCKS`` blocks (more only for the blocks of one very long text); a larger benchmark takes more
passes, so what is broadcast stays bounded.

Cases. Null or empty text: not contaminated. Null or empty benchmark text: matches nothing.
Benchmark texts under ``LEAST_WORDS`` words: matched by their full word sequence only. Repeated rows:
each by itself. Null ids: kept. Empty tables: no matches. Extra columns: kept by ``keep_clean``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from threadlake.session import materialize

WINDOW, STRIDE = 40, 20
RANK, OVERSAMPLE, POWER_STEPS = 192, 16, 1
# Passages of a block for each column of its factor, and the least share of a passage's energy that
# the factor is taken to hold.
SPREAD, HELD = 2, 0.1
COSINE = 0.3
# Mean weights of passages within this factor share a level.
LEVEL = 1.25
# TF-IDF weight under which a word (here: in over a third of the documents) is not projected.
LIGHT = 1.0
COPIED, PARAPHRASED = 0.7, 0.5
LEAST_WORDS = 5
BLOCK_ITEMS, PASS_BLOCKS = 256, 8
# Windows whose sums a task holds at once, in strides.
_SLAB = 1024
# Strides of the texts that are searched together.
_TOGETHER = 256
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_BLANKED = bytes(32 if c in _SEPARATORS else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; every ASCII character but letters and digits separates."""
    return (text or "").lower().encode().translate(_BLANKED).split()


def places_of(a: list) -> dict:
    """For each word the bits of its places in ``a``."""
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    return places


def common_subsequence(places: dict, size: int, b: list) -> int:
    """Length of the longest common subsequence of ``b`` and the ``size`` words of ``places``.

    The row of the usual table is kept as bits: a word of ``b`` changes it in a few operations.
    """
    full = row = (1 << size) - 1
    for word in b:
        hit = row & places.get(word, 0)
        if hit:
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


def has_run(run: list, text: list) -> bool:
    """True if ``run`` occurs in ``text`` word for word."""
    if not run:
        return False
    return any(text[i:i + len(run)] == run
               for i, word in enumerate(text[:len(text) - len(run) + 1]) if word == run[0])


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence that has at least two, or nothing."""
    sentences = text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".")
    for sentence in reversed(sentences):
        if len(found := words(sentence)) >= 2:
            return found
    return []


@dataclass
class Index:
    """What a task needs to search one block of benchmark texts."""
    vocabulary: dict[bytes, int]      # word -> row of the factor
    squares: np.ndarray               # squared weight of each word; the last is "other word"
    capped: np.ndarray                # the same cut at the weight of each level
    level: np.ndarray                 # passage -> level
    least: np.ndarray                 # passage -> least score that is checked
    heavy: np.ndarray                 # words that are projected; the last is False
    factor: np.ndarray                # (words, rank)
    passages: np.ndarray              # (rank, passages), see build_index
    owner: np.ndarray                 # passage -> item
    items: list[tuple]                # (id, number of words, places of words, words, answer)
    rows: list[int]                   # item -> row of the benchmark; a long text has several blocks

    def __post_init__(self) -> None:
        # "other word" and, last, no word: the end of a text is filled up to a stride with it
        self._known = np.append(self.squares[:-1], [0, 0]).astype(np.float32)
        self._capped = np.pad(self.capped, ((0, 0), (0, 1)))
        self._heavy = np.append(self.heavy, False)
        lowest = np.full(len(self.capped), np.inf, np.float32)
        np.minimum.at(lowest, self.level, self.least)
        self._lowest = lowest[:, None] ** 2

    def _near(self, ids: np.ndarray, goes_on: np.ndarray | None = None,
              whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(stride, passage) numbers of the windows whose score is high enough.

        ``ids`` are the words of strides; a window is a stride and the next one where the text
        ``goes_on``, or alone where it is the ``whole`` text. Without these they are one text.

        The score is the cosine, but no word of the window counts in its norm with more than the
        weight of the passage's level, which is at most the mean weight of the passage's words. So
        rare words around a short copy, whose weight grows with the corpus, do not hide it: a
        window that holds ``n`` words of a passage word for word scores ``(n / WINDOW) ** 0.5``.

        Words outside the benchmark only add to the norm of a window, so its score is at most the
        root of their squared weight over the squared norm (words repeated in it aside). Windows
        under that for every passage are not projected.
        """
        starts = np.arange(0, len(ids), STRIDE)
        if goes_on is None:
            goes_on = starts < starts[-1]
            whole = ~goes_on if len(starts) == 1 else np.zeros(len(starts), bool)
        on = np.flatnonzero(goes_on)
        shares = np.add.reduceat(self._known[ids], starts)
        norms = np.add.reduceat(self._capped[:, ids], starts, axis=1)
        shares[on] = shares[on] + shares[on + 1]
        norms[:, on] = norms[:, on] + norms[:, on + 1]
        live = np.flatnonzero((shares >= (self._lowest * norms).min(axis=0)) & (shares > 0) & (goes_on | whole))
        two = goes_on[live]
        needed = np.zeros(len(starts), bool)
        needed[live] = needed[live[two] + 1] = True
        used = np.flatnonzero(self._heavy[ids] & np.repeat(needed, STRIDE)[:len(ids)])
        if not len(used):
            return live[:0], live[:0]
        sums = np.zeros((len(starts), self.factor.shape[1]), np.float32)
        block = used // STRIDE
        first = np.flatnonzero(np.diff(block, prepend=-1))
        sums[block[first]] = np.add.reduceat(self.factor[ids[used]], first, axis=0)
        windows = sums[live]
        windows[two] += sums[live[two] + 1]
        rows, passages = np.nonzero(
            windows @ self.passages >= np.sqrt(norms[:, live]).T[:, self.level] * self.least)
        return live[rows], passages

    def matches(self, found: list[bytes]) -> list[tuple[int, object, float]]:
        """(row, item id, share of its words found in order) for every item in the words of a text."""
        return self.matches_of([found])[0]

    def matches_of(self, texts: list[list[bytes]]) -> list[list[tuple[int, object, float]]]:
        """``matches`` of each text; one product serves the windows of them all."""
        sizes = np.array([-(-len(found) // STRIDE) for found in texts])
        text = np.repeat(np.arange(len(texts)), sizes)
        begun = np.cumsum(sizes) - sizes
        ids = np.full(len(text) * STRIDE, len(self.factor) + 1, np.int64)
        for found, at in zip(texts, (begun * STRIDE).tolist()):
            ids[at:at + len(found)] = np.fromiter(
                map(self.vocabulary.get, found, repeat(len(self.factor))), np.int64, len(found))
        goes_on, whole = np.append(text[1:] == text[:-1], False), sizes[text] == 1
        near: list[dict[int, set[int]]] = [{} for _ in texts]
        for low in range(0, len(text), _SLAB):  # slabs share one stride
            here = slice(low, low + _SLAB + 1)
            on = goes_on[here].copy()
            on[min(_SLAB, len(on) - 1)] = False  # the next slab has the window that begins here
            windows, passages = self._near(ids[low * STRIDE:here.stop * STRIDE], on, whole[here])
            windows += low
            for no, start, item in zip(text[windows].tolist(), (windows - begun[text[windows]]).tolist(),
                                       self.owner[passages].tolist()):
                near[no].setdefault(item, set()).add(start * STRIDE)
        return [self._checked(found, items) for found, items in zip(texts, near)]

    def _checked(self, found: list[bytes], near: dict[int, set[int]]) -> list[tuple[int, object, float]]:
        """What the words confirm of the items near the starts of windows."""
        out = []
        for item, starts in near.items():
            id_, size, places, wanted, answer = self.items[item]
            best, reach = 0.0, max(STRIDE, size)  # the text may begin before and end after
            for start in sorted(starts):
                words_near = found[max(0, start - reach):start + WINDOW + reach]
                if sum(map(places.__contains__, words_near)) < PARAPHRASED * size:
                    continue  # the subsequence cannot be longer than that
                share = common_subsequence(places, size, words_near) / size
                if size < LEAST_WORDS:
                    share = float(has_run(wanted, words_near))
                elif share < COPIED and not (
                        share >= PARAPHRASED and answer and has_run(answer, words_near)):
                    continue
                best = max(best, share)
            if best:
                out.append((self.rows[item], id_, best))
        return out


def _found(pass_: list[Index], texts: list[list[bytes]]) -> list[list[tuple[object, float]]]:
    found = [index.matches_of(texts) for index in pass_]
    out = []
    for matched in zip(*found):
        best: dict = {}
        for row, id_, share in chain.from_iterable(matched):
            best[row] = max(best.get(row, (id_, share)), (id_, share), key=lambda m: m[1])
        out.append(list(best.values()))
    return out


def search_all(pass_: list[Index], texts: Iterable[str | None]) -> Iterator[list[tuple[object, float]]]:
    """(item id, share) of the benchmark texts in each text; some short texts are searched together."""
    held, size = [], 0
    for text in texts:
        held.append(words(text))
        size += len(held[-1])
        if size >= _TOGETHER * STRIDE or len(held) == _TOGETHER:
            yield from _found(pass_, held)
            held, size = [], 0
    if held:
        yield from _found(pass_, held)


def search(pass_: list[Index], text: str | None) -> list[tuple[object, float]]:
    return next(search_all(pass_, [text]))


def _frequencies(vocabulary: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                counts.update(vocabulary.intersection(words(text.as_py())))
            rows += batch.num_rows
        yield pa.RecordBatch.from_pydict({
            "word": pa.array([b"", *counts], pa.binary()),
            "n": pa.array([rows, *counts.values()], pa.int64())})

    return run


def _products(basis: np.ndarray):
    """Partial A'AQ of the passages a task holds, as blocks of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for ids, weights in zip(batch["ids"], batch["weights"]):
                weights = np.asarray(weights, np.float32)
                total[ids] += weights[:, None] * (weights @ basis[ids])[None, :]
        yield pd.DataFrame({"at": [0], "part": [total.tobytes()]})

    return run


def _sum(shape):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape, np.float32)
        for part in batch["part"]:
            total += np.frombuffer(part, np.float32).reshape(shape)
        return pd.DataFrame({"part": [total.tobytes()]})

    return run


def randomised_svd(rows: DataFrame, width: int, rank: int) -> np.ndarray:
    """Right singular vectors (width, rank) of the sparse rows ``ids, weights``.

    Only sums of width x (rank + oversample) travel; the driver orthogonalises them.
    """
    size = min(width, rank + OVERSAMPLE)  # 32-bit numbers: the factor ranks, it does not decide
    basis = np.random.Generator(np.random.PCG64(7)).standard_normal((width, size), np.float32)

    def product(q):
        parts = rows.select("ids", "weights").mapInPandas(_products(q), "at int, part binary")
        found = parts.groupBy("at").applyInPandas(_sum(q.shape), "part binary").collect()
        return np.frombuffer(found[0]["part"], np.float32).reshape(q.shape)

    for _ in range(POWER_STEPS + 1):
        basis, _ = np.linalg.qr(product(basis))
    small = basis.T @ product(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:min(rank, size)]]


def _blocks(items: DataFrame, block: int) -> Iterator[list]:
    """Benchmark rows in blocks of bounded size."""
    stored = materialize(items.withColumn("nth", F.row_number().over(
        Window.orderBy("text", "item")) - 1), "items")
    for at in range(0, stored.count(), block):
        yield stored.where(F.col("nth").between(at, at + block - 1)).orderBy("nth").collect()


def frequencies(corpus: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """Documents that hold each word, over the whole corpus; the empty word has all of them."""
    counted = corpus.mapInArrow(_frequencies(vocabulary), "word binary, n bigint").groupBy(
        "word").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    return {bytes(r["word"]): r["n"] for r in counted}


def cut_starts(found: list[bytes]) -> range:
    """First words of the passages of a benchmark text."""
    return range(0, max(1, len(found) - STRIDE), STRIDE)


def index_blocks(known: list[tuple], block: int, rank: int) -> Iterator[list[tuple[int, range]]]:
    """(row, starts of passages) in blocks of at most ``block`` texts and ``SPREAD * rank`` passages.

    So the factor reduces, but holds a fair share of every passage. A text of more passages than that
    goes on in the next blocks.
    """
    here, held, rank = [], 0, SPREAD * rank
    for row, (_, found, _) in enumerate(known):
        starts = cut_starts(found)
        while starts:
            if here and (len(here) == block or held + min(len(starts), rank) > rank):
                yield here
                here, held = [], 0
            here.append((row, starts[:rank]))
            held += len(here[-1][1])
            starts = starts[rank:]
    if here:
        yield here


def build_index(spark: SparkSession, known: list[tuple], seen: dict[bytes, int],
                rank: int = RANK, part: list[tuple[int, range]] | None = None) -> Index:
    """Index of the passages ``part`` (all, if not given) of benchmark texts (id, words, answer)."""
    if part is None:
        part = [(row, cut_starts(found)) for row, (_, found, _) in enumerate(known)]
    known = [known[row] for row, _ in part]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws, _ in known for w in ws}))}
    total = seen.get(b"", 0)
    weight = np.log((1.0 + total) / (1.0 + np.array([seen.get(w, 0) for w in vocabulary]))) + 0.01
    cut, owner, mean, sizes = [], [], [], []
    for i, (_, found, _) in enumerate(known):
        for start in part[i][1]:
            ids = [vocabulary[w] for w in found[start:start + WINDOW]]
            count = Counter(ids)
            mean.append(float(np.sqrt(np.mean(weight[ids] ** 2))))
            sizes.append(len(ids))
            cut.append(([*count], [c * float(weight[w]) for w, c in count.items()]))
            owner.append(i)
    # Rows of length one: the factor is for cosines, and a short passage counts like a long one.
    norms = np.array([np.linalg.norm(w) for _, w in cut])
    rows = spark.createDataFrame([(ids, [x / float(n) for x in w]) for (ids, w), n in zip(cut, norms)],
                                 "ids array<int>, weights array<double>").repartition(8)
    vectors = randomised_svd(rows, len(vocabulary), min(rank, len(cut)))
    other = np.log(1.0 + total) + 0.01
    # The factor has fewer columns than the block has passages and holds a share of each. Divided by
    # that share, a window with the whole passage in it scores as it would without the reduction.
    passages = np.stack([np.asarray(w) @ vectors[ids] for ids, w in cut])
    held = np.maximum(HELD, (passages ** 2).sum(axis=1) / norms ** 2)
    norms *= held
    # Words of little weight decide nothing where every passage has heavier ones.
    heavy = weight >= LIGHT
    shares = [sum(x * x for i, x in zip(ids, w) if heavy[i]) / sum(x * x for x in w)
              for ids, w in cut]
    if min(shares) < 0.9:
        heavy[:] = True
    squares = np.append(weight, other).astype(np.float32) ** 2
    steps, level = np.unique(np.floor(np.log(mean) / np.log(LEVEL)), return_inverse=True)
    caps = (LEVEL ** steps[:, None]).astype(np.float32) ** 2
    # A text of a few words fills little of a window; 0.85 for the words that are not projected.
    # What the factor does not hold of a passage makes its scores less sure.
    least = np.minimum(COSINE * np.sqrt(held), 0.85 * np.sqrt(np.array(sizes) / WINDOW)).astype(np.float32)
    return Index(
        vocabulary, squares, np.minimum(squares, caps), level, least, np.append(heavy, False),
        (weight[:, None] * vectors).astype(np.float32),
        (passages / norms[:, None]).T.astype(np.float32), np.array(owner),
        [(id_, len(found), places_of(found), found, answer) for id_, found, answer in known],
        [row for row, _ in part])


def passes(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item_id: str,
           rank: int = RANK, block: int = BLOCK_ITEMS) -> Iterator[list[Index]]:
    """Indexes of the benchmark, in the groups that one pass over the corpus searches."""
    items = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(
        F.col("text").isNotNull())
    for rows in _blocks(items, block * PASS_BLOCKS):
        known = [(r["item"], words(r["text"]), answer_of(r["text"])) for r in rows]
        known = [k for k in known if k[1]]
        if known:
            seen = frequencies(docs.select(text), frozenset(w for _, ws, _ in known for w in ws))
            pass_, last = [], None
            for part in index_blocks(known, block, rank):
                # the blocks of one text stay in one pass, which gives a row for it
                if len(pass_) >= PASS_BLOCKS and part[0][0] != last:
                    yield pass_
                    pass_ = []
                pass_.append(build_index(docs.sparkSession, known, seen, rank, part))
                last = part[-1][0]
            yield pass_


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id",
            item_text: str = "text", item_id: str = "item_id", rank: int = RANK,
            block: int = BLOCK_ITEMS) -> DataFrame:
    """``id, item, share``: one row per document row and benchmark text found in it."""
    spark = docs.sparkSession
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in
                       ((docs, id_col), (benchmark, item_id)))
    benchmark_type = benchmark.schema[item_id].dataType
    schema = f"id {kind}, item {item_kind}, share double"

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = search_all(index, (t.as_py() for t in batch.column(1)))
                rows = [(i.as_py(), item, share) for i, of in zip(batch.column(0), found)
                        for item, share in of]
                if rows:
                    ids, items, shares = zip(*rows)
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(ids, batch.schema.field(0).type), "item": pa.array(items, to_arrow_type(benchmark_type)),
                        "share": pa.array(shares, pa.float64())})
        return run

    out = spark.createDataFrame([], schema)
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    for index in passes(docs, benchmark, text, item_text, item_id, rank, block):
        shared = spark.sparkContext.broadcast(index)  # bounded by the block of passages
        out = out.unionByName(pairs.mapInArrow(searcher(shared), schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id),
                      F.round("share", 4).alias("share"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text",
               item_text: str = "text", item_id: str = "item_id", rank: int = RANK,
               block: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the rows in which a benchmark text is found."""
    spark, at = docs.sparkSession, docs.columns.index(text)

    def keeper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                clean = [not found for found in search_all(index, (t.as_py() for t in batch.column(at)))]
                yield batch.filter(pa.array(clean, pa.bool_()))
        return run

    out = docs
    for index in passes(docs, benchmark, text, item_text, item_id, rank, block):
        out = out.mapInArrow(keeper(spark.sparkContext.broadcast(index)), docs.schema)
    return out
