import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tests.llm.conftest import CLASHES
from threadlake.llm import langid

WORDS = {"en": "the of and to in that is was he for it with as his on be at by had not are but "
               "from this have which one you were her all she there would their",
         "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
               "auch es an werden aus er hat dass sie nach wird bei einer",
         "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se "
               "le ce il sont avec son cette mais comme"}


def text_of(rng, lang, size=60):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(size))


def rows_for(seed, count=240):
    rng = random.Random(seed)
    return [(i, text_of(rng, lang), lang) for i in range(count)
            for lang in [rng.choice(list(WORDS))]]


@pytest.fixture(scope="module")
def model(spark):
    from tests.llm.conftest import DOCS
    df = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows_for(1)], DOCS)
    return langid.fit(df)


def test_probabilities_sum_to_one(model):
    """After any context, over the alphabet and one unknown symbol, in every language."""
    letters = model.unpacked()
    alphabet = sorted({c for t in WORDS.values() for c in t if c != " "}) + [" "]
    for context in ("the", "xqz", " de", "ein"):
        total = np.zeros(len(model.langs))
        for c in [*alphabet, "\x01", "一"]:
            codes = np.array([1, 1, 1, *map(ord, context), ord(c)], np.uint64)
            hashes = langid.gram_hashes(codes)
            total += np.exp(model._log(langid.ORDER, hashes, np.array([len(codes) - 1]))[0])
        assert total == pytest.approx(np.ones(len(model.langs)), abs=0.03)
    assert letters[ord("a")] and not letters[ord("1")]


class PlainKneserNey:
    """One language's interpolated Kneser-Ney model, written out with dictionaries."""

    def __init__(self, lines, alphabet):
        self.alphabet, self.counts = alphabet, {}
        top = Counter(line[i:i + 4] for line in lines for i in range(len(line) - 3))
        self.counts[4] = top
        for n in (3, 2, 1):  # a shorter gram counts its different left neighbours
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discount = {}
        for n, table in self.counts.items():
            ones, twos = (sum(c == k for c in table.values()) for k in (1, 2))
            self.discount[n] = min(max(ones / (ones + 2 * twos) if ones + twos else .5, .1), .95)

    def probability(self, gram):
        n = len(gram)
        lower = self.probability(gram[1:]) if n > 1 else 1 / self.alphabet
        table = self.counts[n]
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        if not after:
            return lower
        own = max(table[gram] - self.discount[n], 0) / sum(after)
        return own + self.discount[n] * len(after) / sum(after) * lower


def test_models_equal_plain_kneser_ney():
    """Scores, entropies and verdicts of the hash arrays against the written-out models."""
    rng = random.Random(21)
    letters = np.unpackbits(langid._LETTER_BITS).astype(bool)

    def line(text):
        return langid.symbols(text, letters).astype(np.uint32).tobytes().decode("utf-32-le")

    texts = {lang: [text_of(rng, lang, rng.randint(1, 12)) for _ in range(12)] for lang in WORDS}
    rows = Counter((lang, line(t)[i:i + 4]) for lang, ts in texts.items() for t in ts
                   for i in range(len(line(t)) - 3))
    counts = pd.DataFrame([(lang, g, n) for (lang, g), n in rows.items()], columns=["lang", "gram", "n"])
    langs = sorted(WORDS)
    model = langid.kneser_ney(counts, langs)
    grams = {g for _, g in rows}
    for _ in range(3):
        grams |= {g[1:] for g in grams} | {g[:-1] for g in grams if len(g) > 1}
    alphabet = len({g for g in grams if len(g) == 1}) + 1
    plain = [PlainKneserNey([line(t) for t in texts[lang]], alphabet) for lang in langs]
    for _ in range(25):
        text = text_of(rng, rng.choice(langs), rng.randint(1, 6)) + rng.choice(["", " zqx", " ÿ"])
        symbols = line(text)
        want = [-sum(math.log(p.probability(symbols[i:i + 4])) for i in range(len(symbols) - 3))
                / (len(symbols) - 3) for p in plain]
        loss, _, size = model.entropies(langid.symbols(text, letters))
        assert size == len(symbols) - 3
        assert loss == pytest.approx(np.array(want), rel=1e-9)
        assert model.judge(text, letters)[0] == langs[int(np.argmin(want))]
    # equal cross-entropies: the first name wins
    same = pd.concat([counts[counts.lang == "en"].assign(lang=x) for x in ("b", "a")])
    assert langid.kneser_ney(same, ["a", "b"]).judge("the", letters)[0] == "a"


def test_repeated_rows_and_very_long_texts(docs, model):
    long_ = text_of(random.Random(2), "de", 60_000)
    rows = [(1, long_), (1, long_), (2, "the " * 100_000), (3, "x" * 300_000)]
    got = langid.identify(docs(rows), model).collect()
    assert len(got) == 4
    by = {r.doc_id: r.verdict for r in got}
    assert by[1].lang == "de" and by[1].accepted and by[2].lang == "en"


def test_accuracy_on_held_out(docs, model):
    rows = rows_for(2)
    right = [r.verdict.lang == r.lang and r.verdict.accepted
             for r in langid.identify(docs(rows), model).collect()]
    assert np.mean(right) > 0.99


def test_held_out_rows_are_not_learned_from(docs):
    import zlib
    rows = [(i, "qqqq" if zlib.crc32(str(i).encode()) % 4 == 2 else text_of(random.Random(i), "en"),
             "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "en") for i in range(40)]
    assert langid.fit(docs(rows)).langs == ["en"]


def test_foreign_and_noise_are_rejected(docs, model):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzßøπ") for _ in range(9))
                     for _ in range(80))
    mixed = text_of(rng, "en", 80) + " " + text_of(rng, "de", 25)
    rows = [(1, noise), (2, mixed), (3, text_of(rng, "fr", 5)), (4, "12 34 !"), (5, None), (6, "")]
    got = {r.doc_id: r.verdict for r in langid.identify(docs(rows, extra=CLASHES[:4]), model)
           .collect()}
    assert not got[1].accepted and got[2].accepted and got[3].accepted
    for i in (4, 5, 6):
        assert (got[i].lang, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert all(0 <= v.score <= 1 for v in got.values())


def test_sorted_arrays_hold_every_gram(model):
    for own in model.hashes:
        assert (np.diff(own.astype(np.float64)) >= 0).all() and len(np.unique(own)) == len(own)


def test_edges(docs):
    assert langid.keep_known(docs([])).collect() == []
    rows = [(None, "no id", "en"), (1, "no label", None), (2, None, "en")]
    df = docs(rows)
    assert langid.fit(df).langs == []
    assert langid.keep_known(df).collect() == []
    plain = docs([*rows_for(4, 60), (None, "the of and to in that", None)], extra=CLASHES)
    kept = langid.keep_known(plain)
    assert kept.columns == plain.columns and kept.count() == 61
