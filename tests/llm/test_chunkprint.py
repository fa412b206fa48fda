import hashlib
import random

from tests.llm.conftest import CLASHES
from threadlake.llm import chunkprint


def brute_boundaries(data):
    """The same rules byte by byte."""
    gear, mask = [int(g) for g in chunkprint.GEAR], (1 << 32) - 1
    rolled, value = [], 0
    for byte in data:
        value = (value << 1) + gear[byte] & mask
        rolled.append(value)
    out, at = [], 0
    while len(data) - at > chunkprint.LEAST:
        end = min(at + chunkprint.GREATEST, len(data))
        for i in range(at + chunkprint.LEAST, end):
            bits = chunkprint.HARD_BITS if i < at + chunkprint.NORMAL else chunkprint.EASY_BITS
            if rolled[i] >> 32 - bits == 0:
                end = i + 1
                break
        out.append(end)
        at = end
    return out + [len(data)] if at < len(data) else out


def letters(rng, size):
    return "".join(rng.choice("abcdefgh é日") for _ in range(size))


def test_boundaries_equal_brute_force():
    rng = random.Random(1)
    for size in [0, 1, 31, 32, 33, 64, 500, 5000]:
        data = letters(rng, size).encode()
        assert chunkprint.boundaries(data) == brute_boundaries(data)


def test_shift_resistance():
    rng = random.Random(2)
    text = letters(rng, 20_000)
    own = chunkprint.chunks(text)
    assert chunkprint.containment(own, chunkprint.chunks("xyz" + text)) > 0.95
    assert chunkprint.containment(own, chunkprint.chunks(text[:9000] + "!" + text[9000:])) > 0.95
    assert chunkprint.containment(own, chunkprint.chunks(letters(rng, 20_000))) < 0.05
    assert chunkprint.containment(set(), set()) == 1.0
    assert chunkprint.containment(set(), own) == 0.0


def test_neighbours_over_ranges(docs):
    rng = random.Random(3)
    rows = [(i * 7, letters(rng, rng.randint(0, 900))) for i in range(80)]
    rows += [(None, "no id"), (-5, None), (7, "repeated id")]
    df = docs(rows, extra=CLASHES)
    outs = [sorted(map(tuple, chunkprint.edited_neighbours(df, ranges=n).collect()), key=str)
            for n in (1, 4, 23)]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == len(rows)
    ids = sorted({i for i, _ in rows if i is not None and i != 7}, reverse=True)
    texts = dict(rows) | {7: None}
    got = {r[0]: r for r in outs[0]}
    for a, b in zip(ids, ids[1:]):
        if 7 in range(b, a) or texts[b] is None:
            continue
        text, half = texts[a] or "", len(texts[a] or "") // 2
        changed = text[:len(text) - half] + texts[b][:half]
        assert got[a][1] == len(text)
        assert got[a][2] == hashlib.sha256(changed.encode()).hexdigest()
        own = chunkprint.chunks(text)
        assert got[a][5] == chunkprint.containment(own, chunkprint.chunks(changed))
        assert got[a][6] == chunkprint.containment(own, chunkprint.chunks(texts[b]))
    # the last one in order (the null id) meets the first
    first = texts[ids[0]]
    assert got[None][2] == hashlib.sha256(("no " + first[:2]).encode()).hexdigest()


def test_one_and_none(docs):
    assert chunkprint.edited_neighbours(docs([])).collect() == []
    only = chunkprint.edited_neighbours(docs([(1, "abcd")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and only.near_next == 1.0
