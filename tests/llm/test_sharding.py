import random
import zlib

from tests.llm.conftest import CLASHES
from threadlake.llm import sharding


def test_tree_finds_the_tightest_room():
    rng, tree, plain = random.Random(1), sharding.RoomTree(), []
    for i in range(400):
        if plain and rng.random() < 0.5:
            size = rng.randint(1, 60)
            want = min((p for p in plain if p[0] >= size), default=None)
            assert tree.take(size) == want
            if want:
                plain.remove(want)
        else:
            plain.append((rng.randint(1, 50), i))
            tree.insert(*plain[-1])
    assert tree.take_largest() == max(plain)


def brute_best_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fits:
            i = min(fits)[1]
        else:
            rooms.append(max(capacity, size))
            i = len(rooms) - 1
        rooms[i] -= size
        out.append(i)
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(2)
    for _ in range(20):
        sizes = sorted((rng.randint(1, 60) for _ in range(200)), reverse=True)
        assert sharding.best_fit(sizes, None, 50) == brute_best_fit(sizes, 50)


def texts(count, seed=3):
    rng = random.Random(seed)
    return [(i, "é" * int(rng.paretovariate(1.1) * 20) if rng.random() < .7 else "same text", )
            for i in range(count)]


def test_plan(docs):
    rows = texts(3000) + [(9000, None), (9001, ""), (9002, None), (None, "without id")]
    got = sharding.plan(docs(rows), slices=8).collect()
    assert len(got) == len(rows)
    shard_of, bytes_in, slots = {}, {}, {}
    by_id = dict(rows)
    for r in got:
        text = by_id[r.doc_id]
        assert r.size == len((text or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((text or "").encode())
        assert shard_of.setdefault(text, r.shard) == r.shard  # equal texts together
        bytes_in[r.shard] = bytes_in.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(bytes_in) == set(range(16))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    groups = {}
    for r in got:
        groups[by_id[r.doc_id]] = groups.get(by_id[r.doc_id], 0) + r.size
    rooms = sharding.even_rooms(sorted(groups.values(), reverse=True), 16)
    want, have = sorted(rooms), sorted(bytes_in.values())
    assert all(abs(a - b) <= max(30, 0.01 * a) for a, b in zip(want, have))
    assert sorted(map(tuple, got), key=str) == sorted(
        map(tuple, sharding.plan(docs(rows)).collect()), key=str)


def test_pack_stays_in_capacity_and_near_the_least_number(spark):
    rng = random.Random(4)
    sizes = [rng.randint(1, 400) for _ in range(3000)] + [5000, 1200]
    groups = spark.createDataFrame([(str(i), s) for i, s in enumerate(sizes)],
                                   "_group string, _size bigint")
    got = {r._group: r._shard for r in sharding.pack(groups, 1000, zone_shards=64).collect()}
    assert len(got) == len(sizes)
    filled = {}
    for g, s in got.items():
        filled[s] = filled.get(s, 0) + sizes[int(g)]
    assert sorted(filled) == list(range(len(filled)))
    assert sorted(filled.values())[-2:] == [1200, 5000]  # too large: alone
    assert all(v <= 1000 for v in filled.values() if v not in (1200, 5000))
    zones = -(-sum(sizes) // 64000)
    assert len(filled) <= sum(sizes) / 1000 * 1.03 + zones + 2


def test_shard_rows_edges(docs):
    df = docs([(1, "a"), (1, "a"), (None, None), (2, "")], extra=CLASHES)
    out = sharding.shard_rows(df)
    assert out.columns == [*df.columns, "shard_1"] and out.count() == 4
    assert len({r.shard_1 for r in out.collect() if r.text == "a"}) == 1
    assert sharding.shard_rows(docs([])).collect() == []
    assert sharding.plan(docs([])).collect() == []
