import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES
from threadlake.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def key(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role.encode(),
            hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) by trying every edit."""
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, _, role, text in rows:
        told = text.rstrip(SPACES)
        faults.append(1 if not told else 2 if (role, text) in seen else 3 if told[-1] not in ".!?" else 0)
        seen.add((role, text))

    @cache
    def best(i, initials, inserted):
        """Least (cost, audit, lines) from row i; initials: the last said, and whether any was."""
        ways = []
        if i == len(rows):
            if initials in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text = rows[i][2:]
            cost, audit, lines = best(i + 1, initials, 0)
            ways.append((cost + 4, "D" + audit, lines))
            if faults[i] not in (1, 2):
                extra = 3 if faults[i] == 3 else 0
                for letter, new, price in (("K", role, extra), ("R", "user", 3 + extra),
                                           ("R", "assistant", 3 + extra)):
                    if follows(initials, new[:1]):
                        cost, audit, lines = best(i + 1, new[:1], 0)
                        ways.append((cost + price, letter + audit, (f"{new}:{text}", *lines)))
        for new in ("user", "assistant") if inserted < 2 else ():
            if follows(initials, new[0]):
                cost, audit, lines = best(i, new[0], inserted + 1)
                ways.append((cost + 3, "I" + audit, (f"{new}:", *lines)))
        return min(ways, default=(10 ** 9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, (1, 2, 3)),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def follows(last, new):
    return new in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[last] and new != ""


def expected(rows):
    by = defaultdict(list)
    for row in damaged(rows):
        by[row[0]].append(row)
    return {conv: plain(by[conv]) for conv in {r[0] for r in rows}}


def found(spark, rows, damage=True, extra=None, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra or ():
        df = df.withColumn(name, F.lit("x"))
    broken = repair.damage(df) if damage else df
    out = repair.digest(df, repair.repair(broken, **how))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                           "audit", "repaired_sha256"]
    rows = out.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def talk(rng, conv, size):
    texts = ["Yes.", "No!", "cut off", "Why?", "so. ", "", " \t", "a. b", "x" * 50 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "u", "robot"]
    return [(conv, rng.choice([t, t, t, t + 1, None]), rng.choice(roles[:rng.choice([2, 5, 9])]),
             rng.choice(texts) if rng.random() < .4 else f"say {rng.random()}" + rng.choice(".!? x"))
            for t in range(size)]


@pytest.mark.parametrize("how", [{}, {"part_rows": 3}, {"part_rows": 2, "max_passes": 0},
                                 {"part_rows": 5, "max_passes": 1}])
def test_equals_trying_every_edit(spark, how):
    rng = random.Random(4)
    rows = [r for c in range(70) for r in talk(rng, c, rng.randint(1, 14))]
    assert found(spark, rows, **how) == expected(rows)


@pytest.mark.parametrize("kinds", [["user", "assistant"], ["tool"], ["tool", "tool", "tool", "user"],
                                   ["assistant"]])
@pytest.mark.parametrize("passes", [0, 8])
def test_one_conversation_over_many_parts(spark, kinds, passes):
    rng = random.Random(len(kinds))
    rows = [(1, t, rng.choice(kinds) if rng.random() < .9 else "user",
             f"turn {t}" + rng.choice("..... x")) for t in range(400)]
    rows += [(0, 0, "system", "Before."), (2, 5, "user", "After.")]
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert found(spark, rows, part_rows=40, max_passes=passes) == expected(rows)
    finally:
        sys.setrecursionlimit(limit)


def test_edges(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "Hi."),
            (1, None, "user", "Hi."), (1, 2 ** 40, "assistant", "So. \n"), (2, 7, "system", "Only."),
            (3, 1, "user", "long " * 100_000 + "."), (4, 0, "", ""), (4, 9, "ünder", "Ä."),
            (5, 0, "s\nx", "A:B."), *[(6, i % 2, "user", "Same.") for i in range(300)],
            (7, 1, "assistant", "a" * 10 + SPACES)]
    got = found(spark, rows, extra=[c for c in CLASHES if c != "hit"] + ["conv", "seq", "key", "edit"])
    assert got == expected(rows)
    assert found(spark, rows, damage=False, part_rows=2) == {
        c: plain([(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3])
                  for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert found(spark, []) == {}


def test_nothing_left_after_damage(spark):
    conv = next(c for c in range(10_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    assert found(spark, [(conv, 0, "user", "Hi.")]) == {
        conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 2, "assistant", "C."), (1, 3, "user", "")]
    edits = repair.repair(spark.createDataFrame(rows, SCHEMA))
    out = repair.repaired(edits).orderBy("seq", "place").collect()
    assert [(r.role, r.text) for r in out] == [
        ("user", "A."), ("assistant", ""), ("user", "B."), ("assistant", "C.")]


def test_reruns_and_bases_equal_whole_runs():
    rng, machine = random.Random(9), repair.Machine()
    for _ in range(300):
        codes = [rng.choice([0, 2, 2, 3, 4, 4, 5, 6, 7]) for _ in range(rng.randint(0, 30))]
        end = tuple(rng.randint(0, 6) for _ in range(4))
        old = machine.run(codes, repair.UNKNOWN)
        assert machine.rerun(codes, repair.UNKNOWN, old, end) == machine.run(codes, end)
        whole = (machine.basis(codes) + end).min(axis=1)
        assert repair.normal(whole) == machine.run(codes, end)
