import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import CLASHES
from threadlake.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    """(kind, start, end) of the base kinds by their plain forms."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+",
         lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules
            for m in re.finditer(p, text or "") if ok(m[0])]


def found(df):
    return [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find(df).collect()]


def test_base_spans_equal_brute_force(docs):
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "x@y.zz", "d@e.f_g@h.i", ".", "..", "-", "+", " ", "1", "255", "256",
              "0.0.0.0", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+1",
              "(555) 123-4567", "+44 20 7946 0958", "12345678901234567890", "é", "😀", "\n", "%",
              "378282246310005", "5500000000000004"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))))
            for i in range(1500)]
    texts = dict(rows)
    for id_, spans in found(docs(rows)):
        assert [s for s in spans if s[0] != "iban"] == brute(texts[id_]), texts[id_]


def test_many_matches_and_long_runs(docs):
    many = "call +1 555 123 4567, " * 3000
    rows = [(1, many), (2, "9" * 3000), (3, "a" * 3000 + "@"), (4, "1 " * 50_000),
            (5, "x@y.z " * 600)]
    texts = dict(rows)
    for id_, spans in found(docs(rows)):
        assert spans == brute(texts[id_])
    # runs on which the plain forms take quadratic time
    assert found(docs([(1, "9" * 500_000), (2, "a" * 500_000 + "@")])) == [(1, []), (2, [])]


def test_accounts_and_context(docs):
    df = docs([(1, "my IBAN is GB82 WEST 1234 5698 7654 32."), (2, "GB82WEST12345698765432"),
               (3, "GB82WEST12345698765433"), (4, "xGB82WEST12345698765432")])
    got = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(s.kind, s.start, s.end, s.score) for s in got[1]] == [("iban", 11, 38, 1.0)]
    assert [(s.start, s.end, s.score) for s in got[2]] == [(0, 22, 0.7)]
    assert got[3] == [] and got[4] == []


def test_digest_mask_and_edges(docs):
    text = "mail é a@b.cc or +1 555 123 4567"
    df = docs([(1, text), (1, text), (None, None), (2, "")], extra=CLASHES)
    rows = pii.digest(pii.find(df, into="found"), spans="found").collect()
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text))
    for r in rows:
        want = line if r.doc_id == 1 else ""
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_email, r.n_phone, r.n_ip) == ((1, 1, 0) if want else (0, 0, 0))
    masked = pii.mask(df)
    assert masked.columns == df.columns
    assert {r.text for r in masked.where(F.col("doc_id") == 1).collect()} == {
        "mail é [email] or [phone]"}
    assert pii.find(docs([])).collect() == []


def test_mask_cuts_spans_and_nothing_else(docs):
    rows = [(1, "1.2.3.4 and 21.2.3.45.9.9 here 11.2.3.4x"), (2, "x@y.zz"), (3, "a 1.2.3.4"),
            (4, "not 1.2.3.400 é 1.2.3.4 é"), (5, None), (6, ""), (7, "1.2.3.4 " * 400),
            (8, "+1 555 123 4567 8901 2345 x"), (9, "4111 1111 1111 1111@b.cc")]
    df = docs(rows, extra=CLASHES)
    spans = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans2] for r in pii.find(df, into="spans2").collect()}
    for r in pii.mask(df).collect():
        text, out, at = dict(rows)[r.doc_id], "", 0
        for start, end, kind in sorted(spans[r.doc_id]):
            if start >= at:
                out += text[at:start] + f"[{kind}]"
            at = max(at, end)
        assert r.text == (None if text is None else out + text[at:])
    assert spans[1]  # the planted values are found
