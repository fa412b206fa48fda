"""Personal data, with DataFrame functions only: propose, validate, score by context.

Regular expressions propose spans of five kinds; validators confirm them (parts of an address up to
255, Luhn for cards, the number of digits for phones, mod 97 for bank accounts); words near a span
raise its score. Texts never leave the row and nothing is shuffled.

Positions come from two scans by the same expression: its matches and the gaps between them
alternate, so a match begins after all gaps and matches before it. The expressions take the same
matches as the plain forms in the docstring of ``EXPRESSIONS`` in time linear in the text: they
start at the beginning of a run only and never give back characters.

Cases. Null or empty text: no spans. Repeated rows: each by itself. Null ids: kept. Empty table: no
rows. Extra columns: kept by ``find`` and ``mask``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import fresh

KINDS = ("email", "ip", "card", "phone", "iban")

# Fixed values. Plain forms, leftmost and without overlaps inside a kind:
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card   [0-9]([\x20-]?[0-9])+ with 13 to 19 digits
#   phone  \+[0-9][\x20().0-9-]+[0-9]
# A run begins after a character outside it or where the last match ended (\G).
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
}
# Score of a confirmed span, what a context word adds, and the words, in lower case.
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7}
CONTEXT_BONUS, CONTEXT_CHARS = 0.3, 48
CONTEXT = {
    "email": ("mail", "contact", "correo", "kontakt"),
    "ip": ("ip", "server", "host", "address", "adresse"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "llama"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
BLOCK = 256


def luhn(digits: Column) -> Column:
    """True if the digit text passes the Luhn sum."""
    def add(total, i):
        digit = F.substr(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)) \
            .otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number (letters and digits) has remainder 1."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))

    def add(rest, i):
        sign = F.substr(turned, i, F.lit(1))
        code = F.ascii(sign)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise(
            (rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, hit: Column, alone: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        plain = F.replace(hit, F.lit(" "))
        return alone & F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def find(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array ``into`` of (kind, start, end, score, hit): by kind, then start."""
    name = {k: fresh(docs, f"_pii_{k}") for k in ("text", *KINDS)}
    body = F.col(name["text"])
    out = docs.withColumn(name["text"], F.coalesce(F.col(text), F.lit("")))
    part = lambda kind, what: fresh(docs, f"_pii_{kind}_{what}")
    col = lambda kind, what: F.col(part(kind, what))
    # Each step is a column that later steps name more than once, so it is computed once a row.
    out = out.withColumns({part(k, "hits"): F.regexp_extract_all(body, F.lit(p), F.lit(0))
                           for k, p in EXPRESSIONS.items()})
    out = out.withColumns({part(k, "gaps"): F.when(
        F.size(col(k, "hits")) > 0, F.split(body, p, -1)).otherwise(F.array().cast("array<string>"))
        for k, p in EXPRESSIONS.items()})
    out = out.withColumns({part(k, "steps"): F.zip_with(
        F.slice(col(k, "gaps"), F.lit(1), F.size(col(k, "hits"))), col(k, "hits"),
        lambda gap, hit: F.length(gap) + F.length(hit)) for k in KINDS})
    # Sums of whole blocks keep the running position cheap in texts with very many matches.
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, b: a + b)

    def blocks(steps):
        return F.when(F.size(steps) > 0, F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
            lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))))

    out = out.withColumns({part(k, "blocks"): blocks(col(k, "steps")) for k in KINDS})

    def spans(kind):
        hits, gaps, steps = col(kind, "hits"), col(kind, "gaps"), col(kind, "steps")

        def one(hit, i):
            full = F.floor(i / BLOCK).cast("int")
            gap = F.get(gaps, i)
            start = (total(F.slice(col(kind, "blocks"), F.lit(1), full))
                     + total(F.slice(steps, full * BLOCK + 1, i - full * BLOCK)) + F.length(gap))
            near = F.lower(F.right(gap, F.lit(CONTEXT_CHARS)))
            known = F.lit(False)
            for word in CONTEXT[kind]:
                known = known | F.contains(near, F.lit(word))
            return F.struct(
                F.lit(kind).alias("kind"), start.cast("bigint").alias("start"),
                (start + F.length(hit)).cast("bigint").alias("end"),
                F.round(F.lit(SCORES[kind]) + F.when(known, CONTEXT_BONUS).otherwise(0.0), 2)
                .alias("score"), hit.alias("hit"),
                # no letter or digit touches the span
                (~F.right(gap, F.lit(1)).rlike("[A-Za-z0-9]")
                 & ~F.left(F.get(gaps, i + 1), F.lit(1)).rlike("[A-Za-z0-9]")).alias("alone"))

        checked = F.transform(
            F.filter(F.transform(hits, one), lambda s: _valid(kind, s["hit"], s["alone"])),
            lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "start", "end", "score", "hit")]))
        # (naming the blocks here too keeps them a column of their own, out of the lambda)
        return F.when((F.size(hits) > 0) & (F.size(col(kind, "blocks")) > 0), checked).otherwise(F.array().cast(
            "array<struct<kind:string,start:bigint,end:bigint,score:double,hit:string>>"))

    return out.withColumn(into, F.concat(*[spans(k) for k in KINDS])).select(*docs.columns, into)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every confirmed span of ``text`` replaced by its kind in brackets.

    Cut by start and end, so equal text elsewhere stays. Where spans overlap, what they cover together
    is replaced once, by the kind of the first.
    """
    spans, cuts = fresh(docs, "_pii_spans"), fresh(docs, "_pii_cuts")
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def merge(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
                          last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    whole = F.col(text)
    after = lambda i: F.coalesce(F.get(F.col(cuts), i - 1)["end"], F.lit(0))
    parts = F.transform(cuts, lambda c, i: F.concat(
        F.substr(whole, (after(i) + 1).cast("int"), (c["start"] - after(i)).cast("int")),
        F.lit("["), c["kind"], F.lit("]")))
    rest = F.substr(whole, (F.element_at(F.col(cuts), -1)["end"] + 1).cast("int"))
    hidden = F.when(F.size(cuts) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(whole)
    return find(docs, text, spans).withColumn(cuts, F.aggregate(sorted_, empty, merge)).withColumn(
        text, hidden).select(*docs.columns)


def digest(found: DataFrame, id_col: str = "doc_id", spans: str = "spans") -> DataFrame:
    """Counts and span texts of ``find``'s rows."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"] != "iban")
    return found.select(
        id_col, *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, line), ",").alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"))
