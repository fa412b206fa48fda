"""Secret scans: keyword automaton, anchored expressions near its hits, embedded checksums.

A text is read once. An Aho-Corasick automaton finds the words that can begin a secret; only at its
hits an anchored expression is tried. Hexadecimal keys have no word to begin with: their prefilter
is the run itself, searched as 32 equal symbols after mapping every digit to one symbol. Tokens that
carry a checksum (six base-62 digits of the CRC-32 of what comes before) are kept only if it holds.

Matches are those of a scan from left to right without overlaps inside a kind: hits are visited in
order, and a hit inside the previous match of its kind is passed over.

Texts are scanned as one byte per code point (code points above 255 become a byte that no
expression accepts), so positions are code points at once and memory stays near the text's size.

Cases. Null or empty text: no spans. Repeated rows: scanned each by itself. Null ids: kept. Empty
table: no rows. Extra columns: ignored by ``scan``, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in listed order, what begins them, and their expressions.
KINDS = ("assign", "access", "hex", "checked")
WORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "checked": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
}
ASSIGN = (rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          rb"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = rb"AKIA[A-Z0-9]+"
CHECKED = rb"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
HEX = b"0123456789abcdef"
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32


def checksum(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of ``body``."""
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit:digit + 1] + out
    return out


class Scanner:
    """The automaton and the expressions; built once per task."""

    def __init__(self) -> None:
        self.words = ahocorasick.Automaton()
        for kind, words in WORDS.items():
            for word in words:
                self.words.add_word(word, (kind, len(word)))
        self.words.make_automaton()
        self.forms = {k: re.compile(p) for k, p in
                      (("assign", ASSIGN), ("access", ACCESS), ("checked", CHECKED))}
        self.digits = bytes(35 if b in HEX else 32 for b in range(256))

    def _keep(self, kind: str, match: re.Match) -> bool:
        if kind == "assign":
            return match.end(1) - match.start(1) >= MIN_ASSIGN
        if kind == "access":
            return match.end() - match.start() >= MIN_ACCESS
        return checksum(match[1]) == match[2]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, kind number, end) of every secret, sorted."""
        if not text:
            return []
        flat = text.encode("latin-1", "replace")
        found, past = [], dict.fromkeys(self.forms, 0)
        for end, (kind, size) in self.words.iter(flat.lower().decode("latin-1")):
            start = end + 1 - size
            if start < past[kind]:
                continue
            match = self.forms[kind].match(flat, start)
            if match:
                past[kind] = match.end()
                if self._keep(kind, match):
                    found.append((start, KINDS.index(kind), match.end()))
        runs, needle, at = flat.translate(self.digits), b"#" * MIN_HEX, 0
        while (at := runs.find(needle, at)) >= 0:
            end = runs.find(b" ", at)
            end = len(runs) if end < 0 else end
            found.append((at, KINDS.index("hex"), end))
            at = end
        return sorted(found)



def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        every = [scanner.spans(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_pydict({
            "id": batch.column(0),
            "spans": pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
                               for spans in every],
                              pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                  ("end", pa.int64())]))),
        })


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id, spans`` for every row; spans are (kind, start, end) by start, then kind as listed."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(
        _scan, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    ).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark`` (overlapping spans as one)."""
    def run(batches):
        scanner = Scanner()
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for value in batch.column(at).to_pylist():
                spans = scanner.spans(value)
                if spans:
                    parts, end = [], 0
                    for s, _, e in spans:
                        if s >= end:
                            parts += [value[end:s], mark]
                        end = max(end, e)
                    value = "".join([*parts, value[end:]])
                out.append(value)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and span texts of ``scan``'s rows."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scanned.select(
        *[c for c in scanned.columns if c != "spans"],
        of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        of("checked").alias("n_checked"),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"))
