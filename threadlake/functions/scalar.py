"""Scalar expressions: JSON, dates, text, keys, hashes, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.constants import (
    COMMAND_PREFIX, NEAR_DUP_CHARS, SNIPPET_CHARS, WIDE_SPACE, WIDE_SPACE_CHARS,
)


def json_array_len(text: Column) -> Column:
    """Length of a JSON array given as text; anything else counts 0.

    The built-in parser stops after the first value and would accept ``[1] x``. Wrapped in an
    outer array such text no longer parses, and a lone array has outer length 1.
    """
    wrapped = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.when(wrapped == 1, F.json_array_length(text)), F.lit(0))


def word_count(body: Column) -> Column:
    return F.size(F.split(F.trim(body), r"\s+"))


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def date_key(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("bigint")


def wide_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WIDE_SPACE_CHARS))


def normalize_text(text: Column) -> Column:
    """Key under which two sources count as the same text."""
    flat = F.regexp_replace(F.lower(text), f"[{WIDE_SPACE}]+", " ")
    return F.substring(F.trim(flat), 1, NEAR_DUP_CHARS)


def is_command(body: Column) -> Column:
    return body.startswith(COMMAND_PREFIX)


def point_id(key: Column) -> Column:
    return F.regexp_replace(
        F.md5(key), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def message_key(message_id: Column) -> Column:
    return F.concat(F.lit("message:"), message_id.cast("string"))


def doc_key(doc_id: Column, chunk: Column) -> Column:
    return F.concat_ws(":", F.lit("doc"), doc_id.cast("string"), chunk.cast("string"))


def permission_fingerprint(room_ids: Column, scope: str) -> Column:
    """``room_ids`` is an array of strings; the order of its elements does not matter."""
    material = F.concat(F.lit(f"{scope}|"), F.array_join(F.array_sort(room_ids), ","))
    return F.substring(F.sha2(material, 256), 1, 32)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def tokenize(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs longer than one character."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def slug_base(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 32)
    return F.when(cut == "", F.lit("room")).otherwise(cut)


def citation_markers(answer: Column, count: Column) -> Column:
    """Distinct source numbers cited as [n], in 1..count, ascending."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)),
                        lambda d: d.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= count))))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET_CHARS)


def header_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with a UTC offset, microseconds kept (session zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def page_for_offset(offset: Column, page_offsets: Column) -> Column:
    """Last page whose first character is at or before ``offset``; page 1 otherwise."""
    reached = F.size(F.filter(page_offsets, lambda p: p <= offset))
    return F.greatest(F.coalesce(reached, F.lit(1)), F.lit(1))


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: Column,
             price_out: Column) -> Column:
    """Exact decimal cost; prices are USD per million tokens."""
    zero = F.lit("0").cast("decimal(12,6)")
    return (tokens_in.cast("decimal(18,0)") * F.coalesce(price_in, zero)
            + tokens_out.cast("decimal(18,0)") * F.coalesce(price_out, zero))


def ratio_1dp(numerator: Column, denominator: Column) -> Column:
    """numerator/denominator rounded half up to one decimal, in integers (both >= 0)."""
    n, d = numerator.cast("bigint"), denominator.cast("bigint")
    n, d = n * 20, F.nullif(d, F.lit(0).cast("bigint"))
    return F.call_function("div", n + d, d * 2).cast("double") / 10


def dot_product(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
