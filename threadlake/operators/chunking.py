"""Documents to overlapping chunks, built-in functions only.

Paragraphs are packed into a buffer by a fold over the paragraph array. Lengths count code
points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.constants import CHUNK_CHARS, OVERLAP_CHARS
from threadlake.functions.scalar import page_for_offset, wide_trim
from threadlake.session import spread

_PIECES = "array<struct<text:string,start:int>>"
_STRIDE = CHUNK_CHARS - OVERLAP_CHARS


def _flush(buffer: Column, start: Column) -> Column:
    return F.array(F.struct(wide_trim(buffer).alias("text"), start.alias("start")))


def _hard_split(paragraph: Column, start: Column) -> Column:
    """Pieces of an oversized paragraph: fixed stride, last one reaches the end."""
    last = F.ceil((F.length(paragraph) - CHUNK_CHARS) / F.lit(_STRIDE)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        wide_trim(F.substring(paragraph, i * _STRIDE + 1, F.lit(CHUNK_CHARS))).alias("text"),
        (start + i * _STRIDE).alias("start")))


def _step(state: Column, item: Column) -> Column:
    paragraph, buffer = item["p"], state["buffer"]
    size, held = F.length(paragraph), F.length(buffer)
    start = state["cursor"] + item["gap"]
    end = start + size
    oversized = size > CHUNK_CHARS
    overflow = held + size + 2 > CHUNK_CHARS
    flushed = F.concat(state["out"], _flush(buffer, state["start"]))
    return F.struct(
        F.when(oversized, F.lit(""))
        .when(overflow, F.concat(F.right(buffer, F.lit(OVERLAP_CHARS)), F.lit("\n\n"),
                                 paragraph))
        .when(held > 0, F.concat(buffer, F.lit("\n\n"), paragraph))
        .otherwise(paragraph).alias("buffer"),
        F.when(oversized, end)
        .when(overflow, F.greatest(F.lit(0), start - OVERLAP_CHARS))
        .when(held > 0, state["start"]).otherwise(start).alias("start"),
        end.alias("cursor"),
        F.when(oversized, F.concat(flushed, _hard_split(paragraph, start)))
        .when(overflow, flushed).otherwise(state["out"]).alias("out"))


def clean_text(text: Column) -> Column:
    return wide_trim(F.replace(text, F.lit("\r\n"), F.lit("\n")))


def chunk_array(clean: Column) -> Column:
    """Ordered non-empty chunks of a clean text as ``array<struct<text, start>>``."""
    single = F.when(F.length(clean) > CHUNK_CHARS, _hard_split(clean, F.lit(0))).otherwise(
        _flush(clean, F.lit(0)))
    gaps = F.concat(F.array(F.lit(0)), F.transform(
        F.regexp_extract_all(clean, F.lit("(\n{2,})"), F.lit(1)), F.length))
    items = F.zip_with(F.split(clean, "\n{2,}"), gaps,
                       lambda p, g: F.struct(p.alias("p"), g.alias("gap")))
    zero = F.struct(F.lit("").alias("buffer"), F.lit(0).alias("start"),
                    F.lit(0).alias("cursor"), F.array().cast(_PIECES).alias("out"))
    packed = F.aggregate(items, zero, _step, lambda s: F.concat(
        s["out"], _flush(s["buffer"], s["start"])))
    # a text of one paragraph needs no fold
    return F.filter(F.when(clean.contains("\n\n"), packed).otherwise(single),
                    lambda c: F.length(c["text"]) > 0)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """One row per chunk: its index in the document, text and page. Other columns stay."""
    rest = [c for c in docs.columns if c not in ("text", "page_offsets")]
    cleaned = spread(docs).withColumn("text", clean_text(F.col("text")))
    exploded = cleaned.select(*rest, "page_offsets", F.posexplode(chunk_array(F.col("text")))
                              .alias("chunk_index", "_chunk"))
    return exploded.select(
        *rest, "chunk_index", F.col("_chunk.text").alias("text"),
        page_for_offset(F.col("_chunk.start"), F.col("page_offsets")).alias("page"))
