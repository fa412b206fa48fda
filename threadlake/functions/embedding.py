"""Deterministic text embedding as an Arrow UDF.

A text's vector is the normalised sum of one pseudo-random vector per token, seeded by the
token's hash. Equal texts get equal vectors and texts that share words lie closer. The
generator adds a constant per step, so value i is a closed form of (seed, i) and whole
matrices are computed at once. It stands where a model call would stand, which is why it is
the one Python function of the retrieval jobs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.constants import EMBED_DIMS, EMBED_STEP
from threadlake.functions.scalar import tokenize

# Tokens embedded together; bounds a task's memory whatever the text lengths and the batches are.
_TOKENS_AT_ONCE = 32_768


def token_vectors(tokens: list[str], dims: int) -> np.ndarray:
    seeds = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little")
                      for t in tokens], dtype=np.uint32)
    steps = np.arange(1, dims + 1, dtype=np.uint32) * np.uint32(EMBED_STEP)
    a = seeds[:, None] + steps[None, :]
    x = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    x ^= x + (x ^ (x >> np.uint32(7))) * (x | np.uint32(61))
    x ^= x >> np.uint32(14)
    return x / 2.0**31 - 1.0


def embed_rows(token_lists: list, texts: list, dims: int) -> list:
    """Unit vectors for rows of tokens; a text without tokens counts as one token."""
    out: list = [None] * len(texts)
    start = 0
    while start < len(texts):
        stop, load = start, 0
        vocab: dict[str, int] = {}
        ids: list[np.ndarray | None] = []
        while stop < len(texts) and (load < _TOKENS_AT_ONCE or stop == start):
            if texts[stop] is None:
                ids.append(None)
            else:
                parts = token_lists[stop] if len(token_lists[stop]) else [texts[stop]]
                ids.append(np.fromiter((vocab.setdefault(t, len(vocab)) for t in parts),
                                       dtype=np.int64, count=len(parts)))
                load += len(parts)
            stop += 1
        vectors = token_vectors(list(vocab), dims) if vocab else None
        for offset, row in enumerate(ids):
            if row is None:
                continue
            known, counts = np.unique(row, return_counts=True)
            total = counts @ vectors[known]
            norm = float(np.sqrt(total @ total)) or 1.0
            out[start + offset] = total / norm
        start = stop
    return out


def embed_arrays(tokens: pa.Array, texts: pa.Array, dims: int) -> pa.Array:
    """``embed_rows`` of Arrow columns; a slice of ``_TOKENS_AT_ONCE`` at a time becomes Python objects."""
    kind = pa.list_(pa.float64())
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out, start = [pa.array([], kind)], 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        size = max(1, int(np.searchsorted(ends, before + _TOKENS_AT_ONCE, "right")) - start)
        words = tokens.slice(start, size).flatten().to_numpy(zero_copy_only=False)
        lists = np.split(words, np.cumsum(sizes[start:start + size])[:-1])
        out.append(pa.array(embed_rows(lists, texts.slice(start, size).to_pylist(), dims), kind))
        start += size
    return pa.concat_arrays(out)


def embed(text: Column, dims: int = EMBED_DIMS) -> Column:
    @F.arrow_udf("array<double>")
    def run(tokens: pa.Array, texts: pa.Array) -> pa.Array:
        return embed_arrays(tokens, texts, dims)

    return run(tokenize(text), text)
