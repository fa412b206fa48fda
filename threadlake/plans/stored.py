"""The searchable corpus as the ingestion leaves it: points, chunks and the inverted index.

Searches read these tables. Each is built when a search first reads it, once per application and data
folder, in the shared folder, from the whole tables: the rows are those that the ingest streams keep.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from threadlake.operators.chunking import chunk_documents
from threadlake.plans import bindings as b
from threadlake.plans import search
from threadlake.session import materialize, scratch_path
from threadlake.sources.postings import PostingTable


class Corpus:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    @cached_property
    def message_points(self) -> DataFrame:
        """Knowledge messages with vectors."""
        return materialize(search.message_points(
            b.texts(self.spark, self.sf), b.rooms(self.spark, self.sf)), "message_points")

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunks of all documents."""
        return materialize(chunk_documents(b.docs(self.spark, self.sf)), "chunks")

    @cached_property
    def chunk_points(self) -> DataFrame:
        """Chunks of memory-enabled rooms with vectors."""
        return materialize(search.chunk_points(self.chunks, b.rooms(self.spark, self.sf)), "chunk_points")

    @cached_property
    def index(self) -> PostingTable:
        """Index of the knowledge messages."""
        index = PostingTable(self.spark, scratch_path(self.spark, "index"))
        index.add(search.message_corpus(
            b.texts(self.spark, self.sf), b.rooms(self.spark, self.sf)), 0)
        return index


_BUILT: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        _BUILT[key] = Corpus(spark, sf)
    return _BUILT[key]
