import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""
    def make(rows, extra=None):
        full = []
        for row in rows:
            id_, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else (*row, "s")[:4]
            full.append((id_, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS)
        if extra:  # columns whose names an operator might use itself
            from pyspark.sql import functions as F
            for name in extra:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


CLASHES = ("shard", "_id", "_group", "_key", "id", "fp", "spans", "verdict", "size", "_mix_key",
           "taken", "hit", "a", "b", "part", "edge", "item")
