"""Small tables with awkward rows, shared by the tests."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
SF = "/root/testdata/sf0.001"


def documents(spark, texts, langs=None, sources=None, ids=None):
    """A documents table; ids count from 0 unless given."""
    rows = []
    for i, text in enumerate(texts):
        rows.append((i if ids is None else ids[i], text, (langs or {}).get(i), None if sources is None else sources[i], len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """The table with further columns named like what operators make."""
    from pyspark.sql import functions as F

    names = ["id", "body", "kept", "component_id", "label", "digest", "spans", "items", "size", "target", "start", "n", "key", "base", "mentions", "sentences", "_label", "_found", "_spans", "_id", "_key", "row", "found", "digest_"]
    return docs.withColumns({name: F.lit("clash") for name in names})
