"""Words of lines are looked up once a block, and lines meet the weights of their block."""

import pyarrow as pa
from pyspark.sql import functions as F

from chartspark.operators import detector


def test_a_block_asks_once_for_a_word():
    batches = [pa.record_batch([pa.array([1, 1, 2]), pa.array(["a b a", "b", "a"])], names=["asker", "words"]), pa.record_batch([pa.array([2]), pa.array(["a c"])], names=["asker", "words"])]
    got = [r for b in detector._asked_words(iter(batches)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(got) == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]


def test_word_rows_do_not_grow_with_occurrences(spark):
    text = "\n".join(["the long night and the long road and the long day"] * 50)
    df = spark.createDataFrame([(i, text, "en") for i in range(4)] + [(9, "la noche larga y el camino largo", "es"), (10, "zzz qqq xxx www vvv kkk", None)], "k int, t string, l string")
    weights, names = detector.word_weights(df, "t", "l"), detector.languages_of(df, "l")
    out = detector.line_languages(df, "k", "t", weights, names)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row for each word of a line
    got = {r["k"]: r["n"] for r in out.where("line_language = 'en'").groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {i: 50 for i in range(4)}
    assert [r["line_language"] for r in out.where("k >= 9").orderBy("k").collect()] == ["es", None]
