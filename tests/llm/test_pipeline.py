"""The five stages against ordinary code, each on what its predecessor kept."""

import itertools

import rows as R
from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_mixing import brute as mixed
from test_near_dedup import brute as components
from test_token_files import expected as tokens
from test_token_files import plain  # noqa: F401  (a fixture)

import corpus_pipeline
from chartspark.llm import mixing


def test_stages(spark, plain, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{R.SF}/documents.parquet")
    extra = R.documents(spark, ["12345 !!", None, "", docs.first().text], ids=[90001, 90002, 90003, 90004], sources=["src0"] * 4)
    docs = docs.unionByName(extra)
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)

    def step(number):
        nonlocal docs
        name, stage = corpus_pipeline.STAGES[number]
        stage(spark, docs, R.SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        return docs.collect()

    assert [n for n, _ in corpus_pipeline.STAGES] == list(steps)
    rows = step(0)
    assert docs.columns == columns and {r.doc_id for r in rows} == set(kept) - {90001, 90002, 90003}
    texts = {r.doc_id: r.text for r in rows}
    rows = step(1)
    assert docs.columns == columns and {r.doc_id for r in rows} == {i for i, _, c in components(texts) if i == c}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{R.SF}/benchmark.parquet").collect()]
    found = contaminated([r.text for r in rows], items)
    clean = {r.doc_id for r, (_, hit, _) in zip(rows, found) if not hit}
    rows = step(2)
    assert docs.columns == columns and {r.doc_id for r in rows} == clean and len(rows) == len(clean)
    plan = mixed([r.doc_id for r in rows], [r.text for r in rows], [r.source for r in rows])
    texts = {r.doc_id: r.text for r in rows}
    rows = step(3)
    wanted = [(i, texts[i]) for i, size, _, _, taken in plan if size for _ in range(taken // size)]
    assert docs.columns == columns and sorted((r.doc_id, r.text) for r in rows) == sorted(wanted)
    # tokens stand in the order of the mix's rows, which its files keep
    order = [r.doc_id for r in docs.select("doc_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]
    found = sorted(step(4), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted((i, n, crc) for i, _, n, crc in tokens(plain, wanted))
    assert [r.doc_id for r in found] == order
    assert [r.start for r in found] == [0, *itertools.accumulate(r.n_tokens for r in found)][:-1]


def test_empty_table(spark, tmp_path):
    docs = R.documents(spark, [])
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, R.SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.collect() == []


def test_tokens_stand_in_the_order_of_the_mix(spark, tmp_path):
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{R.SF}/documents.parquet")
    wanted = [r.doc_id for r in mixing.mix(docs).collect()]
    steps["mixing sources to target weights"](spark, docs, R.SF).write.parquet(str(tmp_path / "mix"))
    found = steps["token-ID / binary output"](spark, spark.read.parquet(str(tmp_path / "mix")), R.SF)
    order = [r.doc_id for r in found.orderBy("start").collect()]
    assert order == wanted and order != sorted(order)
