import hashlib
from collections import defaultdict

import pytest

import rows as R
from chartspark.llm import exact_dedup
from pyspark.sql import functions as F

TEXTS = ["a", "b", "a", None, "", "A", "a", "x" * 300_000, "x" * 300_000, "é", "b "]


def expected(ids, texts):
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[t or ""].append(i)
    known = lambda own: [i for i in own if i is not None]
    return sorted(((i, max(known(groups[t or ""]), default=None), len(groups[t or ""])) for i, t in zip(ids, texts)), key=str)


def rows_of(found):
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    def write(texts, ids=None, files=3):
        path = str(tmp_path / f"docs{len(list(tmp_path.iterdir()))}.parquet")
        R.clashing(R.documents(spark, texts, ids=ids)).repartition(files).write.parquet(path)
        return path

    return write


def test_groups_keep_the_largest_id(spark, folder):
    found = exact_dedup.groups(spark, folder(TEXTS), files_per_batch=1).collect()
    assert rows_of(found) == expected(range(len(TEXTS)), TEXTS)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)
    assert {r.doc_id: r.digest for r in found}[3] == hashlib.sha256(b"").hexdigest()


def test_repeated_rows_and_null_ids_keep_one_row(spark, folder):
    texts, ids = ["a", "a", "a", "b", "b", "c"], [1, 1, None, None, None, None]
    found = exact_dedup.groups(spark, folder(texts, ids, files=2)).collect()
    assert rows_of(found) == expected(ids, texts)
    assert sorted(r.group_size for r in found if r.kept) == [1, 2, 3]


def test_weak_digest_is_settled_by_the_bytes(spark, folder):
    weak = lambda text: F.substring(exact_dedup.sha256(text), 1, 1)
    texts = [f"text {i % 40}" for i in range(100)]
    found = exact_dedup.groups(spark, folder(texts), digest=weak).collect()
    assert rows_of(found) == expected(range(100), texts)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_state_goes_on_in_a_later_run(spark, folder, tmp_path):
    path, state = folder(["a", "b"]), str(tmp_path / "state")
    schema = spark.read.parquet(path).schema
    first = {r.keep.doc_id: r.n for r in exact_dedup.update_state(spark, path, schema, state).collect()}
    assert first == {0: 1, 1: 1}
    R.clashing(R.documents(spark, ["b", "c"], ids=[7, 8])).write.mode("append").parquet(path)
    later = {r.keep.doc_id: r.n for r in exact_dedup.update_state(spark, path, schema, state).collect()}
    assert later == {0: 1, 7: 2, 8: 1}


def test_empty_table(spark, folder):
    assert exact_dedup.groups(spark, folder([], files=1)).collect() == []
