import random
import re

import pytest

import rows as R
from chartspark.llm import decontaminate

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(texts, items, size=10):
    wanted = {}
    for name, text in items:
        own = words(text)
        k = min(size, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            wanted.setdefault(tuple(own[i : i + k]), set()).add(name or "")
    out = []
    for text in texts:
        own, hit, names = words(text), set(), set()
        for run, who in wanted.items():
            for i in range(len(own) - len(run) + 1):
                if tuple(own[i : i + len(run)]) == run:
                    hit.update(range(i, i + len(run)))
                    names |= who
        out.append((len(own), len(hit), sorted(names)))
    return out


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé1") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    long, short, twin = line(25), line(6), line(14)
    items = [("a", long), ("b", short), ("c", twin), ("c", twin), ("d", twin.upper() + " " + line(3)), (None, "lone"), ("e", None), ("f", " -- "), ("g", "")]
    shout = " ... ".join(long.upper().split()[5:20])
    texts = [None, "", "---", line(30), line(5) + " " + long + ". " + line(4), f"{line(3)}, {shout}", line(2) + "-" + short, short[:-1], twin, "x lone! LONE", "漢字 é " + " ".join(long.split()[:9]), long + " " + long, line(2000) + " " + short]
    return texts, items


def rows_of(found):
    return [(r.n_words, r.n_hit, r["items"]) for r in found.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(fixture()[1], "item_id string, text string")


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])  # one block, and several passes
def test_hits_against_all_windows(spark, benchmark, block_bytes):
    texts, items = fixture()
    docs = R.clashing(R.documents(spark, texts))
    found = decontaminate.find(docs, benchmark, block_bytes=block_bytes)
    assert rows_of(found) == brute(texts, items)
    for r, text in zip(found.orderBy("doc_id").collect(), texts):
        assert len(words(" ".join((text or "")[s.start : s.end] for s in r.spans))) == r.n_hit


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_removal(spark, benchmark, block_bytes):
    texts, items = fixture()
    docs = R.clashing(R.documents(spark, texts))
    clean = [i for i, (_, hit, _) in enumerate(brute(texts, items)) if not hit]
    left = decontaminate.remove(docs, benchmark, block_bytes=block_bytes)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == clean
    cut = decontaminate.remove(docs, benchmark, "spans", block_bytes=block_bytes).orderBy("doc_id").collect()
    for r, text, (n, hit, _) in zip(cut, texts, brute(texts, items)):
        assert (r.text == text) == (not hit) and len(words(r.text)) == n - hit or text == "漢字"


def test_repeated_rows_null_ids_and_empty_tables(spark, benchmark):
    docs = R.documents(spark, ["x lone"] * 3, ids=[None, 1, 1])
    assert rows_of(decontaminate.find(docs, benchmark)) == [(2, 1, [""])] * 3
    assert rows_of(decontaminate.find(docs, benchmark, block_bytes=40)) == [(2, 1, [""])] * 3
    assert decontaminate.find(docs.limit(0), benchmark).collect() == []
    assert rows_of(decontaminate.find(docs, benchmark.limit(0))) == [(2, 0, [])] * 3


def test_numeric_item_ids_sort_as_strings(spark):
    items = spark.createDataFrame([(10, "p q"), (9, "q r")], "item_id long, text string")
    assert rows_of(decontaminate.find(R.documents(spark, ["p q r"]), items)) == [(3, 3, ["10", "9"])]
