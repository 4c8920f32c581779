import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

import rows as R
from chartspark.llm import book, mixing


def sizes(texts):
    return [len((t or "").encode().split()) for t in texts]


def levels(by_source, weights=(3, 1, 2), budget=1.5):
    """Targets by dealing out what stands above the stops until nothing does."""
    names = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_ones, target = budget * sum(by_source.values()), set(names), {}
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if 2 * by_source[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_ones}
        target |= {s: 2.0 * by_source[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ones -= full
    return target


def brute(ids, texts, sources):
    n, order, totals = sizes(texts), defaultdict(list), Counter()
    for k, s in enumerate(sources):
        totals[s] += n[k]
        key = str(ids[k]) if ids[k] is not None else (texts[k] or "")
        order[s].append((hashlib.md5(key.encode()).hexdigest(), n[k], k))
    target, out = levels(totals), [None] * len(ids)
    for s, own in order.items():
        before = 0
        for _, size, k in sorted(own):
            times = max(0, min(2, math.ceil((target[s] - before - size / 2) / totals[s]))) if totals[s] else 0
            out[k] = (ids[k], size, totals[s], round(target[s], 6), size * times)
            before += size
    return sorted(out, key=str)


def planned(docs, **options):
    return sorted(((r.doc_id, r._mix_size, r._mix_source_size, round(r._mix_target, 6), r._mix_size * r._mix_times) for r in mixing.plan(docs, **options).collect()), key=str)


def fixture():
    texts = [f"w{i} " * (1 + i * 7 % 23) for i in range(120)] + [None, "", " \n", "x " * 5000, "é\u00a0y z"]
    sources = [("big", "b", "Ä", None, "c", "big", "big")[i % 7] for i in range(len(texts))]
    return list(range(len(texts))), texts, sources


def test_plan_against_ordinary_code(spark):
    ids, texts, sources = fixture()
    docs = R.clashing(R.documents(spark, texts, sources=sources))
    assert planned(docs) == planned(docs, pieces=50) == brute(ids, texts, sources)


def test_taken_comes_near_the_target_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.plan(docs).select("source", "doc_id", "_mix_size", "_mix_times", "_mix_target", "_mix_source_size").collect()
    taken, most = Counter(), Counter()
    for r in rows:
        taken[r.source] += r._mix_size * r._mix_times
        most[r.source] = max(most[r.source], r._mix_size)
        assert r._mix_times <= 2
    for r in rows:
        assert abs(taken[r.source] - r._mix_target) <= most[r.source] / 2
    again = mixing.plan(docs.repartition(13)).select("doc_id", "_mix_times").collect()
    assert sorted((r.doc_id, r._mix_times) for r in rows) == sorted(map(tuple, again))


def test_due_time_inverts_the_integral(spark):
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0))):
        area = lambda t: sum((min(t, t1) - t0) * (2 * w0 + (w1 - w0) / (t1 - t0) * (min(t, t1) - t0)) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]) if t > t0)
        parts = [i / 40 for i in range(41)]
        df = spark.createDataFrame([(p,) for p in parts], "p double")
        for p, t in df.select("p", mixing.due_time(df.p, schedule)).collect():
            assert 0 <= t <= 1 and area(t) == pytest.approx(p * area(1.0), abs=1e-9)
    with pytest.raises(ValueError):
        mixing.due_time(df.p, ((0.0, 0.0), (1.0, 0.0)))


def test_order_follows_the_schedules(spark):
    n = 300
    docs = R.documents(spark, ["w " * 10] * (3 * n), sources=[("a", "b", "c")[i % 3] for i in range(3 * n)])
    mixed = mixing.mix(docs, shards=3, keep_position=True)
    assert mixed.columns == [*docs.columns, "_mix_position"]
    rows = mixed.collect()
    assert [r._mix_position for r in rows] == sorted(r._mix_position for r in rows)
    early, late = Counter(r.source for r in rows if r._mix_position < 0.5), Counter(r.source for r in rows if r._mix_position >= 0.5)
    assert abs(early["a"] - late["a"]) < 0.05 * n and late["b"] > 1.4 * early["b"] and early["c"] > 1.4 * late["c"]


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = R.clashing(R.documents(spark, ["a b", "a b", "c", "d e f", None], ids=[1, 1, None, None, None], sources=["s"] * 5))
    assert sorted(str(r.doc_id) for r in mixing.plan(docs).collect()) == ["1", "1", "None", "None", "None"]
    assert mixing.plan(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []
    blank = R.documents(spark, [None, ""], sources=[None, "s"])
    assert [r._mix_times for r in mixing.plan(blank).collect()] == [0, 0] and mixing.mix(blank).collect() == []


def test_query_rows_come_from_the_written_mix_in_training_order(spark):
    docs = spark.read.parquet(f"{R.SF}/documents.parquet")
    taken, starts = Counter(), {}
    for r in mixing.mix(docs, keep_position=True).collect():
        taken[r.doc_id] += sizes([r.text])[0]
        starts.setdefault(r.doc_id, r._mix_position)
    rows = book.op9_curriculum_mix(spark, R.SF).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: taken[r.doc_id] for r in rows} and len(rows) == docs.count()
    order = [starts.get(r.doc_id, 2.0) for r in rows]
    assert order == sorted(order) and len(set(order)) > 10


def test_dealt_against_ordinary_code_and_by_schedule(spark):
    ids, texts, sources = fixture()
    docs = R.documents(spark, texts, sources=sources)
    found = mixing.dealt(docs).collect()
    assert sorted(((r.doc_id, r._mix_size, r._mix_source_size, round(r._mix_target, 6), r._mix_taken) for r in found), key=str) == brute(ids, texts, sources)
    other = mixing.dealt(docs, schedules=mixing.SCHEDULES[::-1]).collect()
    assert [r.doc_id for r in found] != [r.doc_id for r in other] and {r.doc_id: r._mix_taken for r in found} == {r.doc_id: r._mix_taken for r in other}
    same = ([1, 1, None, None, 7], ["a b", "a b", "", "", "d e f"], ["s", "s", "s", "s", None])
    found = mixing.dealt(R.documents(spark, same[1], ids=same[0], sources=same[2]))
    assert sorted(((r.doc_id, r._mix_size, r._mix_source_size, round(r._mix_target, 6), r._mix_taken) for r in found.collect()), key=str) == brute(*same)


def test_whole_documents_are_sorted_by_position(spark):
    text = book.op9_curriculum_mix(spark, R.SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Sort \[_mix_position.*, _mix_order.*\], false", text) and re.search(r"RepartitionByExpression \[_mix_position", text)
