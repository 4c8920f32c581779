import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartspark.functions import clean, score
from chartspark.operators import chart, frames, integrate, quality
from chartspark.sources import pages, readers, sinks
from chartspark.streaming import ingest

TOTALS = """<table><tr><th>Artist and Title</th></tr>
<tr><td><a href="/artist/9">Ann</a> - <a href="../track/AbC1.html">Blue &amp; Sky</a></td><td>12</td><td>--</td><td>1</td><td>(x2)</td><td>1,234</td><td>99,000</td></tr>
<tr><td><a href="/x">no track</a></td><td>1</td><td>1</td><td>1</td><td>1</td><td>1</td></tr><tr><td>short</td></tr></table>"""
WEEKLY = """<table><tr><th>Date</th><th>US</th></tr><tr><td>2024/01/02</td><td>1 (5)</td></tr><tr><td>2024/01/01</td><td>2 (4)</td></tr></table>
<table><tr><th>Date</th><th>US</th><th>XX</th><th>KR</th></tr><tr><td>2024/01/11</td><td>3 (1,500)</td><td>1 (1)</td><td>--</td></tr>
<tr><td>2024/01/04</td><td>--</td><td></td><td>7 (20)</td></tr><tr><td>2020/01/02</td><td>1 (1)</td><td></td><td></td></tr></table>"""


def test_totals_page(spark):
    cells = pages.table_cells(spark.createDataFrame([(1, TOTALS)], "id int, html string"), "id", "html")
    rows = pages.totals_rows(cells, "id").collect()
    assert [tuple(r) for r in rows] == [(1, "AbC1", "Blue & Sky", "Ann", 12, None, 1, 1234, 99000)]


def test_weekly_page_takes_the_weekly_table(spark):
    cells = pages.table_cells(spark.createDataFrame([("t", WEEKLY)], "id string, html string"), "id", "html")
    rows = {tuple(r) for r in pages.weekly_rows(cells, "id", ["VN", "US", "KR"]).collect()}
    assert rows == {("t", "US", datetime.date(2024, 1, 11), 3, 1500), ("t", "KR", datetime.date(2024, 1, 4), 7, 20)}


def test_corpus_and_shards(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿one\ntwo", encoding="utf-8")
    (tmp_path / "b.txt").write_text("three", encoding="utf-8")
    (tmp_path / "c.mp3").write_bytes(b"x")
    assert {tuple(r) for r in readers.read_corpus(spark, str(tmp_path)).collect()} == {("a", "one\ntwo"), ("b", "three")}
    assert [r["file_name"] for r in readers.list_media(spark, str(tmp_path)).collect()] == ["c.mp3"]


def test_keyed_json(spark):
    text = '{"k1": {"title": "T", "sampling_provenance": [{"market": "US"}, {"market": "KR"}, {"market": "US"}]}, "k2": {"title": "U"}}'
    items = readers.keyed_json_rows(spark.createDataFrame([(text,)], "value string"))
    assert {tuple(r) for r in readers.provenance_markets(items).collect()} == {("k1", "KR;US"), ("k2", None)}
    assert {tuple(r) for r in readers.explode_provenance(items).collect()} == {("k1", "US"), ("k1", "KR")}


def test_streaming_is_idempotent(spark, tmp_path):
    def shard(name, rows):
        spark.createDataFrame(rows, ingest.WEEKLY_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    d = datetime.date
    shard("a", [(1, "US", d(2024, 1, 4), 3, 10), (1, "US", d(2024, 1, 11), 5, 10)])
    run = lambda: ingest.ingest_available(spark, str(tmp_path / "in" / "*"), str(tmp_path / "facts"), str(tmp_path / "state"))
    run()
    shard("b", [(1, "US", d(2024, 1, 4), 1, 10), (2, "KR", d(2024, 1, 4), 300, 1)])
    run()
    run()
    rows = ingest.refreshed_performance(spark, str(tmp_path / "facts")).collect()
    assert [(r["track"], r["weeks_on_chart"], r["peak_rank"], r["chart_score"]) for r in rows] == [(1, 2, 1, 98.0)]


def test_merge_keeps_untouched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, p int, v string"
    sinks.merge_partitions(spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], schema), path, ["k"], "p")
    sinks.merge_partitions(spark.createDataFrame([(2, 2, "B"), (3, 2, "c")], schema), path, ["k"], "p")
    got = {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "a"), (2, "B"), (3, "c")}


def test_conflicting_updates_are_settled_by_order(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, p int, v string"
    rows = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (1, 1, "c")], schema).repartition(3)
    sinks.merge_partitions(rows, path, ["k"], "p")
    assert spark.read.parquet(path).first()["v"] == "a"
    sinks.merge_partitions(rows, path, ["k"], "p", [F.col("v") != "c"])
    assert spark.read.parquet(path).first()["v"] == "c"


def test_merge_reads_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.merge_partitions(spark.createDataFrame([(i, i % 5, "a") for i in range(20)], "k int, p int, v string"), path, ["k"], "p")
    plan = sinks.stored_partitions(spark, path, "p", [3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "= 3)" in plan


def test_key_with_an_invalid_first_row_drops_out(spark):
    rows = [(1, "US", 300, 1), (1, "US", 5, 2), (2, "US", 5, 1), (2, "US", 300, 2)]
    df = spark.createDataFrame(rows, "track int, market string, rank int, seq int").withColumn("chart_date", F.lit("2024-01-04").cast("date"))
    got = chart.clean_fact(df, ["track", "market"], order_by=["seq"]).collect()
    assert [(r["track"], r["rank"]) for r in got] == [(2, 5)]


@pytest.mark.parametrize("raw,expected", [("2022", "2022-01-01"), ("2022/05", "2022-05-01"), (" 2022-05-03 ", "2022-05-03"), ("May", None), (None, None)])
def test_repair_date(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "d string").select(clean.repair_date("d")).first()[0] == expected


def test_mode_flag_is_strict(spark):
    df = spark.createDataFrame([(None,)], "m string")
    assert df.select(clean.mode_flag("m", strict=False)).first()[0] == 0
    with pytest.raises(Exception, match="unexpected mode"):
        df.select(clean.mode_flag("m", strict=True)).collect()


@pytest.mark.parametrize("value,tier", [(37.58, "Tier 1"), (15.16, "Tier 2"), (-11.93, "Tier 3"), (-11.94, "Tier 4")])
def test_tier_edges(spark, value, tier):
    assert spark.createDataFrame([(value,)], "s double").select(score.score_tier("s")).first()[0] == tier


def test_mojibake_by_python(spark):
    df = spark.createDataFrame([("dâ€™or",), ("plain",)], "t string")
    assert [r[0] for r in df.select(clean.redecode_cp1252("t")).collect()] == ["d’or", "plain"]


def test_long_tracks_are_measured(spark):
    # a track of 400 seconds that repeats itself every 50
    rows = [("long", i, [float(np.cos(i % 50)), float(np.sin(i % 50)), 1.0]) for i in range(400)] + [("short", i, [1.0, 0.0, float(i)]) for i in range(12)]
    df = frames.l2_normalized(spark.createDataFrame(rows, "track string, s int, v array<double>"), "v")
    got = {r["track"]: r for r in frames.recurrence(df, "track", "s", "v").collect()}
    assert got["short"]["determinism"] == 0.0 and got["short"]["n_seconds"] == 12
    m = np.array([r[2] for r in rows[:400]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    values = {(i, j): min(float(m[i] @ m[j]), 1.0) for i in range(400) for j in range(i + 10, 400)}
    limit = np.percentile(list(values.values()), 95)
    hit = {p for p, v in values.items() if v >= limit - 1e-12}
    assert got["long"]["longest_run"] >= 300 and got["long"]["determinism"] == pytest.approx(1.0, abs=0.2) and len(hit) > 0


def test_cardinality_checked_join(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ValueError):
        quality.checked_join(left, right, ["k"])


def test_layered_fill(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 2.0, 3.0), (None, None, 3.0), (None, None, None)], "a double, b double, c double")
    v, s = integrate.layered_fill(F.col("a"), [(F.col("b"), "market"), (F.col("c"), "train")], "own", 0.0, "default")
    assert [tuple(r) for r in df.select(v, s).collect()] == [(1.0, "own"), (2.0, "market"), (3.0, "train"), (0.0, "default")]


def test_lyric_rules_from_files(spark, tmp_path):
    def read(*texts):
        folder = tmp_path / f"rules{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for i, text in enumerate(texts):
            (folder / f"{i}.json").write_text(text, encoding="utf-8")
        return readers.read_lyric_rules(spark, str(folder))

    base = readers.DEFAULT_RULES
    rules = read('{\n "pronouns": {"en": [" I ", "i", "", null, "Thou"], "fr": ["je"]}\n}', '{"limits": {"min_block_lines": 2}, "title_languages": ["EN"]}')
    assert rules.pronouns["en"] == ["i", "thou"] and rules.pronouns["fr"] == ["je"] and rules.pronouns["es"] == base.pronouns["es"]
    assert rules.min_block_lines == 2 and rules.max_block_lines == base.max_block_lines and rules.title_languages == ["en"]
    assert rules.stopwords == base.stopwords and rules.blank_languages == base.blank_languages
    for wrong in (['{"pronoun": {}}'], ["{}"], ['{"limits": {"min_block_lines": 11}}'], ['{"limits": {"block_similarity": 1.5}}'], ["[1]"], ['{"pronouns": {}}'] * 2):
        with pytest.raises(ValueError):
            read(*wrong)
    with pytest.raises(Exception):
        read('{"pronouns": {"en": ["i"')


def test_recurrence_of_blocks_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for track, n in (("a", 300), ("b", 61), ("c", 13), ("d", 12), ("e", 11), ("f", 3)):
        walk = np.cumsum(rng.normal(size=(n, 5)), axis=0)
        walk[n // 2 :] = walk[: n - n // 2] + rng.normal(size=(n - n // 2, 5)) * 0.05
        rows += [(track, i, list(map(float, v / np.linalg.norm(v)))) for i, v in enumerate(walk)]
    same = [("same", i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame([*rows, *same], "track string, s int, v array<double>").repartition(5)
    for block in (7, 128):
        got = {r.track: r for r in frames.recurrence(df, "track", "s", "v", block=block).collect()}
        assert set(got) == {"a", "b", "c", "d", "e", "f", "same"}
        for track in "abcdef":
            m = np.array([r[2] for r in rows if r[0] == track])
            n = len(m)
            s = np.clip(np.round(m @ m.T, 12), -1, 1)
            pairs = {(i, j): s[i, j] for i in range(n) for j in range(i + 10, n)}
            lengths = []
            if pairs:
                limit = np.percentile(list(pairs.values()), 95)
                hits = {k for k, v in pairs.items() if v >= limit - 1e-15}
                for i, j in hits:
                    if (i - 1, j - 1) not in hits:
                        k = 0
                        while (i + k, j + k) in hits:
                            k += 1
                        lengths.append(k)
            long = [k for k in lengths if k >= 3]
            r = got[track]
            assert r.n_seconds == n and r.longest_run == (max(long) if long and n >= 13 else 0)
            assert r.mean_run == pytest.approx(np.mean(long) if long and n >= 13 else 0)
            assert r.determinism == pytest.approx(sum(long) / sum(lengths) if long and n >= 13 else 0)
        # all pairs recur: gaps 10 to 39 with 30 to 1 pairs each
        lengths = [k for k in range(1, 31) if k >= 3]
        assert got["same"].mean_run == pytest.approx(np.mean(lengths)) and got["same"].longest_run == 30
        assert got["same"].determinism == pytest.approx(sum(lengths) / sum(range(1, 31)))
    assert frames.recurrence(df.where("s < 0"), "track", "s", "v").count() == 0
