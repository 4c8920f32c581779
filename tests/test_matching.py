import random

import pytest
from pyspark.sql import functions as F

from chartspark.functions import titles as M
from chartspark.operators import matching


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j], row[j + 1]))
    return row[-1]


def test_common_subsequence_matches_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 15))) for _ in range(2))
        assert M.common_length(a, b) == slow_common(a, b)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize("title,artist,expected", [
    ("Ann - Blue Sky (Official Music Video)", "Ann", "blue sky"),
    ("[MV] Ann _ Blue Sky", "Ann", "blue sky"),
    ("Blue Sky | Ann", "Ann", "blue sky"),
    ("Blue Sky (Japan Ver.)", "Bob", "blue sky japanese ver"),
    ("(Ann) Blue Sky", "", "ann blue sky"),
])
def test_normalize_title(spark, title, artist, expected):
    assert one(spark, M.normalize_title(F.col("t"), F.col("a")), t=title, a=artist) == expected


def test_core_title_drops_metadata(spark):
    assert one(spark, M.core_title(F.col("t"), F.col("a")), t="Ann - Blue Sky (Acoustic) feat. Bob", a="Ann") == "blue sky"


@pytest.mark.parametrize("wanted,offered,expected", [
    ("Blue Sky", "Blue Sky (Remix)", True),
    ("Blue Sky (Live)", "Blue Sky concert", False),
    ("Blue Sky (Hot Remix)", "Blue Sky (Cool Remix)", True),
    ("Blue Sky (Hot Remix)", "Blue Sky (Hot Remix)", False),
    ("Blue Sky (Remix)", "Blue Sky (Tiesto Remix)", True),
    ("Blue Sky", "Blue Sky Official Audio", False),
])
def test_version_conflict(spark, wanted, offered, expected):
    df = spark.createDataFrame([(wanted, offered, "Ann")], "w string, o string, a string")
    assert M.with_version_conflict(df, "w", "o", "a").first()["version_conflict"] is expected


CANDIDATE = "track int, candidate_number int, title string, artist string, duration_ms long, video_title string, channel string, video_seconds double"


@pytest.fixture(scope="module")
def evaluated(spark):
    rows = [
        (1, 1, "Blue Sky", "Ann Lee", 200000, "Ann Lee - Blue Sky (Official Audio)", "Ann Lee - Topic", 200.0),
        (1, 2, "Blue Sky", "Ann Lee", 200000, "Blue Sky karaoke", "Sing Fan", 205.0),
        (1, 3, "Blue Sky", "Ann Lee", 200000, "Ann Lee 'Blue Sky' MV", "Random Clips", 260.0),
        (1, 4, "Blue Sky", "Ann Lee", 200000, "Completely Different Song", "Ann Lee", 0.0),
        (2, 1, "봄날", "Ann Lee", 200000, "Ann Lee - Spring Day (봄날) Official Audio", "AnnLeeVEVO", 201.0),
        (2, 2, "봄날", "Ann Lee", 200000, "Spring Day - Ann Lee", "x", 201.0),
    ]
    out = matching.evaluate_candidates(spark.createDataFrame(rows, CANDIDATE), "track")
    return out, {(r["track"], r["candidate_number"]): r for r in out.collect()}


def test_evidence(evaluated):
    _, rows = evaluated
    assert rows[1, 1]["title_similarity"] == 100.0 and not rows[1, 1]["title_conflict"]
    assert rows[1, 1]["identity_evidence"] == ["exact_channel_artist", "artist_in_channel", "artist_in_title"]
    assert rows[1, 1]["source_evidence"] == ["topic_channel", "official_audio"]
    assert rows[1, 1]["duration_difference_ratio"] == 0.0
    assert rows[1, 2]["hard_invalid"] and not rows[1, 1]["hard_invalid"]
    assert rows[1, 3]["title_similarity"] == 100.0 and rows[1, 3]["source_evidence"] == ["music_video"]
    assert rows[1, 4]["title_conflict"] and rows[1, 4]["duration_difference_ratio"] is None


def test_aliases_bridge_scripts(evaluated):
    _, rows = evaluated
    assert rows[2, 1]["title_similarity"] == 100.0 and not rows[2, 1]["title_conflict"]
    assert rows[2, 2]["title_similarity"] == 100.0 and not rows[2, 2]["title_conflict"]
    assert "exact_channel_artist" in rows[2, 1]["identity_evidence"]


def test_decision_on_evidence(evaluated):
    df, _ = evaluated
    got = {r["track"]: r for r in matching.decide_matches(df, "track", "candidate_number", ["candidate_number"]).collect()}
    assert got[1]["status"] == "automatic" and got[1]["selected_candidate_number"] == 1


GIVEN = (
    "song int, number int, title_similarity double, identity_evidence array<string>, source_evidence array<string>, "
    "duration_difference_ratio double, title_conflict boolean, version_conflict boolean, hard_invalid boolean, channel string"
)


def given(song, number, sim, identity=(), source=(), dur=0.01, conflict=False, channel="c"):
    return (song, number, sim, list(identity), list(source), dur, conflict, False, False, channel)


@pytest.mark.parametrize("with_channel", [False])
def test_loose_decisions(spark, with_channel):
    rows = [
        given(1, 1, 95.0, conflict=True),
        given(2, 1, 95.0, ["artist_in_title"]), given(2, 2, 95.0, ["artist_in_title"]),
        given(3, 1, 99.0, ["artist_in_title"]), given(3, 2, 95.0, ["exact_channel_artist"]),
        given(4, 1, 95.0, ["artist_in_title"], ["lyrics"]), given(4, 2, 95.0, ["artist_in_title"], ["official_audio"]),
        given(5, 1, 95.0, ["artist_in_title"], ["lyrics"], 0.02), given(5, 2, 95.0, ["artist_in_title"], ["lyrics"], 0.01),
        given(6, 1, 50.0),
    ]
    df = spark.createDataFrame(rows, GIVEN)
    items = spark.createDataFrame([(i,) for i in range(1, 8)], "song int")
    got = {r["song"]: (r["status"], r["selected_number"]) for r in matching.decide_matches(df, "song", "number", ["number"], with_channel, items).collect()}
    assert got == {
        1: ("no_confident_match", None), 2: ("ambiguous", None), 3: ("automatic", 1), 4: ("automatic", 2), 5: ("automatic", 2),
        6: ("no_confident_match", None), 7: ("no_confident_match", None),
    }


def test_dominance(spark):
    rows = [given(1, 1, 90.0, [], [], 0.2), given(1, 2, 95.0, ["artist_in_title"], ["lyrics"], 0.1), given(1, 3, 95.0, ["artist_in_title"], ["lyrics"], 0.1)]
    got = {r["number"]: (r["dominated_by"], r["evidence_order"]) for r in matching.dominance_order(spark.createDataFrame(rows, GIVEN), "song", "number").collect()}
    assert got == {1: (2, 3), 2: (0, 1), 3: (0, 2)}


def test_dominance_of_many_candidates(spark):
    rows = [given(1, i, 90.0 + i // 10) for i in range(100)]
    got = {r["number"]: r["dominated_by"] for r in matching.dominance_order(spark.createDataFrame(rows, GIVEN), "song", "number").collect()}
    assert got == {i: 90 - i // 10 * 10 for i in range(100)}


def test_alias_table_has_both_sides(spark):
    rows = [(1, "Blue Sky", "Ann", "Ann - Blue Sky (푸른 하늘) MV"), (1, "Blue Sky", "Ann", "푸른하늘 (Blue Sky)"), (1, "Blue Sky", "Ann", None),
            (2, "푸른 하늘", None, "Blue Sky (푸른 하늘)"), (2, "푸른 하늘", None, "Blue Sky (푸른 하늘)"), (3, "Blue Sky", "Ann", "Blue Sky"), (4, None, None, None)]
    df = spark.createDataFrame(rows, "track int, title string, artist string, offered string")
    table = matching.alias_table(df, "track", F.col("offered"), F.col("artist"))
    assert {tuple(r) for r in table.collect()} == {
        (1, "blue sky", "푸른 하늘"), (1, "푸른 하늘", "blue sky"), (1, "푸른하늘", "blue sky"), (1, "blue sky", "푸른하늘"),
        (2, "blue sky", "푸른 하늘"), (2, "푸른 하늘", "blue sky"),
    }
    lists = {r.track: r._aliases for r in matching.alias_lists(df.fillna("", ["title"]), table, "track", "title").collect()}
    assert lists == {1: ["푸른 하늘", "푸른하늘"], 2: ["blue sky"]}
    assert matching.alias_table(df.where("track > 9"), "track", F.col("offered"), F.col("artist")).count() == 0
