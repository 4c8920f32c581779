import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chartspark.functions import text as X
from chartspark.operators import detector


@pytest.fixture(scope="module")
def features(spark):
    def run(text, title="Title", language="en"):
        df = spark.createDataFrame([(text, title, language)], "text string, title string, language string")
        return X.lyric_features(df, "text", "title", "language").first()

    return run


def test_blank_text_has_no_features(features):
    row = features("  \n ")
    assert all(row[c] is None for c in X.FEATURES)


def test_punctuation_only(features):
    row = features("!!! ...\n???")
    assert row["word_count"] == 0 and row["lexical_diversity"] is None and row["line_count"] == 2
    assert row["punctuation_ratio"] > 0.5


def test_repetition(features):
    row = features("\n".join(["la la do do"] * 8))
    assert (row["word_count"], row["unique_word_count"]) == (32, 2)
    assert row["lexical_diversity"] == pytest.approx(2 / 32) and row["repetition_ratio"] == pytest.approx(30 / 32)


@pytest.mark.parametrize("title,expected", [("Shining Night", True), ("Ocean", False), ("The And", None)])
def test_title_words(features, title, expected):
    assert features("we walk through the night", title)["title_word_in_lyrics"] is expected


def test_two_word_pronouns_count_both_positions(features):
    words = ["chúng", "tôi"] + ["x%d" % i for i in range(17)] + ["anh", "em", "ta"]
    assert features(" ".join(words), "t", "vi")["pronoun_ratio"] == pytest.approx(5 / 22)


def test_contractions_stay_one_token(features):
    row = features("I'm here don't you well-known it's")
    assert row["word_count"] == 6 and row["pronoun_ratio"] == pytest.approx(3 / 6)


def test_mixed_language_has_no_pronoun_ratio(features):
    assert features("i love you 나는", "love", "mixed")["pronoun_ratio"] is None


BLOCK = "walking down the empty road\nsinging out a song for you\nnever going back again"


@pytest.mark.parametrize("text,expected", [
    ("one line here\nother line there", None),
    ("[Chorus]\none line here\nother line there", 0),
    ("[Chorus]\na b\n[Verse 1]\nc d\n[Chorus]\na b", 1),
    (f"{BLOCK}\nsome verse in between\n{BLOCK}\nanother verse\n{BLOCK}", 2),
    (f"{BLOCK}\nverse\n{BLOCK.replace('for you', 'for me')}", 1),
])
def test_chorus(features, text, expected):
    assert features(text)["chorus_repetition_count"] == expected


def test_document_language(spark):
    ko = "\n".join(["나는 너를 사랑해 오늘도"] * 4)
    half = "\n".join(["the night is long and the road is long"] * 3 + ["나는 너를 사랑해 오늘도 그리고 내일도 언제나 너를 생각해"] * 4)
    rows = [(1, ko), (2, half), (3, "  "), (4, "oh")]
    df = spark.createDataFrame(rows, "id int, text string")
    english = lambda line: F.when(line.contains("the"), "en")
    out = X.detect_language(df, "id", "text", english, ["en", "es"])
    assert {r["id"]: r["language"] for r in out.collect()} == {1: "ko", 2: "mixed", 3: "unknown", 4: "unknown"}
    labelled = spark.createDataFrame([("the night is long and the road", "en"), ("la noche es larga y el camino", "es"), (ko, None)], "t string, l string")
    weights, names = detector.word_weights(labelled, "t", "l"), detector.languages_of(labelled, "l")
    out = detector.document_languages(df.unionByName(spark.createDataFrame([(5, None)], df.schema)), "id", "text", weights, names)
    assert {r["id"]: r["language"] for r in out.collect()} == {1: "ko", 2: "mixed", 3: "unknown", 4: "unknown", 5: "unknown"}


def test_line_weights_against_brute_force(spark):
    train = [("el sol y la luna", "es"), ("the sun and the moon", "en"), ("the la la la song", "en"), (None, "es"), ("", "fr")]
    lines = ["the song and the sun tonight", "la luna y el sol siempre brillan", "unbekannte Wörter allein hier", "la la la la la la la la", "short"]
    df = spark.createDataFrame(train, "t string, l string")
    names = detector.languages_of(df, "l")
    assert names == ["en", "es", "fr"]
    counts = {n: Counter(w for t, l in train if l == n and t for w in t.split()) for n in names}
    known = set().union(*counts.values())

    def guess(line):
        words = [w for w in line.lower().split() if w in known]
        if sum(c.isalpha() for c in line) < 15 or not words:
            return None
        score = {n: sum(math.log((counts[n][w] + 1) / (sum(counts[n].values()) + len(known))) for w in words) for n in names}
        return max(names, key=lambda n: (round(score[n], 9), -names.index(n)))

    texts = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "id int, text string")
    got = {r["line_no"]: r["line_language"] for r in detector.line_languages(texts, "id", "text", detector.word_weights(df, "t", "l"), names).collect()}
    assert got == {i: guess(line) for i, line in enumerate(lines)} and got[2] is None and got[1] == "es"


def test_clean_line(spark):
    lines = ["[Verse 1: X]", "see [this](http://a.b) now", "go to www.x.y please", "[soft] voice"]
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    assert [r[0] for r in df.select(X.clean_line(F.col("line"))).collect()] == ["", "see this now", "go to  please", "soft voice"]


def test_original_song_filter(spark):
    rows = [("Blue Sky", "Ann", "Blue Sky", "Ann"), ("Blue Sky (Live)", "Ann", "Blue Sky", "Ann"), ("Other", "Ann", "Blue Sky", "Ann")]
    df = spark.createDataFrame(rows, "rt string, ra string, t string, a string")
    got = df.select(X.is_original_song(*[F.col(c) for c in ("rt", "ra", "t", "a")])).collect()
    assert [r[0] for r in got] == [True, False, False]
