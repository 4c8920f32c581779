"""Work of the title rules at size: tasks, joins, how often a chain stands in a plan; the quick patterns find what the plain ones do."""

from pyspark.sql import functions as F

from chartspark.functions import title_rules as R
from chartspark.functions import titles as M
from chartspark.operators import matching
from chartspark.plans import titles

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_titles_of_a_small_file_are_dealt_over_all_tasks(spark):
    df = titles.parts(spark, SF)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_candidates_with_artist_and_aliases_are_never_broadcast(spark):
    assert "Broadcast" not in physical(titles.bilingual_aliases(spark, SF))
    rows = spark.createDataFrame([(1, "가나 (song)", "who", "song")], "k long, offered string, artist string, title string")
    named = matching.alias_lists(rows, matching.alias_table(rows, "k", F.col("offered"), F.col("artist")), "k", "title")
    assert "Broadcast" not in physical(named)
    assert [tuple(r) for r in named.collect()] == [(1, ["가나"])]


def test_a_suffixed_reading_normalises_its_title_once(spark):
    rows = spark.createDataFrame([("x", "a", "x", False)], "offered string, artist string, wanted string, conflict boolean")
    made = M.with_title_variants(rows, "offered", "artist", "wanted", "conflict")
    text = made.select("variants")._jdf.queryExecution().analyzed().toString()
    # the chain starts with one test of this pattern; every use of a reading's value used to hold the whole chain again
    chains = text.count("japan\\s+ver")
    assert chains <= 12, chains


ODD = [
    "", "remix", "xremix remix", "RemiX)", "ſped up", "ſlowed", "KARAOKE", "İnst", "ınstrumental", "livé", "álive", "édit live_", "라이브", "x라이브", "라이브 무대",
    "@ show", "x@show", "20 MMA", "2019 mma", "mama 2019", "3 hours", "33hour", "8d", "8D audio", "[inst.]", "inst", "Taylor’s Version", "feat.", "ft", "xft. ft.", "with", "produced  by x",
    "prod.", "color coded", "eng/rom", "kor, 가사", "가사", "日本語字幕", "m / v", "official mv", "4K", "full  hd", "😀live", "live😀", "_live", "jp ver.", "KR version", "eng ver", " live",
]


def test_quick_patterns_find_what_the_plain_ones_do(spark):
    groups = [*R.VERSION.values(), R.METADATA, R.FEATURE, R.OFFICIAL_CHANNEL, R.FAN_CHANNEL, [p for ps in R.VERSION.values() for p in ps]]
    single = [*R.PRESENTATION, *[p for p, _ in R.CANONICAL], *[p for p, _ in R.TITLE_SOURCE]]
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").repartition(1)
    cells = []
    for patterns in groups:
        plain, shared = "(?iU)(?:" + "|".join(patterns) + ")", "(?iU)" + R.any_of(patterns)
        cells.append(F.regexp_replace("t", F.lit(plain), F.lit("<>")) == F.regexp_replace("t", F.lit(shared), F.lit("<>")))
    for p in single:
        cells.append(F.regexp_replace("t", F.lit("(?iU)" + p), F.lit("<>")) == F.regexp_replace("t", F.lit("(?iU)" + R.quick(p)), F.lit("<>")))
    wrong = rows.withColumn("same", F.array(*cells)).where(F.exists("same", lambda x: ~x))
    assert wrong.collect() == []


def test_neighbours_share_one_boundary_only_where_that_is_safe():
    assert R.any_of([r"\blive\b", r"\bmegamix\b"]) == r"(?:(?=[lm])\b(?:live\b|megamix\b))"
    for pattern in (r"\ba|b", r"\b(?:a|b)?c", r"\ba?b", r"\b\s+x", "vevo$", r"\b", r"\b(?:|a)"):
        assert R.openings(pattern) is None and R.quick(pattern) == pattern
