"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions.clean import reason_list
from chartspark.operators import quality
from chartspark.plans import dataset as D
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook

PLANS = PlanBook()


@PLANS.add(
    "dq_01_key_uniqueness",
    """SELECT CAST(SUM(n) AS BIGINT) AS n_rows, COUNT(*) AS n_keys, CAST(SUM(n) AS BIGINT) - COUNT(*) AS n_duplicates
    FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def key_uniqueness(spark, sf):
    return quality.duplicate_count(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@PLANS.add(
    "dq_02_required_not_null",
    f"WITH {S.SONGS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS rule, COUNT(*) - COUNT({c}) AS violations FROM songs" for c in ("track", "title", "artist", "release_date")
    ),
)
def required_not_null(spark, sf):
    return quality.not_null_counts(S.songs(spark, sf), ["track", "title", "artist", "release_date"])


@PLANS.add(
    "dq_03_referential_integrity",
    """SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""",
)
def referential_integrity(spark, sf):
    orders = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return quality.orphan_keys(orders, S.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'"), ["c_custkey"])


def perf_rules():
    return {
        "market_known": F.col("market").isin(S.MARKETS[:4]),
        "rank_in_chart": F.col("lifetime_average_rank").between(1, 30),
        "score_formula": F.abs(F.col("chart_score") - (101 - F.col("lifetime_average_rank"))) < 1e-9,
        "top10_le_weeks": F.col("weeks_in_top10") <= F.col("weeks_on_chart"),
        "several_weeks": F.col("weeks_on_chart") >= 2,
    }


@PLANS.add(
    "dq_04_domain_rules",
    f"""WITH {S.PERF} SELECT 'market_known' AS rule, COUNT(*) FILTER (WHERE market NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')) AS violations FROM perf
    UNION ALL SELECT 'rank_in_chart', COUNT(*) FILTER (WHERE lifetime_average_rank NOT BETWEEN 1 AND 30) FROM perf
    UNION ALL SELECT 'score_formula', COUNT(*) FILTER (WHERE abs(chart_score - (101 - lifetime_average_rank)) >= 1e-9) FROM perf
    UNION ALL SELECT 'top10_le_weeks', COUNT(*) FILTER (WHERE weeks_in_top10 > weeks_on_chart) FROM perf
    UNION ALL SELECT 'several_weeks', COUNT(*) FILTER (WHERE weeks_on_chart < 2) FROM perf""",
)
def domain_rules(spark, sf):
    return quality.rule_violations(S.perf(spark, sf), perf_rules())


@PLANS.add(
    "dq_04_weekday_and_window",
    f"""WITH {S.WEEKLY} SELECT 'thursday' AS rule, COUNT(*) FILTER (WHERE isodow(chart_date) <> 4) AS violations FROM weekly
    UNION ALL SELECT 'in_window', COUNT(*) FILTER (WHERE chart_date NOT BETWEEN DATE '1996-01-01' AND DATE '2001-06-30') FROM weekly
    UNION ALL SELECT 'streams_positive', COUNT(*) FILTER (WHERE streams <= 0) FROM weekly""",
)
def weekday_and_window(spark, sf):
    rules = {
        "thursday": F.weekday("chart_date") == 3,
        "in_window": F.col("chart_date").between("1996-01-01", "2001-06-30"),
        "streams_positive": F.col("streams") > 0,
    }
    return quality.rule_violations(S.weekly(spark, sf), rules)


@PLANS.add(
    "dq_04_one_selected_per_key",
    """SELECT l_orderkey, COUNT(*) FILTER (WHERE l_returnflag = 'A') AS n_selected FROM lineitem GROUP BY 1
    HAVING COUNT(*) FILTER (WHERE l_returnflag = 'A') > 1""",
)
def one_selected(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    return line.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("n_selected")).where("n_selected > 1")


@PLANS.add(
    "dq_05_check_log",
    f"""WITH {S.PERF}, v AS (SELECT 'market_known' AS "check", COUNT(*) FILTER (WHERE market NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')) AS value FROM perf
    UNION ALL SELECT 'rank_in_chart', COUNT(*) FILTER (WHERE lifetime_average_rank NOT BETWEEN 1 AND 30) FROM perf
    UNION ALL SELECT 'score_formula', COUNT(*) FILTER (WHERE abs(chart_score - (101 - lifetime_average_rank)) >= 1e-9) FROM perf
    UNION ALL SELECT 'top10_le_weeks', COUNT(*) FILTER (WHERE weeks_in_top10 > weeks_on_chart) FROM perf
    UNION ALL SELECT 'several_weeks', COUNT(*) FILTER (WHERE weeks_on_chart < 2) FROM perf)
    SELECT "check", 'performance' AS scope, CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS status, value, CAST(0 AS BIGINT) AS expected FROM v""",
)
def check_log(spark, sf):
    return quality.check_log(quality.rule_violations(S.perf(spark, sf), perf_rules()), "performance")


def lyric_issue_rules():
    """Row rules of the text feature table: (condition, code)."""
    n, u = F.col("word_count"), F.col("unique_word_count")
    ok = F.col("lyrics_status") == "success"
    near = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return [
        (F.col("track").isNull(), "missing_track"),
        (~ok & n.isNotNull(), "unexpected_word_count"),
        (ok & n.isNull(), "missing_word_count"),
        (n <= 0, "invalid_word_count"),
        (u > n, "unique_exceeds_words"),
        (F.col("avg_word_length") > 6.5, "long_words"),
        (F.col("line_count") <= 1, "single_line"),
        (~near(F.col("lexical_diversity"), u / n), "lexical_formula_mismatch"),
        (~near(F.col("lexical_diversity") + F.col("repetition_ratio"), F.lit(1.0)), "ratios_not_one"),
        (~F.col("repetition_ratio").between(0, 0.9), "out_of_range_repetition_ratio"),
        ((F.col("language") == "de") & F.col("title_word_in_lyrics").isNotNull(), "title_word_for_unsupported_language"),
        (F.col("chorus_repetition_count") == 0, "zero_chorus_without_tag"),
    ]


@PLANS.add(
    "dq_06_row_rules",
    f"""WITH {S.LYRICS} SELECT track, concat_ws(';', CASE WHEN lyrics_status <> 'success' AND word_count IS NOT NULL THEN 'unexpected_word_count' END,
      CASE WHEN lyrics_status = 'success' AND word_count IS NULL THEN 'missing_word_count' END, CASE WHEN word_count <= 0 THEN 'invalid_word_count' END,
      CASE WHEN unique_word_count > word_count THEN 'unique_exceeds_words' END, CASE WHEN avg_word_length > 6.5 THEN 'long_words' END,
      CASE WHEN line_count <= 1 THEN 'single_line' END, CASE WHEN abs(lexical_diversity + repetition_ratio - 1) > 1e-6 THEN 'ratios_not_one' END,
      CASE WHEN repetition_ratio NOT BETWEEN 0 AND 0.9 THEN 'out_of_range_repetition_ratio' END,
      CASE WHEN language = 'de' AND title_word_in_lyrics IS NOT NULL THEN 'title_word_for_unsupported_language' END,
      CASE WHEN chorus_repetition_count = 0 THEN 'zero_chorus_without_tag' END) AS issues FROM lyric_rows""",
)
def row_rules(spark, sf):
    return S.lyric_rows(spark, sf).select("track", F.array_join(reason_list(*lyric_issue_rules()), ";").alias("issues"))


@PLANS.add(
    "dq_08_sample_checks",
    f"""WITH {S.SAMPLE}, g AS (SELECT market, quarter, COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT track) AS dup FROM sample GROUP BY 1, 2)
    SELECT COUNT(*) AS n_groups, COUNT(*) FILTER (WHERE n <> 40) AS not_40, CAST(SUM(dup) AS BIGINT) AS duplicates,
    (SELECT COUNT(*) FROM sample s LEFT JOIN quarter_rank q ON q.track = s.track AND q.market = s.market AND q.quarter = s.quarter
      WHERE q.track IS NULL) AS outside_source FROM g""",
)
def sample_checks(spark, sf):
    sample = S.sample(spark, sf)
    source = S.quarter_rank(spark, sf).select("market", "quarter", "track").withColumn("_known", F.lit(1))
    per_group = (
        sample.join(source, ["market", "quarter", "track"], "left")
        .groupBy("market", "quarter")
        .agg(
            F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("track")).alias("dup"),
            F.count_if(F.col("_known").isNull()).alias("outside"),
        )
    )
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") != 40).alias("not_40"),
        F.sum("dup").alias("duplicates"), F.sum("outside").alias("outside_source"),
    )


@PLANS.add(
    "dq_09_totals_agree",
    f"""WITH {S.PERF} SELECT (SELECT CAST(SUM(weeks_on_chart) AS BIGINT) FROM perf) AS weeks_total, (SELECT COUNT(*) FROM weekly) AS clean_rows""",
)
def totals_agree(spark, sf):
    # both totals come from the same weekly rows
    weekly = S.weekly(spark, sf)
    from chartspark.operators.chart import chart_performance

    weeks = chart_performance(weekly, "track").agg(F.sum("weeks_on_chart").alias("weeks_total")).withColumn("_one", F.lit(1))
    rows = weekly.agg(F.count(F.lit(1)).alias("clean_rows")).withColumn("_one", F.lit(1))
    return weeks.join(rows, "_one").drop("_one")


@PLANS.add(
    "dq_10_cardinality",
    f"""WITH {D.DATASET}, c AS (SELECT 'rows' AS label, COUNT(*) AS actual FROM dataset UNION ALL SELECT 'tracks', COUNT(DISTINCT track) FROM dataset
      UNION ALL SELECT 'rows_' || market, COUNT(*) FROM dataset GROUP BY market)
    SELECT e.label, CAST(c.actual AS DOUBLE) AS actual, e.expected, CASE WHEN coalesce(c.actual = e.expected, FALSE) THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (VALUES ('rows', 9932.0::DOUBLE), ('tracks', 2000.0), ('rows_ASIA', 1999.0), ('rows_NOWHERE', 1.0)) e(label, expected) LEFT JOIN c ON c.label = e.label""",
)
def cardinality(spark, sf):
    data = D.modeling(spark, sf).select("track", "market")
    whole = data.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.countDistinct("track").cast("double").alias("tracks"))
    whole = whole.withColumn("_t", F.lit("")).unpivot("_t", ["rows", "tracks"], "label", "actual").drop("_t")
    per = data.groupBy(F.concat(F.lit("rows_"), F.col("market")).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("actual"))
    listed = [("rows", 9932.0), ("tracks", 2000.0), ("rows_ASIA", 1999.0), ("rows_NOWHERE", 1.0)]
    expected = spark.createDataFrame(listed, "label string, expected double")
    return quality.tolerance_checks(whole.unionByName(per), expected, atol=0.0, rtol=0.0)


@PLANS.add(
    "prj_12_inventory_status",
    """WITH d AS (SELECT doc_id, source, n_chars, lang, COUNT(*) OVER (PARTITION BY text) AS copies, quality FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT *, CASE WHEN quality IS NULL THEN 'not_found' WHEN quality = 1 THEN 'success' ELSE 'partial' END AS lyrics_status FROM d)
    SELECT doc_id, CASE WHEN lyrics_status = 'not_found' THEN 'lyrics_unavailable' WHEN n_chars < 20 THEN 'no_valid_tokens'
      WHEN lyrics_status <> 'success' THEN 'file_exists_status_mismatch' ELSE 'available' END AS inventory_status,
    concat_ws(';', CASE WHEN copies > 1 THEN 'multiple_tracks_mapped_to_file' END, CASE WHEN lyrics_status <> 'success' THEN 'lyrics_status=' || lyrics_status END,
      CASE WHEN lang = 'de' THEN 'language_limited:' || lang END) AS error_reason FROM s""",
)
def inventory_status(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("content"))
    copies = docs.groupBy("content").agg(F.count(F.lit(1)).alias("copies"))
    labels = S.table(spark, sf, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality").isNull(), "not_found").when(F.col("quality") == 1, "success").otherwise("partial")
    rows = docs.join(copies, "content").join(labels, "doc_id", "left").withColumn("lyrics_status", status)
    state = (
        F.when(F.col("lyrics_status") == "not_found", "lyrics_unavailable").when(F.col("n_chars") < 20, "no_valid_tokens")
        .when(F.col("lyrics_status") != "success", "file_exists_status_mismatch").otherwise("available")
    )
    reasons = reason_list(
        (F.col("copies") > 1, "multiple_tracks_mapped_to_file"),
        (F.col("lyrics_status") != "success", F.concat(F.lit("lyrics_status="), F.col("lyrics_status"))),
        (F.col("lang") == "de", F.concat(F.lit("language_limited:"), F.col("lang"))),
    )
    return rows.select("doc_id", state.alias("inventory_status"), F.array_join(reasons, ";").alias("error_reason"))


@PLANS.add(
    "prj_13_mojibake",
    """SELECT doc_id, regexp_matches(text, 'Ã|Ä|Â|â€|�') AS suspicious, TRUE AS repaired FROM documents""",
)
def mojibake(spark, sf):
    from chartspark.functions import clean

    docs = S.table(spark, sf, "documents").select("doc_id", "text")
    # damage the text the usual way, repair it, and compare with the original
    broken = docs.select("doc_id", "text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("broken"))
    fixed = broken.withColumn("fixed", clean.redecode_latin1("broken"))
    return fixed.select(
        "doc_id", clean.looks_misdecoded("fixed").alias("suspicious"), F.col("fixed").eqNullSafe(F.col("text")).alias("repaired")
    )


@PLANS.add(
    "prj_15_duration_seconds",
    """WITH t AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) - 20000 AS ms FROM orders)
    SELECT id, round(ms / 1000.0, 3) AS seconds FROM t WHERE ms > 0""",
)
def duration_seconds(spark, sf):
    t = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") - 20000).alias("ms"))
    return quality.require_unique(t, ["id"]).where("id is not null and ms > 0").select("id", F.round(F.col("ms") / 1000, 3).alias("seconds"))
