"""Summary queries: descriptive tables, distributions, crosstabs, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions import clean, score
from chartspark.operators import order, profile
from chartspark.plans import dataset as D
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook

PLANS = PlanBook()

PERF_COLS = ["chart_score", "peak_rank", "weeks_on_chart"]
_LONG_PERF = "UNION ALL".join(
    f" SELECT track, market, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM perf " for c in PERF_COLS
)
_LONG_ALL = f"""long AS ({_LONG_PERF}), grouped AS (SELECT market, feature, value FROM long
  UNION ALL SELECT 'ALL', feature, value FROM long)"""


def _long_perf(spark, sf):
    return order.unpivot(S.perf(spark, sf), ["track", "market"], PERF_COLS)


@PLANS.add(
    "agg_05_describe_by_market",
    f"""WITH {S.PERF}, {_LONG_ALL} SELECT market, feature, COUNT(value) AS n, round(AVG(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std, round(MIN(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(MAX(value), 6) AS max
    FROM grouped GROUP BY 1, 2""",
)
def describe_by_market(spark, sf):
    long = profile.with_overall(_long_perf(spark, sf).drop("track"), "market")
    out = profile.describe(long, ["market", "feature"])
    return out.select("market", "feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")])


@PLANS.add(
    "agg_06_full_profile",
    f"""WITH {S.AUDIO}, long AS (SELECT audio_mode AS market, 'tempo_bpm' AS feature, tempo_bpm AS value FROM audio
      UNION ALL SELECT audio_mode, 'spectral_centroid', CASE WHEN track % 4 <> 0 THEN spectral_centroid END FROM audio),
    grouped AS (SELECT * FROM long WHERE market IS NOT NULL UNION ALL SELECT 'ALL', feature, value FROM long WHERE market IS NOT NULL)
    SELECT market, feature, COUNT(*) AS n_obs, COUNT(value) AS valid_n, COUNT(*) - COUNT(value) AS missing_n,
    round((COUNT(*) - COUNT(value)) * 100.0 / COUNT(*), 2) AS missing_pct, round(AVG(value), 4) AS mean,
    round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.25), 4) AS q25,
    round(quantile_cont(value, 0.75), 4) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr,
    round(MIN(value), 4) AS min, round(MAX(value), 4) AS max, round(skewness(value), 4) AS skewness,
    round(kurtosis(value), 4) AS kurtosis FROM grouped GROUP BY 1, 2""",
)
def full_profile(spark, sf):
    audio = S.audio(spark, sf).where("audio_mode is not null").select(
        F.col("audio_mode").alias("market"), "tempo_bpm",
        F.when(F.col("track") % 4 != 0, F.col("spectral_centroid")).alias("spectral_centroid"),
    )
    long = order.unpivot(profile.with_overall(audio, "market"), ["market"], ["tempo_bpm", "spectral_centroid"])
    return profile.full_profile(long, ["market", "feature"])


_GROUPED = f"""WITH {S.LYRICS}, tagged AS (SELECT 'overall' AS group_type, 'ALL' AS group_name, * FROM lyric_rows
  UNION ALL SELECT 'language', language, * FROM lyric_rows UNION ALL SELECT 'status', lyrics_status, * FROM lyric_rows)"""


@PLANS.add(
    "agg_07_numeric_by_groupings",
    _GROUPED + """, expected AS (SELECT * FROM (VALUES ('overall', 'ALL'), ('language', 'de'), ('language', 'en'), ('language', 'es'),
      ('language', 'fr'), ('language', 'ko'), ('status', 'success'), ('status', 'not_found')) v(group_type, group_name))
    SELECT e.group_type, e.group_name, COUNT(t.word_count) AS n, round(AVG(t.word_count), 6) AS mean,
      round(stddev_samp(t.word_count), 6) AS std, MIN(t.word_count) AS min, round(quantile_cont(t.word_count, 0.5), 6) AS median,
      MAX(t.word_count) AS max
    FROM expected e LEFT JOIN tagged t ON t.group_type = e.group_type AND t.group_name = e.group_name GROUP BY 1, 2""",
)
def numeric_by_groupings(spark, sf):
    rows = S.lyric_rows(spark, sf).select("word_count", "language", "lyrics_status")
    tags = F.array(
        F.struct(F.lit("overall").alias("t"), F.lit("ALL").alias("g")),
        F.struct(F.lit("language").alias("t"), F.col("language").alias("g")),
        F.struct(F.lit("status").alias("t"), F.col("lyrics_status").alias("g")),
    )
    tagged = rows.select("word_count", F.explode(tags).alias("k")).select(
        F.col("k.t").alias("group_type"), F.col("k.g").alias("group_name"), "word_count"
    )
    stats = profile.describe(tagged, ["group_type", "group_name"], "word_count", {"median": 0.5})
    listed = [("overall", "ALL"), *[("language", x) for x in ("de", "en", "es", "fr", "ko")], ("status", "success"), ("status", "not_found")]
    expected = spark.createDataFrame(listed, "group_type string, group_name string")
    out = expected.join(stats, ["group_type", "group_name"], "left")
    return out.select(
        "group_type", "group_name", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")], "min", "max",
    )


@PLANS.add(
    "agg_08_boolean_profile",
    f"""WITH {S.LYRICS} SELECT language, COUNT(title_word_in_lyrics) AS valid, COUNT(*) FILTER (WHERE title_word_in_lyrics) AS true_n,
    COUNT(*) FILTER (WHERE NOT title_word_in_lyrics) AS false_n, round(AVG(CAST(title_word_in_lyrics AS INTEGER)), 6) AS true_ratio
    FROM lyric_rows GROUP BY 1""",
)
def boolean_profile(spark, sf):
    out = profile.boolean_profile(S.lyric_rows(spark, sf), ["language"], "title_word_in_lyrics")
    return out.withColumn("true_ratio", F.round("true_ratio", 6))


@PLANS.add(
    "agg_09_population_summary",
    """SELECT event_type, COUNT(value) AS n, round(AVG(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
    round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY 1""",
)
def population_summary(spark, sf):
    events = S.table(spark, sf, "events")
    basic = events.groupBy("event_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    marks = order.exact_quantiles(events, ["event_type"], "value", list(names.values()), list(names))
    return basic.join(marks, "event_type", "left").select(
        "event_type", "n", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("mean", "std", *names)]
    )


_MISS = ["tempo_bpm", "word_count", "chorus_repetition_count", "chart_score"]


@PLANS.add(
    "agg_10_missingness",
    f"WITH {D.DATASET}, long AS (" + " UNION ALL ".join(
        f"SELECT market, '{c}' AS feature, {c} IS NULL AS gone FROM dataset" for c in _MISS
    ) + """), grouped AS (SELECT * FROM long UNION ALL SELECT 'Overall', feature, gone FROM long)
    SELECT feature, market, COUNT(*) AS total, COUNT(*) FILTER (WHERE gone) AS missing,
    round(COUNT(*) FILTER (WHERE gone) * 100.0 / COUNT(*), 2) AS pct FROM grouped GROUP BY 1, 2""",
)
def missingness(spark, sf):
    return profile.missingness(order.unpivot(D.modeling(spark, sf), ["market"], _MISS), "market")


@PLANS.add(
    "agg_11_null_audit",
    f"""WITH {D.DATASET} SELECT COUNT(*) AS n_rows, """ + ", ".join(f"COUNT(*) - COUNT({c}) AS {c}_nulls" for c in _MISS) + " FROM dataset",
)
def null_audit(spark, sf):
    return profile.null_audit(D.modeling(spark, sf), _MISS)


@PLANS.add(
    "agg_11_range_audit",
    """SELECT MIN(l_quantity) AS l_quantity_min, MAX(l_quantity) AS l_quantity_max, MIN(l_discount) AS l_discount_min,
    MAX(l_discount) AS l_discount_max FROM lineitem""",
)
def range_audit(spark, sf):
    return profile.range_audit(S.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])


@PLANS.add(
    "agg_12_duplicate_grain",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def duplicate_grain(spark, sf):
    return profile.duplicate_keys(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@PLANS.add(
    "agg_13_two_level_counts",
    f"""WITH {S.PERF} SELECT n_markets, COUNT(*) AS n_tracks, CAST(SUM(n_markets) AS BIGINT) AS n_rows FROM
    (SELECT track, COUNT(DISTINCT market) AS n_markets FROM perf GROUP BY 1) GROUP BY 1""",
)
def two_level(spark, sf):
    per_track = S.perf(spark, sf).groupBy("track").agg(F.countDistinct("market").alias("n_markets"))
    return per_track.groupBy("n_markets").agg(F.count(F.lit(1)).alias("n_tracks"), F.sum("n_markets").alias("n_rows"))


@PLANS.add(
    "agg_14_status_by_market",
    f"""WITH {D.DATASET} SELECT market, lyrics_status, COUNT(*) AS n_rows, COUNT(DISTINCT track) AS n_tracks FROM dataset GROUP BY 1, 2""",
)
def status_by_market(spark, sf):
    return D.modeling(spark, sf).groupBy("market", "lyrics_status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("track").alias("n_tracks")
    )


@PLANS.add(
    "agg_15_fixed_histogram",
    f"""WITH {S.PERF}, sizes AS (SELECT market, COUNT(chart_score) AS size FROM perf GROUP BY 1),
    counts AS (SELECT market, CAST(least(floor((chart_score + 100) / 5), 39) AS INTEGER) AS bin, COUNT(*) AS n FROM perf
      WHERE chart_score BETWEEN -100 AND 100 GROUP BY 1, 2)
    SELECT s.market, CAST(b.bin AS INTEGER) AS bin, CAST(-100 + b.bin * 5 AS DOUBLE) AS bin_left, CAST(-95 + b.bin * 5 AS DOUBLE) AS bin_right,
    coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) * 100.0 / size, 4) AS pct FROM sizes s CROSS JOIN range(40) b(bin)
    LEFT JOIN counts c ON c.market = s.market AND c.bin = b.bin""",
)
def fixed_histogram(spark, sf):
    return profile.fixed_histogram(S.perf(spark, sf), "market", "chart_score", -100.0, 100.0, 40)


@PLANS.add(
    "agg_16_rank_frequency",
    f"""WITH {S.WEEKLY} SELECT market, rank, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER (PARTITION BY market) AS BIGINT) AS group_total,
    round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY market), 4) AS share_pct FROM weekly GROUP BY 1, 2""",
)
def rank_frequency(spark, sf):
    ranked = S.weekly(spark, sf).select("market", F.col("rank").cast("bigint").alias("rank"))
    return profile.frequency(ranked, "market", "rank")


_TENURE = [("1", 1, 2), ("2-4", 2, 5), ("5-12", 5, 13), ("13-25", 13, 26), ("26-51", 26, 52), ("52-103", 52, 104), ("104+", 104, None)]


@PLANS.add(
    "agg_17_bracket_counts",
    f"""WITH {S.PERF}, brackets AS (SELECT * FROM (VALUES ('1', 1, 2), ('2-4', 2, 5), ('5-12', 5, 13), ('13-25', 13, 26), ('26-51', 26, 52), ('52-103', 52, 104), ('104+', 104, 1000000000)) v(bracket, lo, hi)),
    sizes AS (SELECT market, COUNT(*) AS size FROM perf GROUP BY 1)
    SELECT s.market, b.bracket, COUNT(p.track) AS n, round(COUNT(p.track) * 100.0 / any_value(size), 2) AS share_pct
    FROM sizes s CROSS JOIN brackets b LEFT JOIN perf p ON p.market = s.market AND p.weeks_on_chart >= lo AND p.weeks_on_chart < hi
    GROUP BY 1, 2""",
)
def bracket_counts(spark, sf):
    edges, labels = [b[1] for b in _TENURE], [b[0] for b in _TENURE]
    return profile.bracket_counts(S.perf(spark, sf), "market", clean.left_closed_bin("weeks_on_chart", edges, labels, open_last=True), labels)


@PLANS.add(
    "agg_18_crosstab",
    """WITH d AS (SELECT source, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'other' END AS lang FROM documents)
    SELECT source, COUNT(*) AS row_total, COUNT(*) FILTER (WHERE lang = 'en') AS en_n, COUNT(*) FILTER (WHERE lang = 'fr') AS fr_n,
    COUNT(*) FILTER (WHERE lang = 'other') AS other_n, round(COUNT(*) FILTER (WHERE lang = 'en') * 100.0 / COUNT(*), 2) AS en_pct,
    round(COUNT(*) FILTER (WHERE lang = 'fr') * 100.0 / COUNT(*), 2) AS fr_pct,
    round(COUNT(*) FILTER (WHERE lang = 'other') * 100.0 / COUNT(*), 2) AS other_pct FROM d GROUP BY 1""",
)
def crosstab(spark, sf):
    docs = S.table(spark, sf, "documents").select("source", "lang")
    grouped = F.when(F.col("lang").isin("en", "fr"), F.col("lang")).otherwise("other")
    return profile.crosstab(docs, "source", grouped, ["en", "fr", "other"])


@PLANS.add(
    "agg_19_tier_pivot",
    f"""WITH {S.PERF}, t AS (SELECT market, CASE WHEN peak_rank <= 10 THEN 'front' WHEN peak_rank <= 50 THEN 'middle' ELSE 'back' END AS tier FROM perf)
    SELECT market, COUNT(*) FILTER (WHERE tier = 'front') AS front, COUNT(*) FILTER (WHERE tier = 'middle') AS middle,
    COUNT(*) FILTER (WHERE tier = 'back') AS back, COUNT(*) FILTER (WHERE tier = 'front') > 0 AND COUNT(*) FILTER (WHERE tier = 'middle') > 0
      AND COUNT(*) FILTER (WHERE tier = 'back') > 0 AS covered FROM t GROUP BY 1""",
)
def tier_pivot(spark, sf):
    r = F.col("peak_rank")
    tiers = S.perf(spark, sf).withColumn("tier", F.when(r <= 10, "front").when(r <= 50, "middle").otherwise("back"))
    wide = tiers.groupBy("market").pivot("tier", ["front", "middle", "back"]).count().fillna(0)
    return wide.withColumn("covered", (F.col("front") > 0) & (F.col("middle") > 0) & (F.col("back") > 0))


@PLANS.add(
    "agg_20_named_aggregates",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_price, round(AVG(l_extendedprice), 6) AS mean_price,
    round(stddev_samp(l_extendedprice), 6) AS std_price, COUNT(*) AS n FROM lineitem GROUP BY 1""",
)
def named_aggregates(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    out = profile.describe(line, ["l_returnflag"], "l_extendedprice", {"median": 0.5})
    return out.select(
        "l_returnflag", F.round("median", 6).alias("median_price"), F.round("mean", 6).alias("mean_price"),
        F.round("std", 6).alias("std_price"), "n",
    )


@PLANS.add(
    "agg_21_wide_stat_pivot",
    f"""WITH {S.PERF}, long AS ({_LONG_PERF}) SELECT feature, """ + ", ".join(
        f"round(AVG(value) FILTER (WHERE market = '{m}'), 6) AS {m.replace(' ', '_')}_mean, "
        f"round(MAX(value) FILTER (WHERE market = '{m}'), 6) AS {m.replace(' ', '_')}_max" for m in S.MARKETS
    ) + " FROM long GROUP BY 1",
)
def wide_stat_pivot(spark, sf):
    long = _long_perf(spark, sf)
    wide = long.groupBy("feature").pivot("market", S.MARKETS).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max")
    )
    return wide.toDF(*[c.replace(" ", "_") for c in wide.columns])


@PLANS.add(
    "agg_22_scaled_market_means",
    f"""WITH {S.PERF}, r AS (SELECT MIN(chart_score) AS a, MAX(chart_score) AS b, MIN(weeks_on_chart) AS c, MAX(weeks_on_chart) AS d FROM perf)
    SELECT market, round(AVG((chart_score - a) / (b - a)), 6) AS chart_score, round(AVG((weeks_on_chart - c) / (d - c)), 6) AS weeks_on_chart
    FROM perf, r GROUP BY 1""",
)
def scaled_market_means(spark, sf):
    scaled = profile.min_max_scaled(S.perf(spark, sf).select("market", "chart_score", "weeks_on_chart"), ["chart_score", "weeks_on_chart"])
    return scaled.groupBy("market").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("chart_score", "weeks_on_chart")])


@PLANS.add(
    "agg_23_quarterly_means_full_axis",
    f"""WITH {S.QUARTER}, axis AS (SELECT CAST(y AS VARCHAR) || '-Q' || CAST(q AS VARCHAR) AS quarter, m.market
      FROM (SELECT unnest(range(MIN(CAST(left(quarter, 4) AS INTEGER)), MAX(CAST(left(quarter, 4) AS INTEGER)) + 1)) FROM quarter_rank) a(y)
      CROSS JOIN range(1, 5) b(q) CROSS JOIN (SELECT DISTINCT market FROM quarter_rank) m)
    SELECT a.quarter, a.market, round(AVG(r.rank), 6) AS mean_rank FROM axis a LEFT JOIN quarter_rank r
      ON r.quarter = a.quarter AND r.market = a.market GROUP BY 1, 2""",
)
def quarterly_means(spark, sf):
    means = S.quarter_rank(spark, sf).groupBy("quarter", "market").agg(F.round(F.avg("rank"), 6).alias("mean_rank"))
    year = F.substring("quarter", 1, 4).cast("int")
    axis = means.agg(F.min(year).alias("a"), F.max(year).alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("y"))
    axis = axis.select("y", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q"))
    axis = axis.select(F.concat_ws("-Q", F.col("y").cast("string"), F.col("q").cast("string")).alias("quarter"))
    axis = axis.select("quarter", F.explode(F.array(*[F.lit(m) for m in S.MARKETS])).alias("market"))
    return axis.join(means, ["quarter", "market"], "left")


@PLANS.add(
    "agg_24_year_market_means",
    f"""WITH {S.WEEKLY} SELECT CAST(year(chart_date) AS INTEGER) AS year, market, round(AVG(rank), 6) AS mean_rank,
    round(AVG(streams), 4) AS mean_streams FROM weekly GROUP BY 1, 2""",
)
def year_market_means(spark, sf):
    return S.weekly(spark, sf).groupBy(F.year("chart_date").alias("year"), "market").agg(
        F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg("streams"), 4).alias("mean_streams")
    )


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR_PAIRS = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i:]]


@PLANS.add(
    "agg_25_pearson_matrix",
    "WITH l AS (SELECT l_returnflag AS market, * FROM lineitem UNION ALL SELECT 'ALL', * FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT market, '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM l GROUP BY 1" for a, b in _CORR_PAIRS
    ),
)
def pearson_matrix(spark, sf):
    line = S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("market"), *_CORR)
    out = profile.pearson_long(profile.with_overall(line, "market"), ["market"], _CORR)
    return out.withColumn("r", F.round("r", 6))


@PLANS.add(
    "agg_26_trend_per_market",
    f"""WITH {S.PERF}, t AS (SELECT market, regr_slope(chart_score, weeks_on_chart) AS b, regr_intercept(chart_score, weeks_on_chart) AS a,
      COUNT(*) AS n, quantile_cont(weeks_on_chart, 0.01) AS x0, quantile_cont(weeks_on_chart, 0.99) AS x1 FROM perf GROUP BY 1)
    SELECT market, n, round(b, 6) AS slope, round(a, 6) AS intercept, round(x0, 6) AS x_low, round(x1, 6) AS x_high,
    round(a + b * x0, 6) AS y_low, round(a + b * x1, 6) AS y_high FROM t WHERE n > 10""",
)
def trend(spark, sf):
    perf = S.perf(spark, sf).select("market", "chart_score", F.col("weeks_on_chart").cast("double").alias("x"))
    lines = perf.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("chart_score", "x").alias("slope"), F.regr_intercept("chart_score", "x").alias("intercept")
    )
    ends = order.exact_quantiles(perf, ["market"], "x", [0.01, 0.99], ["x_low", "x_high"])
    out = lines.where("n > 10").join(ends, "market")
    y = lambda x: F.col("intercept") + F.col("slope") * F.col(x)
    return out.select(
        "market", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "x_low", "x_high")],
        F.round(y("x_low"), 6).alias("y_low"), F.round(y("x_high"), 6).alias("y_high"),
    )


@PLANS.add(
    "agg_30_residual_summary",
    f"""WITH {S.PERF}, r AS (SELECT market, chart_score - AVG(chart_score) OVER () AS e FROM perf),
    grouped AS (SELECT * FROM r UNION ALL SELECT 'ALL', e FROM r)
    SELECT market, round(AVG(e), 6) AS mean, round(stddev_samp(e), 6) AS sd, round(quantile_cont(e, 0.05), 6) AS p05,
    round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.95), 6) AS p95 FROM grouped GROUP BY 1""",
)
def residual_summary(spark, sf):
    perf = S.perf(spark, sf).select("market", "chart_score").withColumn("_one", F.lit(1))
    mean = perf.groupBy("_one").agg(F.avg("chart_score").alias("m"))
    rows = perf.join(F.broadcast(mean), "_one").select("market", (F.col("chart_score") - F.col("m")).alias("e"))
    out = profile.describe(profile.with_overall(rows, "market"), ["market"], "e", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    # a mean of residuals is zero up to rounding noise; adding 0.0 turns -0.0 into 0.0
    return out.select(
        "market", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("std", 6).alias("sd"),
        *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")],
    )


@PLANS.add(
    "agg_31_medians_and_sds",
    f"""WITH {D.DATASET} SELECT market, round(quantile_cont(tempo_bpm, 0.5), 6) AS tempo_bpm_median, round(stddev_samp(tempo_bpm), 6) AS tempo_bpm_sd,
    round(quantile_cont(word_count, 0.5), 6) AS word_count_median, round(stddev_samp(word_count), 6) AS word_count_sd
    FROM dataset GROUP BY 1""",
)
def medians_and_sds(spark, sf):
    long = order.unpivot(D.modeling(spark, sf), ["market"], ["tempo_bpm", "word_count"])
    stats = profile.describe(long, ["market", "feature"], quantiles={"median": 0.5})
    wide = stats.groupBy("market").pivot("feature", ["tempo_bpm", "word_count"]).agg(
        F.round(F.first("median"), 6).alias("median"), F.round(F.first("std"), 6).alias("sd")
    )
    return wide


@PLANS.add(
    "agg_32_training_quantiles",
    f"""WITH {S.AUDIO}, long AS (SELECT 'tempo_bpm' AS feature, tempo_bpm AS v FROM audio UNION ALL SELECT 'rms_energy', rms_energy FROM audio)
    SELECT feature, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.99), 6) AS p99
    FROM long GROUP BY 1""",
)
def training_quantiles(spark, sf):
    long = order.unpivot(S.audio(spark, sf), [], ["tempo_bpm", "rms_energy"])
    out = order.exact_quantiles(long, ["feature"], "value", [0.5, 0.01, 0.99], ["median", "p01", "p99"])
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("median", "p01", "p99")])


def _digest_part(i: int) -> str:
    return f"CAST(SUM(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)"


@PLANS.add(
    "agg_33_fingerprint",
    f"""WITH {S.PERF}, c AS (SELECT *, CAST(round(chart_score * 1000000) AS BIGINT) AS score FROM perf),
    d AS (SELECT sha256(concat_ws(chr(31), track, market, score, peak_rank, weeks_on_chart)) AS h FROM c)
    SELECT COUNT(*) AS n_rows, sha256(concat_ws('|', COUNT(*), {", ".join(_digest_part(i) for i in range(4))})) AS fingerprint FROM d""",
)
def fingerprint(spark, sf):
    # millionths as whole numbers: engines print them alike, unlike fractions
    rows = S.perf(spark, sf).withColumn("score", F.round(F.col("chart_score") * 1000000).cast("bigint"))
    return profile.fingerprint(rows, ["track", "market"], ["score", "peak_rank", "weeks_on_chart"])


@PLANS.add(
    "agg_34_report_registry",
    f"""WITH {S.PERF}, a AS (SELECT market, COUNT(*) AS n, MIN(peak_rank) AS best FROM perf GROUP BY 1),
    b AS (SELECT album, COUNT(*) AS n FROM (SELECT p_type AS album FROM part) GROUP BY 1)
    SELECT 'perf' AS source, market AS row, 'n' AS "column", CAST(n AS DOUBLE) AS value FROM a
    UNION ALL SELECT 'perf', market, 'best', CAST(best AS DOUBLE) FROM a UNION ALL SELECT 'songs', album, 'n', CAST(n AS DOUBLE) FROM b""",
)
def report_registry(spark, sf):
    a = S.perf(spark, sf).groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.min("peak_rank").alias("best"))
    b = S.songs(spark, sf).groupBy("album").agg(F.count(F.lit(1)).alias("n"))
    return profile.registry_rows(a, "perf", F.col("market"), ["n", "best"]).unionByName(
        profile.registry_rows(b, "songs", F.col("album"), ["n"])
    )


@PLANS.add(
    "agg_36_quantile_bands",
    """WITH e AS (SELECT event_type, value FROM events UNION ALL SELECT 'ALL', value FROM events)
    SELECT event_type, COUNT(*) AS n, round(MIN(value), 2) AS min, round(quantile_cont(value, 0.25), 2) AS q1, round(quantile_cont(value, 0.5), 2) AS median,
    round(quantile_cont(value, 0.75), 2) AS q3, round(quantile_cont(value, 0.78), 2) AS p78, round(quantile_cont(value, 0.9), 2) AS p90,
    round(MAX(value), 2) AS max, round(AVG(value), 2) AS mean, round(stddev_samp(value), 2) AS std FROM e GROUP BY 1""",
)
def quantile_bands(spark, sf):
    out = score.quantile_bands(S.table(spark, sf, "events"), "event_type", "value", overall="ALL")
    return out.select("event_type", "n", *[F.round(c, 2).alias(c) for c in out.columns if c not in ("event_type", "n")])


@PLANS.add(
    "agg_37_mean_with_interval",
    f"""WITH {S.LYRICS} SELECT language, round(AVG(repetition_ratio), 6) AS mean, round(1.96 * stddev_samp(repetition_ratio) / sqrt(COUNT(repetition_ratio)), 6) AS half_width,
    round(quantile_cont(repetition_ratio, 0.5), 6) AS median, COUNT(repetition_ratio) AS valid, COUNT(*) AS total,
    COUNT(*) FILTER (WHERE title_word_in_lyrics) AS true_n, COUNT(*) FILTER (WHERE NOT title_word_in_lyrics) AS false_n,
    COUNT(*) FILTER (WHERE title_word_in_lyrics IS NULL) AS null_n FROM lyric_rows GROUP BY 1""",
)
def mean_with_interval(spark, sf):
    rows = S.lyric_rows(spark, sf)
    flag, x = F.col("title_word_in_lyrics"), "repetition_ratio"
    basic = rows.groupBy("language").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(1.96 * F.stddev_samp(x) / F.sqrt(F.count(x)), 6).alias("half_width"),
        F.count(x).alias("valid"), F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("true_n"),
        F.count_if(~flag).alias("false_n"), F.count_if(flag.isNull()).alias("null_n"),
    )
    median = order.exact_quantiles(rows, ["language"], x, [0.5], ["median"])
    return basic.join(median, "language", "left").withColumn("median", F.round("median", 6))


@PLANS.add(
    "agg_38_rank_against_uniform",
    f"""WITH {S.WEEKLY} SELECT market, rank, COUNT(*) AS n, round(SUM(COUNT(*)) OVER (PARTITION BY market) / 200.0, 6) AS expected FROM weekly GROUP BY 1, 2""",
)
def rank_against_uniform(spark, sf):
    ranked = S.weekly(spark, sf).select("market", F.col("rank").cast("bigint").alias("rank"))
    freq = profile.frequency(ranked, "market", "rank")
    return freq.select("market", "rank", "n", F.round(F.col("group_total") / F.lit(200.0), 6).alias("expected"))


@PLANS.add(
    "win_02_group_quantile_flag",
    """SELECT event_id, event_type, value >= q AS in_top FROM events JOIN (SELECT event_type AS t, quantile_cont(value, 0.78) AS q FROM events GROUP BY 1)
    ON t = event_type""",
)
def group_quantile_flag(spark, sf):
    events = S.table(spark, sf, "events").select("event_id", "event_type", "value")
    marked = order.with_quantiles(events, ["event_type"], "value", [0.78], ["q"])
    return marked.select("event_id", "event_type", (F.col("value") >= F.col("q")).alias("in_top"))


@PLANS.add(
    "prj_16_winsor_log_clip",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS q01 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(l_extendedprice, q01), 6) AS floored, round(ln(1 + l_quantity), 6) AS logged,
    round(least(greatest(l_extendedprice / 1000 - 40, -30), 40), 6) AS clipped FROM lineitem, q""",
)
def winsor_log_clip(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    q = order.exact_quantiles(line, [], "l_extendedprice", [0.01], ["q01"]).withColumn("_one", F.lit(1))
    joined = line.withColumn("_one", F.lit(1)).join(F.broadcast(q), "_one")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(clean.clip("l_extendedprice", low=F.col("q01")), 6).alias("floored"),
        F.round(F.log1p("l_quantity"), 6).alias("logged"),
        F.round(clean.clip(F.col("l_extendedprice") / 1000 - 40, -30.0, 40.0), 6).alias("clipped"),
    )


@PLANS.add(
    "prj_18_quantile_tiers",
    f"""WITH {S.PERF}, q AS (SELECT quantile_cont(chart_score, 0.25) AS a, quantile_cont(chart_score, 0.75) AS b FROM perf)
    SELECT track, market, CASE WHEN chart_score >= b THEN 'High' WHEN chart_score <= a THEN 'Low' ELSE 'Medium' END AS tier FROM perf, q""",
)
def quantile_tiers(spark, sf):
    perf = S.perf(spark, sf).select("track", "market", "chart_score")
    q = order.exact_quantiles(perf, [], "chart_score", [0.25, 0.75], ["a", "b"]).withColumn("_one", F.lit(1))
    joined = perf.withColumn("_one", F.lit(1)).join(F.broadcast(q), "_one")
    s = F.col("chart_score")
    return joined.select("track", "market", F.when(s >= F.col("b"), "High").when(s <= F.col("a"), "Low").otherwise("Medium").alias("tier"))


@PLANS.add(
    "prj_20_valid_observations",
    f"""WITH {S.LYRICS} SELECT track, language, CAST(chorus_repetition_count AS DOUBLE) AS value FROM lyric_rows WHERE chorus_repetition_count IS NOT NULL""",
)
def valid_observations(spark, sf):
    rows = S.lyric_rows(spark, sf).select("track", "language", F.col("chorus_repetition_count").cast("double").alias("value"))
    return rows.dropna(subset=["value"])


# ---- scores ----------------------------------------------------------------------------------------

@PLANS.add(
    "scl_01_score_tier",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s >= 37.58 THEN 'Tier 1' WHEN s >= 15.16 THEN 'Tier 2' WHEN s >= -11.93 THEN 'Tier 3' ELSE 'Tier 4' END AS tier
    FROM (SELECT *, 101 - l_extendedprice / 500 AS s FROM lineitem)""",
)
def score_tier(spark, sf):
    s = F.lit(101) - F.col("l_extendedprice") / 500
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", score.score_tier(s).alias("tier"))


@PLANS.add(
    "scl_03_fit_profile",
    """WITH e AS (SELECT event_type, value FROM events WHERE event_type <> 'error' UNION ALL SELECT 'ALL', value FROM events),
    b AS (SELECT event_type AS market, MIN(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
      quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.78) AS p78, quantile_cont(value, 0.9) AS p90, MAX(value) AS max FROM e GROUP BY 1)
    SELECT event_id, b.market AS reference_market, s >= p78 AS is_top22,
      CASE WHEN s >= q3 THEN 'Tier 1' WHEN s >= median THEN 'Tier 2' WHEN s >= q1 THEN 'Tier 3' ELSE 'Tier 4' END AS tier
    FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'ALL' ELSE event_type END AS m, value * 0.9 + 3 AS s FROM events) x JOIN b ON b.market = x.m""",
)
def fit_profile(spark, sf):
    events = S.table(spark, sf, "events").select("event_id", F.col("event_type").alias("market"), "value")
    known = profile.with_overall(events, "market").where("market <> 'error'")
    bands = score.quantile_bands(known, "market", "value")
    scores = events.select("event_id", "market", (F.col("value") * 0.9 + 3).alias("s"))
    return score.fit_profile(scores, bands, "s", "market").select("event_id", "reference_market", "is_top22", "tier")


@PLANS.add(
    "scl_04_gap_category",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, 1 + CAST(l_quantity AS INTEGER) % 4 AS a, 1 + CAST(l_partkey AS INTEGER) % 4 AS f FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = 1 AND f = 1 THEN 'consensus_hit' WHEN a = 1 THEN 'superstar' WHEN a >= 3 AND f = 1 THEN 'sleeper'
    WHEN a = 4 AND f = 4 THEN 'atypical' ELSE 'mainstream' END AS gap FROM t""",
)
def gap_category(spark, sf):
    line = S.table(spark, sf, "lineitem")
    actual = F.concat(F.lit("Tier "), (1 + F.col("l_quantity").cast("int") % 4).cast("string"))
    fit = F.concat(F.lit("Tier "), (1 + F.col("l_partkey") % 4).cast("string"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", score.gap_category(actual, fit).alias("gap"))


@PLANS.add(
    "scl_05_min_max_scaled",
    """WITH r AS (SELECT MIN(p_retailprice) AS a, MAX(p_retailprice) AS b FROM part)
    SELECT p_partkey, round((p_retailprice - a) / (b - a), 6) AS price, 0.5 AS flat FROM part, r""",
)
def min_max_scaled(spark, sf):
    part = S.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.lit(3.0).alias("flat"))
    return profile.min_max_scaled(part, ["price", "flat"]).withColumn("price", F.round("price", 6))


@PLANS.add(
    "scl_06_error_columns",
    """SELECT o_orderkey, round(o_totalprice - 250000, 4) AS error, round(abs(o_totalprice - 250000), 4) AS absolute_error FROM orders""",
)
def error_columns(spark, sf):
    e = F.col("o_totalprice") - 250000
    return S.table(spark, sf, "orders").select("o_orderkey", F.round(e, 4).alias("error"), F.round(F.abs(e), 4).alias("absolute_error"))


@PLANS.add(
    "scl_07_evidence_tiers_and_stars",
    """WITH t AS (SELECT event_id, value / 500 AS p FROM events)
    SELECT event_id, CASE WHEN p * 3 < 0.05 THEN 'confirmed' WHEN p * 1.5 < 0.05 THEN 'suggestive' WHEN p < 0.05 THEN 'nominal' ELSE 'none' END AS tier,
    CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars,
    CASE WHEN p >= 0.14 THEN 'large' WHEN p >= 0.06 THEN 'medium' WHEN p >= 0.01 THEN 'small' ELSE 'negligible' END AS effect FROM t""",
)
def evidence(spark, sf):
    p = F.col("value") / 500
    return S.table(spark, sf, "events").select(
        "event_id", score.evidence_tier(p, p * 3, p * 1.5).alias("tier"), score.stars(p).alias("stars"),
        score.effect_size(p).alias("effect"),
    )


@PLANS.add(
    "scl_09_heuristic_scores",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'US' WHEN 'N' THEN 'KR' ELSE 'VN' END AS m,
      l_discount * 5 AS e, l_extendedprice / 20 AS c, l_quantity / 50 AS r FROM lineitem),
    u AS (SELECT *, CASE m WHEN 'US' THEN 12.67 WHEN 'KR' THEN 1.09 ELSE -2.12 END AS base,
      CASE m WHEN 'KR' THEN (e - 0.25) * 45 + (c - 2380) / 440 * 8.5 WHEN 'VN' THEN -(e - 0.22) * 35 - (c - 2150) / 440 * 7.2 ELSE (r - 0.6) * 12 END AS eff FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, round(base + eff, 9) AS linear_score, round(base + tanh(eff / 15) * 12, 9) AS saturated_score FROM u""",
)
def heuristic_scores(spark, sf):
    flag = F.col("l_returnflag")
    market = F.when(flag == "A", "US").when(flag == "N", "KR").otherwise("VN")
    a, b = score.heuristic_scores(market, F.col("l_discount") * 5, F.col("l_extendedprice") / 20, F.col("l_quantity") / 50)
    return S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(a, 9).alias("linear_score"), F.round(b, 9).alias("saturated_score")
    )


@PLANS.add(
    "scl_10_interval_contains_zero",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round(value - 100, 2) END AS low, CASE WHEN event_id % 7 <> 0 THEN round(value - 50, 2) END AS high,
    CASE WHEN event_id % 7 <> 0 THEN round(value - 100, 2) <= 0 AND round(value - 50, 2) >= 0 END AS has_zero FROM events""",
)
def interval_contains_zero(spark, sf):
    e = S.table(spark, sf, "events")
    v = F.col("value")
    text = F.when(F.col("event_id") % 7 != 0, F.format_string("[%.2f, %.2f]", v - 100, v - 50)).otherwise("[nan]")
    low, high, zero = score.interval_bounds(text)
    return e.select("event_id", low.alias("low"), high.alias("high"), zero.alias("has_zero"))


@PLANS.add(
    "scl_11_display_values",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE printf('%.3f', value) END AS shown,
    CASE WHEN value / 4999 < 0.001 THEN '< 0.001' ELSE printf('%.3f', value / 4999) END AS p_shown FROM events""",
)
def display_values(spark, sf):
    v = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    return S.table(spark, sf, "events").select(
        "event_id", score.display_number(v).alias("shown"), score.display_p(F.col("value") / 4999).alias("p_shown")
    )
