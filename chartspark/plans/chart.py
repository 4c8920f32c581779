"""Weekly chart queries: cleaning, performance, sampling, ranking, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions import clean
from chartspark.operators import chart, order, profile
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook

PLANS = PlanBook()


def _with(cte: str, body: str) -> str:
    return f"WITH {cte} {body}"


@PLANS.add(
    "agg_01_chart_performance",
    _with(S.PERF, """SELECT track, market, round(lifetime_average_rank, 6) AS lifetime_average_rank,
    round(chart_score, 6) AS chart_score, peak_rank, weeks_on_chart, weeks_in_top10 FROM perf"""),
)
def chart_performance(spark, sf):
    return S.perf(spark, sf).select(
        "track", "market", F.round("lifetime_average_rank", 6).alias("lifetime_average_rank"),
        F.round("chart_score", 6).alias("chart_score"), F.col("peak_rank").cast("bigint").alias("peak_rank"),
        "weeks_on_chart", "weeks_in_top10",
    )


@PLANS.add("shape_weekly_chart", _with(S.WEEKLY, "SELECT track, market, chart_date, streams, rank FROM weekly"))
def weekly_chart(spark, sf):
    return S.weekly(spark, sf).select("track", "market", "chart_date", "streams", F.col("rank").cast("bigint").alias("rank"))


@PLANS.add("agg_02_best_quarter_rank", _with(S.QUARTER, "SELECT market, quarter, track, rank FROM quarter_rank"))
def best_quarter_rank(spark, sf):
    return S.quarter_rank(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))


@PLANS.add(
    "agg_03_grouped_counts_shortage",
    _with(S.SAMPLE, """SELECT market, quarter, COUNT(*) AS n_rows, COUNT(DISTINCT track) AS n_tracks
    FROM sample GROUP BY 1, 2 HAVING COUNT(*) < 40"""),
)
def grouped_counts(spark, sf):
    counts = S.sample(spark, sf).groupBy("market", "quarter").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("track").alias("n_tracks")
    )
    return counts.where("n_rows < 40")


@PLANS.add(
    "agg_04_unify_markets",
    _with(S.PERF, """SELECT track, string_agg(market, ';' ORDER BY market) AS markets, MAX(weeks_on_chart) AS max_weeks,
    arg_min(weeks_in_top10, market) AS first_top10 FROM perf GROUP BY 1"""),
)
def unify_markets(spark, sf):
    return (
        S.perf(spark, sf)
        .groupBy("track")
        .agg(
            F.array_join(F.array_sort(F.collect_set("market")), ";").alias("markets"),
            F.max("weeks_on_chart").alias("max_weeks"),
            F.min_by("weeks_in_top10", "market").alias("first_top10"),
        )
        .orderBy(F.desc("max_weeks"), "track")
    )


@PLANS.add(
    "agg_29_weekly_record_counts",
    _with(S.WEEKLY, """SELECT market, round(AVG(n), 6) AS mean_n, MIN(n) AS min_n, MAX(n) AS max_n
    FROM (SELECT market, chart_date, COUNT(*) AS n FROM weekly GROUP BY 1, 2) GROUP BY 1"""),
)
def weekly_record_counts(spark, sf):
    weeks = S.weekly(spark, sf).groupBy("market", "chart_date").agg(F.count(F.lit(1)).alias("n"))
    return weeks.groupBy("market").agg(
        F.round(F.avg("n"), 6).alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n")
    )


# ---- projections -------------------------------------------------------------------------------

_DATE_TEXTS_SQL = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
  WHEN 3 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' WHEN 4 THEN strftime(o_orderdate, '%d.%m.%Y') END AS raw
  FROM orders"""


def _date_texts(spark, sf):
    o = S.table(spark, sf, "orders")
    d = F.col("o_orderdate")
    case = F.col("o_orderkey") % 6
    raw = (
        F.when(case == 0, F.date_format(d, "yyyy"))
        .when(case == 1, F.date_format(d, "yyyy-MM"))
        .when(case == 2, F.date_format(d, "yyyy/MM/dd"))
        .when(case == 3, F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd"), F.lit(" ")))
        .when(case == 4, F.date_format(d, "dd.MM.yyyy"))
    )
    return o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


@PLANS.add(
    "prj_01_repair_date",
    rf"""WITH t AS ({_DATE_TEXTS_SQL}), u AS (SELECT id, replace(trim(raw), '/', '-') AS x FROM t)
    SELECT id, CASE WHEN regexp_full_match(x, '\d{{4}}') THEN x || '-01-01'
      WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}') THEN x || '-01'
      WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}') THEN x END AS repaired FROM u""",
)
def repair_date(spark, sf):
    return _date_texts(spark, sf).select("id", clean.repair_date("raw").alias("repaired"))


@PLANS.add(
    "prj_02_quarter_label",
    rf"""WITH t AS ({_DATE_TEXTS_SQL}), u AS (SELECT id, replace(trim(raw), '/', '-') AS x FROM t),
    v AS (SELECT id, CAST(CASE WHEN regexp_full_match(x, '\d{{4}}') THEN x || '-01-01'
      WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}') THEN x || '-01'
      WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}') THEN x END AS DATE) AS day FROM u)
    SELECT id, CAST(year(day) AS INTEGER) AS year, CAST(year(day) AS VARCHAR) || '-Q' || CAST(quarter(day) AS VARCHAR) AS quarter
    FROM v""",
)
def quarter_labels(spark, sf):
    day = clean.lenient_date(clean.repair_date("raw"))
    return _date_texts(spark, sf).select("id", day.alias("d")).select(
        "id", F.year("d").alias("year"), clean.quarter_label("d").alias("quarter")
    )


@PLANS.add(
    "prj_03_coercion",
    """WITH t AS (SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'n/a'
      WHEN 2 THEN '' WHEN 3 THEN '+' || CAST(event_id AS VARCHAR) || 's' ELSE CAST(event_id AS VARCHAR) END AS num,
      CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN ' 0 ' WHEN 2 THEN 'yes' END AS flag,
      CASE event_id % 3 WHEN 0 THEN '["a","' || event_type || '"]' WHEN 1 THEN 'broken' END AS list FROM events)
    SELECT id, TRY_CAST(CASE WHEN id % 5 = 3 THEN CAST(id AS VARCHAR) ELSE num END AS DOUBLE) AS number,
      CASE id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag,
      CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS list_size FROM t""",
)
def coercion(spark, sf):
    e = S.table(spark, sf, "events")
    i = F.col("event_id")
    text = i.cast("string")
    num = (
        F.when(i % 5 == 0, F.col("value").cast("string")).when(i % 5 == 1, "n/a").when(i % 5 == 2, "")
        .when(i % 5 == 3, F.concat(F.lit("+"), text, F.lit("s"))).otherwise(text)
    )
    flag = F.when(i % 4 == 0, "True").when(i % 4 == 1, " 0 ").when(i % 4 == 2, "yes")
    items = F.when(i % 3 == 0, F.concat(F.lit('["a","'), F.col("event_type"), F.lit('"]'))).when(i % 3 == 1, "broken")
    return e.select(i.alias("id"), num.alias("num"), flag.alias("f"), items.alias("l")).select(
        "id", clean.to_float("num", strip_marks=True).alias("number"), clean.to_flag("f").alias("flag"),
        F.size(clean.to_text_list("l")).alias("list_size"),
    )


@PLANS.add(
    "prj_04_clean_fact",
    """WITH raw AS (SELECT l_orderkey, l_linenumber, l_returnflag AS market, CAST(l_quantity AS INTEGER) AS rank,
      CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_shipdate AS DATE) END AS chart_date,
      row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, CAST(l_quantity AS INTEGER), CAST(l_shipdate AS DATE)) AS place FROM lineitem)
    SELECT l_orderkey, market, l_linenumber, rank, chart_date FROM raw
    WHERE place = 1 AND market IN ('A', 'N') AND rank BETWEEN 1 AND 40 AND chart_date IS NOT NULL""",
)
def clean_fact(spark, sf):
    """An order's lines of one flag are one key; the line with the smallest number is its first row."""
    raw = S.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("market"), F.col("l_quantity").cast("int").alias("rank"),
        F.when(F.col("l_orderkey") % 17 != 0, F.to_date("l_shipdate")).alias("chart_date"),
    )
    kept = chart.clean_fact(raw, ["l_orderkey", "market"], markets=["A", "N"], rank_range=(1, 40), order_by=["l_linenumber", "rank", "chart_date"])
    return kept.select("l_orderkey", "market", "l_linenumber", "rank", "chart_date")


@PLANS.add(
    "prj_05_derived_columns",
    """SELECT l_partkey AS track, round(101 - AVG(l_quantity), 6) AS score,
      round(1 / (1 + stddev_pop(l_quantity)), 6) AS stability,
      round(20 * log10(greatest(AVG(l_discount), 1e-10)), 6) AS loudness, CAST(year(MIN(l_shipdate)) AS INTEGER) AS release_year
    FROM lineitem GROUP BY 1""",
)
def derived_columns(spark, sf):
    base = S.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("track")).agg(
        F.avg("l_quantity").alias("r"), F.stddev_pop("l_quantity").alias("v"), F.avg("l_discount").alias("e"),
        F.year(F.min("l_shipdate")).alias("release_year"),
    )
    return base.select(
        "track", F.round(clean.chart_score("r"), 6).alias("score"), F.round(clean.tempo_stability("v"), 6).alias("stability"),
        F.round(clean.decibel("e"), 6).alias("loudness"), "release_year",
    )


@PLANS.add(
    "prj_17_bins",
    _with(S.PERF, """SELECT track, market,
    CASE WHEN peak_rank BETWEEN 1 AND 10 THEN '1-10' WHEN peak_rank BETWEEN 11 AND 20 THEN '11-20'
         WHEN peak_rank BETWEEN 21 AND 50 THEN '21-50' WHEN peak_rank >= 51 THEN '51+' END AS stratum,
    CASE WHEN weeks_on_chart >= 1 AND weeks_on_chart < 2 THEN '1' WHEN weeks_on_chart >= 2 AND weeks_on_chart < 5 THEN '2-4'
         WHEN weeks_on_chart >= 5 AND weeks_on_chart < 13 THEN '5-12' WHEN weeks_on_chart >= 13 THEN '13+' END AS tenure FROM perf"""),
)
def bins(spark, sf):
    return S.perf(spark, sf).select(
        "track", "market", clean.closed_range_label("peak_rank", chart.RANK_STRATA).alias("stratum"),
        clean.left_closed_bin("weeks_on_chart", [1, 2, 5, 13], ["1", "2-4", "5-12", "13+"], open_last=True).alias("tenure"),
    )


# ---- windows, top-k ------------------------------------------------------------------------------

@PLANS.add(
    "win_01_share_of_total",
    _with(S.PERF, """SELECT market, COUNT(*) AS n, round(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS pct
    FROM perf GROUP BY 1"""),
)
def share_of_total(spark, sf):
    counts = S.perf(spark, sf).groupBy("market").agg(F.count(F.lit(1)).alias("n"))
    # the window runs over one row per market
    total = F.sum("n").over(order.W.partitionBy(F.lit(1)))
    return counts.select("market", "n", F.round(F.lit(100.0) * F.col("n") / total, 6).alias("pct"))


@PLANS.add(
    "win_03_first_row_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p = 1""",
)
def first_row(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return order.first_per_key(orders, ["o_custkey"], ["o_orderkey"])


@PLANS.add(
    "win_04_stratified_sample",
    _with(S.SAMPLE, "SELECT track, market, year, quarter, rank_stratum, sampled FROM sample"),
)
def stratified_sample(spark, sf):
    return S.sample(spark, sf)


@PLANS.add(
    "win_04_stratum_shortage",
    _with(S.SAMPLE, """, labels AS (SELECT * FROM (VALUES ('1-10'), ('11-20'), ('21-50'), ('51+')) v(rank_stratum)),
    groups AS (SELECT DISTINCT market, quarter FROM strata)
    SELECT g.market, g.quarter, l.rank_stratum, COUNT(s.track) AS n_available, 10 - COUNT(s.track) AS n_missing
    FROM groups g CROSS JOIN labels l LEFT JOIN strata s
      ON s.market = g.market AND s.quarter = g.quarter AND s.rank_stratum = l.rank_stratum
    GROUP BY 1, 2, 3 HAVING COUNT(s.track) < 10"""),
)
def stratum_shortage(spark, sf):
    return chart.stratum_shortage(S.quarter_rank(spark, sf), ["market", "quarter"])


@PLANS.add(
    "win_10_exclusive_items",
    _with(S.PERF, """SELECT p.track, p.market, n.n_markets, n.n_markets = 1 AS exclusive FROM perf p
    JOIN (SELECT track, COUNT(DISTINCT market) AS n_markets FROM perf GROUP BY 1) n ON n.track = p.track"""),
)
def exclusive_items(spark, sf):
    perf = S.perf(spark, sf).select("track", "market")
    counts = perf.groupBy("track").agg(F.countDistinct("market").alias("n_markets"))
    return perf.join(counts, "track").withColumn("exclusive", F.col("n_markets") == 1)


@PLANS.add(
    "win_11_duplicate_flags",
    """SELECT l_orderkey, l_linenumber, l_partkey, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies,
    COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS duplicated FROM lineitem""",
)
def duplicate_flags(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    key = ["l_orderkey", "l_linenumber"]
    counts = line.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    return line.join(counts, key).withColumn("duplicated", F.col("copies") > 1)


@PLANS.add(
    "top_01_largest_deviation",
    _with(S.PERF, """, m AS (SELECT AVG(chart_score) AS mean FROM perf)
    SELECT track, market, round(abs(chart_score - mean), 6) AS deviation FROM perf, m
    ORDER BY round(abs(chart_score - mean), 6) DESC, track, market LIMIT 20"""),
)
def largest_deviation(spark, sf):
    perf = S.perf(spark, sf)
    mean = perf.agg(F.avg("chart_score").alias("mean")).withColumn("_one", F.lit(1))
    joined = perf.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
    return (
        joined.select("track", "market", F.round(F.abs(F.col("chart_score") - F.col("mean")), 6).alias("deviation"))
        .orderBy(F.desc("deviation"), "track", "market")
        .limit(20)
    )


@PLANS.add(
    "top_03_mixed_order_rank_export",
    _with(S.PERF, """SELECT track, market, peak_rank, weeks_on_chart FROM perf
    ORDER BY market ASC, weeks_on_chart DESC, track ASC"""),
)
def mixed_order(spark, sf):
    return (
        S.perf(spark, sf)
        .select("track", "market", F.col("peak_rank").cast("bigint").alias("peak_rank"), "weeks_on_chart")
        .orderBy(F.asc("market"), F.desc("weeks_on_chart"), F.asc("track"))
    )


@PLANS.add(
    "top_04_next_unprocessed",
    """SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49.0)
    ORDER BY p_partkey LIMIT 500""",
)
def next_unprocessed(spark, sf):
    parts = S.table(spark, sf, "part").select("p_partkey")
    done = S.table(spark, sf, "lineitem").where("l_quantity >= 49.0").select(F.col("l_partkey").alias("p_partkey"))
    return parts.join(done, "p_partkey", "left_anti").orderBy("p_partkey").limit(500)


# ---- set operations --------------------------------------------------------------------------------


def _shards(spark, sf):
    sales = S.weekly(spark, sf).select("track", "market", "chart_date", "rank")
    return sales.where("chart_date < date '1999-01-01'"), sales.where("chart_date >= date '1998-07-01'")


@PLANS.add(
    "set_01_union_shards",
    _with(S.WEEKLY, """, u AS (SELECT track, market, chart_date FROM weekly WHERE chart_date < DATE '1999-01-01'
    UNION ALL SELECT track, market, chart_date FROM weekly WHERE chart_date >= DATE '1998-07-01')
    SELECT COUNT(*) AS n_rows, (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM u)) AS n_distinct,
      COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM u)) AS overlap FROM u"""),
)
def union_shards(spark, sf):
    a, b = _shards(spark, sf)
    key = ["track", "market", "chart_date"]
    copies = a.unionByName(b).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn(
        "overlap", F.col("n_rows") - F.col("n_distinct")
    )


@PLANS.add(
    "set_02_disjoint_union",
    """WITH a AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size <= 25),
    b AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size > 25)
    SELECT (SELECT COUNT(*) FROM a) + (SELECT COUNT(*) FROM b) AS n_rows,
      (SELECT COUNT(*) FROM a WHERE k IN (SELECT k FROM b)) AS overlap,
      (SELECT COUNT(*) FROM part WHERE p_retailprice IS NULL) AS nulls,
      (SELECT COUNT(*) FROM part WHERE p_retailprice NOT BETWEEN 900 AND 1100) AS outside""",
)
def disjoint_union(spark, sf):
    from chartspark.operators.quality import disjoint_union_report

    part = S.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"), "p_size")
    a, b = part.where("p_size <= 25").drop("p_size"), part.where("p_size > 25").drop("p_size")
    return disjoint_union_report(a, b, "k", "v", 900, 1100)


@PLANS.add(
    "set_03_symmetric_difference",
    """SELECT track, CASE WHEN in_a THEN 'only_first' ELSE 'only_second' END AS side FROM (
      SELECT coalesce(a.k, b.k) AS track, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b FROM
      (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 3) a FULL JOIN
      (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.095) b ON a.k = b.k)
    WHERE in_a <> in_b""",
)
def symmetric_difference(spark, sf):
    line = S.table(spark, sf, "lineitem")
    flags = line.groupBy(F.col("l_partkey").alias("track")).agg(
        F.bool_or(F.col("l_quantity") < 3).alias("a"), F.bool_or(F.col("l_discount") > 0.095).alias("b")
    )
    return flags.where("a <> b").select("track", F.when(F.col("a"), "only_first").otherwise("only_second").alias("side"))


@PLANS.add(
    "set_05_values_outside_allowed",
    """SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""",
)
def values_outside(spark, sf):
    return S.table(spark, sf, "events").where(~F.col("event_type").isin("view", "click", "purchase")).select("event_type").distinct()
