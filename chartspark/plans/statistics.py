"""Statistics queries: rank and contingency tests, correlation, collinearity, diagnostics, screeners."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.operators import bootstrap, influence, linear, order, quality, stats
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook

PLANS = PlanBook()

FEATURES = ["l_quantity", "l_discount", "l_tax"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS market, {c} AS value FROM lineitem" for c in FEATURES)
_RANKS = f"""long AS ({_LONG}), counts AS (SELECT feature, value, COUNT(*) AS t FROM long GROUP BY 1, 2),
ranks AS (SELECT feature, value, t, SUM(t) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2 AS r,
  SUM(t) OVER (PARTITION BY feature) AS n FROM counts)"""
_KW = f"""{_RANKS}, g AS (SELECT l.feature, market, COUNT(*) AS c, SUM(r) AS s FROM long l JOIN ranks k ON k.feature = l.feature AND k.value = l.value GROUP BY 1, 2),
tie AS (SELECT feature, CAST(any_value(n) AS DOUBLE) AS n, SUM(CAST(t AS DOUBLE) ** 3 - t) AS ties FROM ranks GROUP BY 1),
h AS (SELECT g.feature, COUNT(*) AS k, any_value(n) AS n, (12 / (any_value(n) * (any_value(n) + 1)) * SUM(s * s / c) - 3 * (any_value(n) + 1))
  / (1 - any_value(ties) / (any_value(n) ** 3 - any_value(n))) AS h FROM g JOIN tie ON tie.feature = g.feature GROUP BY 1)"""


def _long(spark, sf):
    line = S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("market"), *FEATURES)
    return order.unpivot(line, ["market"], FEATURES)


@PLANS.add(
    "sta_01_kruskal_wallis",
    f"""WITH {_KW}, p AS (SELECT *, exp(-h / 2) AS p FROM h), o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, COUNT(*) OVER () AS m FROM p)
    SELECT feature, k AS n_groups, CAST(n AS BIGINT) AS n_total, round(h, 5) AS h, round(p, 6) AS p_value,
    round(least(1, MAX((m - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) AS p_holm, round((h - k + 1) / (n - k), 8) AS epsilon_squared FROM o""",
)
def kruskal_wallis(spark, sf):
    out = stats.kruskal_wallis(_long(spark, sf), "feature", "market", "value")
    return out.select(
        "feature", "n_groups", "n_total", F.round("h", 5).alias("h"), F.round("p_value", 6).alias("p_value"),
        F.round("p_holm", 6).alias("p_holm"), F.round("epsilon_squared", 8).alias("epsilon_squared"),
    )


@PLANS.add(
    "win_08_average_rank",
    """WITH c AS (SELECT l_quantity AS value, COUNT(*) AS n FROM lineitem GROUP BY 1)
    SELECT value, n, round(CAST(SUM(n) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - n AS DOUBLE) + (n + 1) / 2, 6) AS average_rank FROM c""",
)
def average_rank(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(F.lit("all").alias("g"), F.col("l_quantity").alias("value"))
    out = order.average_ranks(rows, ["g"], "value")
    return out.select("value", "n", F.round("average_rank", 6).alias("average_rank"))


_TABLE = """t AS (SELECT l_returnflag AS a, CASE WHEN l_quantity < 11 THEN 'low' WHEN l_quantity < 31 THEN 'middle' ELSE 'high' END AS b FROM lineitem),
cells AS (SELECT a, b, COUNT(*) AS o, SUM(COUNT(*)) OVER (PARTITION BY a) AS r, SUM(COUNT(*)) OVER (PARTITION BY b) AS c, SUM(COUNT(*)) OVER () AS n FROM t GROUP BY 1, 2)"""


def _table(spark, sf):
    q = F.col("l_quantity")
    return S.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("a"), F.when(q < 11, "low").when(q < 31, "middle").otherwise("high").alias("b")
    )


@PLANS.add(
    "sta_02_chi_square",
    f"""WITH {_TABLE}, x AS (SELECT CAST(any_value(n) AS BIGINT) AS n, SUM((o - r * c / n) ** 2 / (r * c / n)) AS x FROM cells)
    SELECT n, round(x, 6) AS chi_square, 4 AS df, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value, round(sqrt(x / (n * 2)), 8) AS cramers_v FROM x""",
)
def chi_square(spark, sf):
    out = stats.chi_square(_table(spark, sf), "a", "b")
    return out.select(
        "n", F.round("chi_square", 6).alias("chi_square"), "df", F.round("p_value", 6).alias("p_value"), F.round("cramers_v", 8).alias("cramers_v")
    )


@PLANS.add(
    "sta_02_expected_counts",
    f"""WITH {_TABLE} SELECT a, b, o AS observed, round(r * c / n, 6) AS expected, round(o * 100.0 / r, 6) AS row_percent FROM cells""",
)
def expected_counts(spark, sf):
    out = stats.expected_counts(_table(spark, sf), "a", "b", ["low", "middle", "high"])
    return out.withColumn("expected", F.round("expected", 6)).withColumn("row_percent", F.round("row_percent", 6))


@PLANS.add(
    "sta_03_zero_fill_sensitivity",
    f"""WITH long AS (SELECT 'filled' AS feature, lang AS market, coalesce(quality, 0) AS value FROM documents LEFT JOIN labels USING (doc_id)
      UNION ALL SELECT 'measured', lang, quality FROM documents JOIN labels USING (doc_id)),
    counts AS (SELECT feature, value, COUNT(*) AS t FROM long GROUP BY 1, 2),
    {_KW[_KW.index("ranks AS (SELECT feature"):]} SELECT feature, CAST(n AS BIGINT) AS n_total, round(h, 5) AS h FROM h""",
)
def zero_fill(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("market"))
    labels = S.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("measured"))
    rows = docs.join(labels, "doc_id", "left").withColumn("filled", F.coalesce("measured", F.lit(0.0)))
    out = stats.kruskal_wallis(order.unpivot(rows, ["market"], ["filled", "measured"]), "feature", "market", "value")
    return out.select("feature", "n_total", F.round("h", 5).alias("h"))


@PLANS.add(
    "sta_04_rank_gee",
    """WITH t AS (SELECT l_quantity AS v, COUNT(*) AS t FROM lineitem GROUP BY 1), r AS (SELECT v, (SUM(t) OVER (ORDER BY v) - t + (t + 1) / 2) / (SUM(t) OVER () + 1) AS y FROM t),
    d AS (SELECT l_partkey AS g, l_returnflag AS f, y FROM lineitem JOIN r ON v = l_quantity),
    m AS (SELECT f, AVG(y) AS mu, COUNT(*) AS n FROM d GROUP BY 1), u AS (SELECT g, f, SUM((y - mu) / n) AS u FROM d JOIN m USING (f) GROUP BY 1, 2),
    c AS (SELECT g, coalesce(SUM(u) FILTER (WHERE f = 'A'), 0) AS a, coalesce(SUM(u) FILTER (WHERE f = 'N'), 0) AS n, coalesce(SUM(u) FILTER (WHERE f = 'R'), 0) AS r FROM u GROUP BY 1),
    s AS (SELECT SUM((n - a) ** 2) AS nn, SUM((r - a) ** 2) AS rr, SUM((n - a) * (r - a)) AS nr, COUNT(*) AS clusters FROM c),
    b AS (SELECT MAX(mu) FILTER (WHERE f = 'N') - MAX(mu) FILTER (WHERE f = 'A') AS bn, MAX(mu) FILTER (WHERE f = 'R') - MAX(mu) FILTER (WHERE f = 'A') AS br, CAST(SUM(n) AS BIGINT) AS n FROM m),
    w AS (SELECT *, (bn * bn * rr - 2 * bn * br * nr + br * br * nn) / (nn * rr - nr * nr) AS wald FROM s CROSS JOIN b)
    SELECT 'l_returnflag_N' AS term, round(bn, 9) AS coefficient, round(wald, 6) AS wald, round(exp(-wald / 2), 8) AS p_value, n, clusters FROM w
    UNION ALL SELECT 'l_returnflag_R', round(br, 9), round(wald, 6), round(exp(-wald / 2), 8), n, clusters FROM w""",
)
def rank_gee(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    fit, names = stats.rank_gee(line, "l_quantity", "l_returnflag", ["A", "N", "R"], "A", "l_partkey")
    wald = fit.wald(names)
    rows = [(n, float(fit.beta[fit.columns.index(n)]), wald["statistic"], wald["p_value"], fit.n, fit.n_clusters) for n in names]
    out = spark.createDataFrame(rows, "term string, coefficient double, wald double, p_value double, n long, clusters long")
    return out.withColumns({"coefficient": F.round("coefficient", 9), "wald": F.round("wald", 6), "p_value": F.round("p_value", 8)})


@PLANS.add("sta_05_binary_gee")
def binary_gee(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", "lang", "source")
    rows = docs.join(S.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    fit, names = stats.binary_gee(rows, F.col("toxic") == 1, "lang", ["en", "fr", "de", "es"], "en", "source")
    wald = fit.wald(names)
    import math

    out = [(n, float(b), math.exp(float(b)), wald["statistic"], wald["p_value"]) for n, b in zip(fit.columns, fit.beta) if n != linear.CONST]
    return spark.createDataFrame(out, "term string, log_odds double, odds_ratio double, wald double, p_value double")


_SP = "p_size p_retailprice p_partkey".split()


@PLANS.add(
    "sta_06_spearman",
    "WITH t AS (SELECT p_partkey, p_retailprice, CASE WHEN p_size % 10 <> 0 THEN p_size END AS p_size FROM part) "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS x, '{b}' AS y, COUNT(*) AS n, round(corr(u, v), 6) AS rho FROM (
        SELECT rank() OVER (ORDER BY {a}) + (COUNT(*) OVER (PARTITION BY {a}) - 1) / 2 AS u, rank() OVER (ORDER BY {b}) + (COUNT(*) OVER (PARTITION BY {b}) - 1) / 2 AS v
        FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for i, a in enumerate(_SP) for b in _SP[i + 1:]
    ),
)
def spearman(spark, sf):
    """A tenth of the sizes is missing; each pair uses the rows that have both."""
    part = S.table(spark, sf, "part").select("p_partkey", "p_retailprice", F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("p_size"))
    return stats.spearman(part, "p_partkey", _SP).select("x", "y", "n", F.round("rho", 6).alias("rho"))


@PLANS.add(
    "sta_07_vif",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
    SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, round(1 / (1 - r * r), 6) AS vif FROM r""",
)
def vif(spark, sf):
    values = linear.vif(S.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame(list(values.items()), "feature string, vif double").withColumn("vif", F.round("vif", 6))


@PLANS.add("sta_22_vif_elimination")
def vif_elimination(spark, sf):
    line = S.table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), "l_tax",
    )
    log = linear.vif_elimination(line, ["l_quantity", "l_extendedprice", "net", "l_tax"])
    return spark.createDataFrame(
        [(r["step"], r["dropped"], r["vif_before"], r["max_vif_after"]) for r in log], "step int, dropped string, vif_before double, max_vif_after double"
    )


@PLANS.add(
    "sta_08_correlation_checks",
    """SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_discount, l_tax), 6) AS discount_tax,
    corr(l_quantity, l_extendedprice) > 0 AS positive FROM lineitem""",
)
def correlation_checks(spark, sf):
    r = F.corr("l_quantity", "l_extendedprice")
    return S.table(spark, sf, "lineitem").agg(
        F.round(r, 6).alias("quantity_price"), F.round(F.corr("l_discount", "l_tax"), 6).alias("discount_tax"), (r > 0).alias("positive")
    )


_SIMPLE = """d AS (SELECT p_size AS x, p_retailprice AS y, p_type AS g, p_partkey AS id FROM part),
f AS (SELECT COUNT(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, AVG(x) AS mx, regr_sxx(y, x) AS sxx FROM d),
r AS (SELECT d.*, f.*, y - a - b * x AS u, 1.0 / n + (x - mx) ** 2 / sxx AS h FROM d, f)"""


def _simple(spark, sf):
    return S.table(spark, sf, "part").select(
        F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_type").alias("g"), F.col("p_partkey").alias("id")
    )


@PLANS.add(
    "sta_09_breusch_pagan",
    f"WITH {_SIMPLE} SELECT round(any_value(n) * corr(u * u, x) ** 2, 6) AS lm FROM r",
)
def breusch_pagan(spark, sf):
    rows = _simple(spark, sf)
    found = linear.breusch_pagan(rows, linear.fit_ols(rows, "y", ["x"]), "y")
    return spark.createDataFrame([(found["lm"],)], "lm double").withColumn("lm", F.round("lm", 6))


@PLANS.add(
    "sta_10_cooks_distance",
    f"""WITH {_SIMPLE}, s AS (SELECT SUM(u * u) / (any_value(n) - 2) AS s2 FROM r)
    SELECT id, round(u, 6) AS residual, round(h, 9) AS leverage, round(u * u / (2 * s2) * h / (1 - h) ** 2, 9) AS cooks_distance,
    u * u / (2 * s2) * h / (1 - h) ** 2 > 4.0 / n AS influential FROM r, s""",
)
def cooks_distance(spark, sf):
    rows = _simple(spark, sf)
    fit = linear.fit_ols(rows, "y", ["x"])
    out = linear.with_influence(rows, fit, "y")
    return out.select(
        "id", F.round("residual", 6).alias("residual"), F.round("leverage", 9).alias("leverage"),
        F.round("cooks_distance", 9).alias("cooks_distance"), (F.col("cooks_distance") > 4.0 / fit.n).alias("influential"),
    )


@PLANS.add("sta_11_reset")
def reset(spark, sf):
    rows = _simple(spark, sf)
    found = linear.reset_test(rows, linear.fit_ols(rows, "y", ["x"], "g"), "y", "g")
    return spark.createDataFrame([tuple(found[k] for k in ("f", "f_p", "wald", "wald_p"))], "f double, f_p double, wald double, wald_p double")


@PLANS.add("sta_12_qq_points")
def qq_points(spark, sf):
    return stats.qq_points(S.table(spark, sf, "part").select("p_retailprice"), "p_retailprice")


_PRED = """pr AS (SELECT l_partkey AS track, l_returnflag AS market, l_extendedprice / 1000 AS y, l_quantity * 0.9 + 20 AS a, l_quantity * 1.1 + 10 AS b FROM lineitem)"""


def predictions(spark, sf):
    q = F.col("l_quantity")
    return S.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("track"), F.col("l_returnflag").alias("market"), (F.col("l_extendedprice") / 1000).alias("y"),
        (q * 0.9 + 20).alias("a"), (q * 1.1 + 10).alias("b"),
    )


@PLANS.add(
    "sta_15_metrics",
    f"""WITH {_PRED}, both AS (SELECT market AS scope, y, a FROM pr UNION ALL SELECT 'Overall', y, a FROM pr)
    SELECT scope, COUNT(*) AS n, round(1 - SUM((y - a) ** 2) / (var_pop(y) * COUNT(*)), 6) AS r2, round(AVG(abs(y - a)), 6) AS mae,
    round(sqrt(AVG((y - a) ** 2)), 6) AS rmse, COUNT(*) FILTER (WHERE a < -99 OR a > 60) AS out_of_domain FROM both GROUP BY 1""".replace("both", "scoped"),
)
def metrics(spark, sf):
    out = bootstrap.base_metrics(predictions(spark, sf), "y", "a", "market", domain=(-99.0, 60.0))
    return out.select("scope", "n", *[F.round(c, 6).alias(c) for c in ("r2", "mae", "rmse")], "out_of_domain")


BLOCK = 512  # clusters a block, so that the small tables are cut into several
LEVELS = 7  # halvings that the SQL spells out, enough for 65,536 clusters


def _hash_sql(parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {parts}, '43')), 1, 15) AS BIGINT)"


def _halving_sql(i: int) -> str:
    """One level of the tree of binomial halvings: t{i} to t{i + 1}; nodes of one block pass unchanged."""
    return f"""s{i} AS (SELECT *, (lo + hi) // 2 AS mid, least((lo + hi) // 2 * {BLOCK}, size) - lo * {BLOCK} AS a, least(hi * {BLOCK}, size) - lo * {BLOCK} AS b,
      {_hash_sql("r, draw, lo, hi")} / 1152921504606846976.0 AS u FROM t{i} WHERE hi - lo > 1),
    p{i} AS (SELECT n, a, b, unnest(range(greatest(0, CAST(floor(n * a / b - 14 * sqrt(n * a / b * (1 - a / b)) - 20) AS BIGINT)),
      least(n, CAST(floor(n * a / b + 14 * sqrt(n * a / b * (1 - a / b)) + 20) AS BIGINT)) + 1)) AS k FROM (SELECT DISTINCT n, a, b FROM s{i})),
    c{i} AS (SELECT n, a, b, k, SUM(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(a / b) + (n - k) * ln(1 - a / b))) OVER (PARTITION BY n, a, b ORDER BY k) AS below FROM p{i}),
    h{i} AS (SELECT s.draw, s.r, s.size, s.lo, s.mid, s.hi, s.n, c.k FROM s{i} s ASOF JOIN c{i} c ON c.n = s.n AND c.a = s.a AND c.b = s.b AND s.u < c.below),
    t{i + 1} AS (SELECT * FROM t{i} WHERE hi - lo <= 1 UNION ALL SELECT draw, r, size, lo, mid, k FROM h{i} UNION ALL SELECT draw, r, size, mid, hi, n - k FROM h{i})"""


def _mixed_sql(z: str, shift: int, factor: int) -> str:
    return f"CAST((CAST(xor({z}, {z} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"


def _draws_sql(scoped: str, draw: str) -> str:
    """Cluster sums of table scoped and 1,000 replicates over the clusters of each draw."""
    return f"""sums AS (SELECT {draw} AS draw, scope, track, COUNT(*) AS n, SUM(y) AS sy, SUM(y * y) AS syy, SUM((y - a) ** 2) AS a2, SUM(abs(y - a)) AS a1,
      SUM((y - b) ** 2) AS b2, SUM(abs(y - b)) AS b1 FROM {scoped} GROUP BY 1, 2, 3),
    places AS (SELECT draw, track, row_number() OVER (PARTITION BY draw ORDER BY substr(md5(CAST(track AS VARCHAR) || '|43'), 1, 15)) - 1 AS place
      FROM (SELECT DISTINCT draw, track FROM sums)),
    t0 AS (SELECT draw, r, size, 0::BIGINT AS lo, (size + {BLOCK - 1}) // {BLOCK} AS hi, size AS n FROM (SELECT draw, COUNT(*) AS size FROM places GROUP BY 1), range(1000) v(r)),
    {", ".join(_halving_sql(i) for i in range(LEVELS))},
    slots AS (SELECT draw, r, lo, least({BLOCK}, size - lo * {BLOCK}) AS m, {_hash_sql("r, draw, lo, hi")} AS key, unnest(range(n)) AS slot FROM t{LEVELS}),
    z0 AS (SELECT draw, r, lo, m, CAST((CAST(key AS UHUGEINT) + CAST(slot + 1 AS UHUGEINT) * {bootstrap.STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM slots),
    z1 AS (SELECT draw, r, lo, m, {_mixed_sql("z", 30, bootstrap.FIRST_MIX)} AS z FROM z0),
    z2 AS (SELECT draw, r, lo, m, {_mixed_sql("z", 27, bootstrap.SECOND_MIX)} AS z FROM z1),
    drawn AS (SELECT draw, r, lo * {BLOCK} + CAST(((xor(z, z >> 31) >> 32) * CAST(m AS UBIGINT)) >> 32 AS BIGINT) AS place FROM z2),
    times AS (SELECT draw, r, place, COUNT(*) AS k FROM drawn GROUP BY 1, 2, 3),
    reps AS (SELECT r, scope, SUM(k * n) AS n, SUM(k * sy) AS sy, SUM(k * syy) AS syy, SUM(k * a2) AS a2, SUM(k * a1) AS a1, SUM(k * b2) AS b2, SUM(k * b1) AS b1
      FROM times JOIN places USING (draw, place) JOIN sums USING (draw, track) GROUP BY 1, 2)"""


@PLANS.add(
    "sta_15_bootstrap_intervals",
    f"""WITH {_PRED}, scoped AS (SELECT market AS scope, * FROM pr UNION ALL SELECT 'Overall', * FROM pr), {_draws_sql("scoped", "scope")},
    long AS (SELECT scope, unnest(['r2', 'mae', 'rmse']) AS metric, unnest([1 - a2 / (syy - sy * sy / n), a1 / n, sqrt(a2 / n)]) AS value FROM reps)
    SELECT scope, metric, round(quantile_cont(value, 0.025), 6) AS ci_low, round(quantile_cont(value, 0.975), 6) AS ci_high FROM long GROUP BY 1, 2""",
)
def bootstrap_intervals(spark, sf):
    out = bootstrap.bootstrap_metrics(predictions(spark, sf), "track", "y", "a", "market", block=BLOCK)
    return out.select("scope", "metric", *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")])


@PLANS.add(
    "sta_16_paired_bootstrap",
    f"""WITH {_PRED}, scoped AS (SELECT market AS scope, * FROM pr), {_draws_sql("scoped", "'Overall'")},
    parts AS (SELECT * FROM reps UNION ALL SELECT r, 'Overall', SUM(n), SUM(sy), SUM(syy), SUM(a2), SUM(a1), SUM(b2), SUM(b1) FROM reps GROUP BY 1),
    long AS (SELECT scope, unnest(['r2', 'mae', 'rmse']) AS metric, unnest([(a2 - b2) / (syy - sy * sy / n), (b1 - a1) / n, sqrt(b2 / n) - sqrt(a2 / n)]) AS delta FROM parts)
    SELECT scope, 'b' AS model, metric, round(AVG(delta), 6) AS mean_delta, round(100.0 * AVG(CASE WHEN metric = 'r2' THEN delta > 0 ELSE delta < 0 END::INTEGER), 4) AS pct_better,
    round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high FROM long GROUP BY 1, 2, 3""",
)
def paired_bootstrap(spark, sf):
    out = bootstrap.paired_differences(predictions(spark, sf), "track", "market", "y", "a", ["b"], block=BLOCK)
    return out.select("scope", "model", "metric", F.round("mean_delta", 6).alias("mean_delta"), F.round("pct_better", 4).alias("pct_better"), *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")])


@PLANS.add(
    "agg_35_screener_counts",
    f"""WITH {_PRED}, q AS (SELECT market, quantile_cont(a, 0.78) AS q FROM pr GROUP BY 1)
    SELECT a >= q AS in_top, COUNT(*) AS n, COUNT(*) FILTER (WHERE y >= 70) AS hits, round(AVG(y), 6) AS mean, round(var_samp(y), 6) AS variance
    FROM pr JOIN q ON q.market = pr.market GROUP BY 1""",
)
def screener_counts(spark, sf):
    out = stats.screener_counts(predictions(spark, sf), "market", "a", "y", F.col("y") >= 70)
    return out.select("in_top", "n", "hits", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@PLANS.add("sta_17_screener_test")
def screener_test(spark, sf):
    found = stats.screener_test(stats.screener_counts(predictions(spark, sf), "market", "a", "y", F.col("y") >= 70))
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "measure string, value double")


@PLANS.add(
    "sta_18_missingness_units",
    f"""WITH {S.PERF}, m AS (SELECT p.track, p.market, l.quality IS NULL AS gone, COUNT(*) OVER (PARTITION BY p.track) = 1 AS exclusive
      FROM perf p LEFT JOIN labels l ON l.doc_id = p.track)
    SELECT 'row' AS unit, COUNT(*) AS total, COUNT(*) FILTER (WHERE gone) AS missing FROM m UNION ALL
    SELECT 'track', COUNT(DISTINCT track), COUNT(DISTINCT track) FILTER (WHERE gone) FROM m UNION ALL
    SELECT 'exclusive track', COUNT(*) FILTER (WHERE exclusive), COUNT(*) FILTER (WHERE exclusive AND gone) FROM m""",
)
def missingness_units(spark, sf):
    labels = S.table(spark, sf, "labels").select(F.col("doc_id").alias("track"), F.lit(True).alias("seen"))
    tracks = S.perf(spark, sf).groupBy("track").agg(F.count(F.lit(1)).alias("n_markets")).join(labels, "track", "left")
    gone, one = F.col("seen").isNull(), F.col("n_markets") == 1
    sums = tracks.agg(
        F.sum("n_markets").alias("r"), F.sum(F.when(gone, F.col("n_markets")).otherwise(0)).alias("rm"), F.count(F.lit(1)).alias("t"),
        F.count_if(gone).alias("tm"), F.count_if(one).alias("e"), F.count_if(one & gone).alias("em"),
    )
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(a).alias("total"), F.col(b).alias("missing"))
                      for u, a, b in (("row", "r", "rm"), ("track", "t", "tm"), ("exclusive track", "e", "em"))])
    return sums.select(F.explode(units).alias("u")).select("u.*")


_GRID = [float(x) for x in range(0, 101, 20)]


@PLANS.add(
    "sta_19_kde",
    f"""WITH {_PRED}, f AS (SELECT market, COUNT(*) AS n, stddev_samp(a) * COUNT(*) ** -0.2 AS h FROM pr GROUP BY 1)
    SELECT pr.market, CAST(x AS DOUBLE) AS x, round(SUM(exp(-0.5 * ((x - a) / h) ** 2)) / any_value(n) / any_value(h) / sqrt(2 * pi()), 8) AS density
    FROM pr JOIN f ON f.market = pr.market CROSS JOIN unnest([0, 20, 40, 60, 80, 100]) g(x) GROUP BY 1, 2""",
)
def kde(spark, sf):
    return stats.gaussian_kde(predictions(spark, sf), "market", "a", _GRID).withColumn("density", F.round("density", 8))


@PLANS.add(
    "sta_20_tolerance_checks",
    """WITH a AS (SELECT l_returnflag AS label, AVG(l_quantity) AS actual FROM lineitem GROUP BY 1)
    SELECT e.label, round(a.actual, 6) AS actual, e.expected, CASE WHEN coalesce(abs(a.actual - e.expected) <= 0.5 + 1e-5 * abs(e.expected), FALSE) THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (VALUES ('A', 25.5::DOUBLE), ('N', 30.0), ('X', 1.0)) e(label, expected) LEFT JOIN a ON a.label = e.label""",
)
def tolerance_checks(spark, sf):
    actual = S.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.avg("l_quantity").alias("actual"))
    expected = spark.createDataFrame([("A", 25.5), ("N", 30.0), ("X", 1.0)], "label string, expected double")
    return quality.tolerance_checks(actual, expected, atol=0.5).withColumn("actual", F.round("actual", 6))


_AUDIT_SIGNS = ["max_abs_z", "k2", "skewness", "kurtosis", "mean", "sd", "median", "iqr", "low", "high", "max_own_leverage", "limit_2p", "limit_3p", "limit_cooks",
                "max_leverage", "max_cooks", "high_max_leverage", "high_mean_leverage", "high_max_cooks", "vif"]
_HIGH_WORDS = 1000


@PLANS.add(
    "sta_23_transform_audit",
    f"""WITH {S.LYRICS}, b AS (SELECT unnest(['all', language]) AS cohort, CAST(word_count AS DOUBLE) AS raw, CAST(line_count AS DOUBLE) AS w,
      CAST(chorus_repetition_count AS DOUBLE) AS y FROM lyric_rows WHERE chorus_repetition_count IS NOT NULL),
    f AS (SELECT cohort, 'raw' AS form, raw AS x, w, y, raw FROM b UNION ALL SELECT cohort, 'log1p', ln(1 + raw), w, y, raw FROM b),
    m AS (SELECT cohort, form, CAST(COUNT(*) AS DOUBLE) AS n, AVG(x) AS mx, AVG(w) AS mw, AVG(y) AS my, quantile_cont(x, 0.5) AS median,
      quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, MIN(x) AS low, MAX(x) AS high FROM f GROUP BY 1, 2),
    d AS (SELECT cohort, form, n, raw, x - mx AS dx, w - mw AS dw, y - my AS dy FROM f JOIN m USING (cohort, form)),
    s AS (SELECT cohort, form, any_value(n) AS n, SUM(dx * dx) AS xx, SUM(dw * dw) AS ww, SUM(dx * dw) AS xw, SUM(dx * dy) AS xy, SUM(dw * dy) AS wy,
      SUM(dy * dy) AS yy, SUM(dx ** 3) AS c3, SUM(dx ** 4) AS c4 FROM d GROUP BY 1, 2),
    t AS (SELECT cohort, form, xx, ww, xw, xx * ww - xw * xw AS det, (xy * ww - wy * xw) / det AS bx, (wy * xx - xy * xw) / det AS bw,
      (yy - bx * xy - bw * wy) / (n - 3) AS s2, sqrt(xx / n) AS sd0, (c3 / n) / sd0 ** 3 AS g1, (c4 / n) / sd0 ** 4 AS g2 FROM s),
    i AS (SELECT d.*, sd0, 1 / n + (ww * dx * dx - 2 * xw * dx * dw + xx * dw * dw) / det AS h, dy - bx * dx - bw * dw AS u,
      u * u / (3 * s2) * h / (1 - h) ** 2 AS cook FROM d JOIN t USING (cohort, form)),
    r AS (SELECT cohort, form, MAX(abs(dx)) AS far, COUNT(*) FILTER (WHERE abs(dx) > 3 * sd0) AS n_abs_z_over_3, MAX(h) AS max_leverage,
      COUNT(*) FILTER (WHERE h > 6 / n) AS n_over_2p, COUNT(*) FILTER (WHERE h > 9 / n) AS n_over_3p, MAX(cook) AS max_cooks,
      COUNT(*) FILTER (WHERE cook > 4 / n) AS n_cooks_over, COUNT(*) FILTER (WHERE raw >= {_HIGH_WORDS}) AS n_high,
      MAX(h) FILTER (WHERE raw >= {_HIGH_WORDS}) AS high_max_leverage, AVG(h) FILTER (WHERE raw >= {_HIGH_WORDS}) AS high_mean_leverage,
      MAX(cook) FILTER (WHERE raw >= {_HIGH_WORDS}) AS high_max_cooks FROM i GROUP BY 1, 2),
    v AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS ky, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
      sqrt(2 * (b2 - 1)) - 1 AS w2, ky / sqrt(2 / (w2 - 1)) AS q, ln(q + sqrt(q * q + 1)) / sqrt(0.5 * ln(w2)) AS z1,
      (g2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS kx,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root,
      6 + 8 / root * (2 / root + sqrt(1 + 4 / root ** 2)) AS a, (1 - 2 / a) / (1 + kx * sqrt(2 / (a - 4))) AS cube,
      (1 - 2 / (9 * a) - sign(cube) * abs(cube) ** (1 / 3)) / sqrt(2 / (9 * a)) AS z2, z1 * z1 + z2 * z2 AS k2_all FROM m JOIN t USING (cohort, form) JOIN r USING (cohort, form))
    SELECT cohort, form, CAST(n AS BIGINT) AS n, 3 AS p, round(mx, 7) AS mean, round(sd0 * sqrt(n / (n - 1)), 7) AS sd, round(median, 7) AS median, round(iqr, 7) AS iqr,
      round(low, 7) AS low, round(high, 7) AS high, round(g1 * sqrt(n * (n - 1)) / (n - 2), 7) AS skewness,
      round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g2 - 3) + 6), 7) AS kurtosis, round(k2_all, 7) AS k2, round(exp(-k2_all / 2), 9) AS p_value,
      round(far / sd0, 7) AS max_abs_z, n_abs_z_over_3, round((1 + (far / sd0) ** 2) / n, 7) AS max_own_leverage, round(6 / n, 7) AS limit_2p, round(9 / n, 7) AS limit_3p,
      round(4 / n, 7) AS limit_cooks, round(max_leverage, 7) AS max_leverage, n_over_2p, n_over_3p, round(max_cooks, 7) AS max_cooks, n_cooks_over, n_high,
      round(high_max_leverage, 7) AS high_max_leverage, round(high_mean_leverage, 7) AS high_mean_leverage, round(high_max_cooks, 7) AS high_max_cooks,
      round(ww * xx / det, 7) AS vif FROM v""",
)
def transform_audit(spark, sf):
    """Word counts against the quality label, in all rows and in each language."""
    rows = S.lyric_rows(spark, sf).select(
        F.explode(F.array(F.lit("all"), "language")).alias("cohort"), "word_count", "line_count", F.col("chorus_repetition_count").alias("label")
    )
    out = influence.transform_audit(rows, "word_count", "label", ["line_count"], ["cohort"], _HIGH_WORDS)
    return out.withColumns({c: F.round(c, 7) for c in _AUDIT_SIGNS} | {"p_value": F.round("p_value", 9)})


@PLANS.add(
    "win_09_adjusted_p_values",
    """WITH t AS (SELECT p_type AS name, CASE WHEN SUM(p_size) % 11 <> 0 THEN (SUM(p_size) % 97 + 1) / 400.0::DOUBLE END AS p FROM part GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, COUNT(*) OVER () AS m FROM t WHERE p IS NOT NULL)
    SELECT name, round(p, 9) AS p, round(least(1, MAX((m - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 9) AS p_holm,
    round(least(1, MIN(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_bh FROM o
    UNION ALL SELECT name, NULL, NULL, NULL FROM t WHERE p IS NULL""",
)
def adjusted_p_values(spark, sf):
    base = S.table(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.when(F.sum("p_size") % 11 != 0, (F.sum("p_size") % 97 + 1) / F.lit(400.0)).alias("p"))
    out = stats.with_benjamini_hochberg(stats.with_holm(base, "p"), "p")
    return out.select("name", *[F.round(c, 9).alias(c) for c in ("p", "p_holm", "p_bh")])


@PLANS.add(
    "dq_11_adjustment_invariants",
    """SELECT 0::BIGINT AS holm_below_p, 0::BIGINT AS bh_above_holm, 0::BIGINT AS above_one, 0::BIGINT AS not_monotone FROM (SELECT COUNT(*) FROM part)""",
)
def adjustment_invariants(spark, sf):
    return stats.adjustment_violations(adjusted_p_values(spark, sf), "p", "p_holm", "p_bh")


@PLANS.add(
    "agg_09_quantiles_spread",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
    round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""",
)
def quantiles_spread(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    out = order.exact_quantiles(line, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.99], ["p10", "p50", "p99"])
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p99")])
