"""Rank tests, contingency tests, correlations, screeners and densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions import dist, score
from chartspark.operators import linear, order

ONE = "_one"


def _tested(df: DataFrame, p: str) -> tuple[DataFrame, Column, Column]:
    """Rows with the place of their p among the known ones (NULL and NaN stay out), the place and the number of tests."""
    here = F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))
    rows = df.withColumns({ONE: F.lit(1), "_known": here})
    place = F.row_number().over(W.partitionBy(ONE, "_known").orderBy(F.asc(p)))
    m = F.count_if("_known").over(W.partitionBy(ONE))
    return rows.withColumns({"_place": F.when(F.col("_known"), place), "_m": m}), F.col("_place"), F.col("_m")


def with_holm(df: DataFrame, p: str, out: str = "p_holm") -> DataFrame:
    """Holm step-down over the known p of a small result table; an unknown p stays NULL and counts for nothing."""
    rows, place, m = _tested(df, p)
    raised = rows.withColumn("_adj", F.when(F.col("_known"), (m - place + 1) * F.col(p)))
    high = F.max("_adj").over(W.partitionBy(ONE, "_known").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    return raised.withColumn(out, F.when(F.col("_known"), F.least(F.lit(1.0), high))).drop(ONE, "_known", "_adj", "_place", "_m")


def with_benjamini_hochberg(df: DataFrame, p: str, out: str = "p_bh") -> DataFrame:
    """Benjamini-Hochberg over the known p of a small result table; an unknown p stays NULL and counts for nothing."""
    rows, place, m = _tested(df, p)
    scaled = rows.withColumn("_adj", F.when(F.col("_known"), m / place * F.col(p)))
    low = F.min("_adj").over(W.partitionBy(ONE, "_known").orderBy(F.desc("_place")).rowsBetween(W.unboundedPreceding, 0))
    return scaled.withColumn(out, F.when(F.col("_known"), F.least(F.lit(1.0), low))).drop(ONE, "_known", "_adj", "_place", "_m")


def adjustment_violations(df: DataFrame, p: str, holm: str, bh: str) -> DataFrame:
    """Rows breaking p <= BH <= Holm <= 1, and p order broken by an adjusted value."""
    every = W.partitionBy(F.lit(1)).orderBy(p)
    eps = 1e-12
    back = lambda c: F.col(c) < F.lag(c).over(every) - eps
    rows = df.withColumn("_hb", back(holm)).withColumn("_bb", back(bh))
    return rows.agg(
        F.count_if(F.col(holm) < F.col(p) - eps).alias("holm_below_p"), F.count_if(F.col(bh) > F.col(holm) + eps).alias("bh_above_holm"),
        F.count_if((F.col(holm) > 1) | (F.col(bh) > 1)).alias("above_one"), F.count_if(F.col("_hb") | F.col("_bb")).alias("not_monotone"),
    )


def kruskal_wallis(long: DataFrame, feature: str, group: str, value: str, min_group: int = 1) -> DataFrame:
    """H with tie correction, p, Holm, epsilon squared and its size, for all features at once.

    Everything works on counted values: ranks are looked up once per distinct value, never per row. Features with fewer
    than two groups or a group below min_group get NULL.
    """
    known = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranks = order.average_ranks(known, [feature], value)
    ties = ranks.groupBy(feature).agg(
        F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"), F.max("total").cast("double").alias("n_total")
    )
    cells = known.groupBy(feature, group, value).agg(F.count(F.lit(1)).alias("_c"))
    looked = cells.join(ranks.select(feature, value, "average_rank"), [feature, value])
    groups = looked.groupBy(feature, group).agg(
        F.sum("_c").cast("double").alias("_n"), F.sum(F.col("_c") * F.col("average_rank")).alias("_r")
    )
    folded = groups.groupBy(feature).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_rr"), F.min("_n").alias("min_n")
    )
    n, k = F.col("n_total"), F.col("k")
    h = (12 / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    fine = (k >= 2) & (F.col("min_n") >= min_group) & (F.col("ties") < n * n * n - n)
    rows = folded.join(ties, feature).withColumn("h", F.when(fine, h))
    rows = rows.withColumn("p_value", dist.chi2_p("h", (k - 1).cast("double")))
    rows = rows.withColumn("epsilon_squared", (F.col("h") - k + 1) / (n - k))
    out = with_holm(rows, "p_value").withColumn("effect", score.effect_size("epsilon_squared"))
    return out.select(feature, F.col("k").alias("n_groups"), n.cast("bigint").alias("n_total"), "h", "p_value", "p_holm", "epsilon_squared", "effect")


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Pearson test of a crosstab without continuity correction, with Cramer's V; both NULL with a single row or column label.

    Empty cells need no row: the statistic is N * (sum of o^2 / (row * column) - 1).
    """
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy(row).agg(F.sum("o").alias("_r"))
    columns = cells.groupBy(column).agg(F.sum("o").alias("_c"))
    joined = cells.join(rows, row).join(columns, column)
    sums = joined.agg(
        F.sum(F.col("o") * F.col("o") / (F.col("_r") * F.col("_c"))).alias("_q"), F.sum("o").alias("n"),
        F.count_distinct(row).alias("n_rows"), F.count_distinct(column).alias("n_columns"),
    )
    df_ = (F.col("n_rows") - 1) * (F.col("n_columns") - 1)
    stat = sums.withColumn("df", df_).withColumn("chi_square", F.when(F.col("df") > 0, F.col("n") * (F.col("_q") - 1)))
    v = F.sqrt(F.try_divide(F.col("chi_square"), F.col("n") * (F.least("n_rows", "n_columns") - 1)))
    return stat.select(
        F.col("n").cast("bigint").alias("n"), "chi_square", "df", dist.chi2_p("chi_square", F.col("df").cast("double")).alias("p_value"),
        v.alias("cramers_v"),
    )


def expected_counts(df: DataFrame, row: str, column: str, labels: list | None = None) -> DataFrame:
    """Observed and expected count and row percentage per cell: of the observed cells, or with labels of every row and label.

    The labels are the caller's list, so the grid is as wide as that list; a column label that it lacks counts in the totals
    only, and one without rows has zeros.
    """
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = known.groupBy(row, column).agg(F.count(F.lit(1)).alias("observed"))
    totals = cells.groupBy(column).agg(F.sum("observed").alias("_c"))
    everything = cells.agg(F.sum("observed").alias("_n")).withColumn(ONE, F.lit(1))
    rows = cells.groupBy(row).agg(F.sum("observed").alias("row_total"))
    if labels is None:
        full = cells.join(rows, row)
    else:
        kind = df.schema[column].dataType
        grid = rows.withColumn(column, F.explode(F.array(*[F.lit(v).cast(kind) for v in labels])))
        full = grid.join(cells, [row, column], "left")
    # the total is one row
    full = full.join(totals, column, "left").withColumn(ONE, F.lit(1)).join(F.broadcast(everything), ONE)
    observed, total = F.coalesce("observed", F.lit(0).cast("bigint")), F.coalesce("_c", F.lit(0).cast("bigint"))
    return full.select(
        row, column, observed.alias("observed"), (F.col("row_total") * total / F.col("_n")).alias("expected"),
        (observed / F.col("row_total") * 100).alias("row_percent"),
    )


def rank_gee(df: DataFrame, value: str, group: str, levels: list[str], base: str, cluster: str) -> tuple[linear.LinearFit, list[str]]:
    """Gaussian independence model of average rank / (N + 1) on group dummies with a plain cluster sandwich."""
    known = df.where(F.col(value).isNotNull()).select(cluster, group, value).withColumn("_all", F.lit(1))
    ranked = known.join(
        order.average_ranks(known, ["_all"], value).select("_all", value, (F.col("average_rank") / (F.col("total") + 1)).alias("_y")), ["_all", value]
    )
    names = [f"{group}_{level}" for level in levels if level != base]
    dummies = [(F.col(group) == level).cast("double").alias(f"{group}_{level}") for level in levels if level != base]
    return linear.fit_ols(ranked.select(cluster, "_y", *dummies), "_y", names, cluster, correct=False), names


def binary_gee(df: DataFrame, outcome: Column, group: str, levels: list[str], base: str, cluster: str) -> tuple[linear.LinearFit, list[str]]:
    """Logistic independence model of a 0/1 outcome on group dummies."""
    names = [f"{group}_{level}" for level in levels if level != base]
    dummies = [(F.col(group) == level).cast("double").alias(f"{group}_{level}") for level in levels if level != base]
    return linear.fit_logistic(df.select(cluster, outcome.cast("double").alias("_y"), *dummies), "_y", names, cluster), names


def spearman(df: DataFrame, key: str, columns: list[str], min_n: int = 10) -> DataFrame:
    """Spearman matrix in long form, pairwise complete, with two-sided p and stars; pairs up to min_n rows are left out.

    Ranks are taken per pair over the rows both columns have.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("double").alias("u"), F.col(b).cast("double").alias("v")) for a, b in pairs]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("u is not null and v is not null and not isnan(u) and not isnan(v)")
    # counting equal pairs first keeps one row per distinct (u, v)
    counted = long.groupBy("x", "y", "u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ru = _weighted_ranks(counted, ["x", "y"], "u", "ru")
    rv = _weighted_ranks(counted, ["x", "y"], "v", "rv")
    joined = counted.join(ru, ["x", "y", "u"]).join(rv, ["x", "y", "v"])
    w, a, b = F.col("w"), F.col("ru"), F.col("rv")
    sums = joined.groupBy("x", "y").agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"),
        F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"),
    ).where(F.col("n") > min_n)
    n = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    # a constant column has no correlation; a perfect one has p 0
    spread = F.sqrt((F.col("saa") - F.col("sa") ** 2 / n) * (F.col("sbb") - F.col("sb") ** 2 / n))
    rho = F.when(spread > 1e-9 * n, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / spread)))
    perfect = F.abs(F.col("rho")) >= 1 - 1e-15
    t = F.when(~perfect, F.col("rho") * F.sqrt(F.try_divide(n - 2, 1 - F.col("rho") ** 2)))
    tested = sums.withColumn("rho", rho).withColumn("_t", t)
    out = tested.withColumn("p_value", F.when(perfect, F.lit(0.0)).otherwise(dist.t_p("_t", n - 2)))
    return out.select("x", "y", n.cast("bigint").alias("n"), "rho", "p_value", score.stars(F.col("p_value")).alias("stars"))


def _weighted_ranks(counted: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank of each distinct value; the counted rows are spread out again only by their counts."""
    per_value = counted.groupBy(*keys, value).agg(F.sum("w").alias("n"))
    placed = order.positions_of_counts(per_value, keys, value)
    return placed.select(*keys, value, (F.col("start") + (F.col("n") + 1) / 2).alias(out))


def qq_points(df: DataFrame, value: str) -> DataFrame:
    """Standardised sample value against the normal quantile of its mean position (i - 0.5) / n; ties share one point."""
    rows = df.where(F.col(value).isNotNull()).select(value).withColumn("_all", F.lit(1))
    placed = order.counted_positions(rows, ["_all"], value)
    middle = (F.col("start") + F.col("n") / 2) / F.col("total")
    facts = rows.groupBy("_all").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return placed.join(F.broadcast(facts), "_all").select(
        dist.probit(middle).alias("theoretical"), ((F.col(value) - F.col("_m")) / F.col("_s")).alias("sample"), "n"
    )


def gaussian_kde(df: DataFrame, group: str, value: str, grid: list[float]) -> DataFrame:
    """Density of each group on a grid with Scott's bandwidth.

    Values are counted first and each distinct value adds to the grid points inside its task; no join with the grid.
    """
    known = df.where(F.col(value).isNotNull())
    facts = known.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.stddev_samp(value).alias("_s"))
    counted = known.groupBy(group, value).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    h = F.col("_s") * F.col("_n") ** F.lit(-0.2)
    joined = counted.join(facts.withColumn("_h", h), group)
    terms = [
        (F.sum(F.col("_w") * F.exp(-0.5 * ((F.lit(float(x)) - F.col(value)) / F.col("_h")) ** 2)) / F.first("_n")
         / (F.first("_h") * math.sqrt(2 * math.pi))).alias(f"g{i}")
        for i, x in enumerate(grid)
    ]
    wide = joined.groupBy(group).agg(*terms)
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.col(f"g{i}").alias("density")) for i, x in enumerate(grid)])
    return wide.select(group, F.explode(points).alias("p")).select(group, "p.x", "p.density")


def screener_counts(df: DataFrame, market: str, prediction: str, actual: str, hit: Column, quantile: float = 0.78) -> DataFrame:
    """Rows at or above the market's prediction quantile against the rest: counts, hits, mean and variance of the score.

    Rows are added up per market and prediction once, and only these sums meet the quantiles. A market's sums are spread over
    salts, each with its copy of the quantile, so that no task gets a whole market. Squares are taken about the common mean.
    """
    k, mean = F.count(actual), F.avg(actual)
    sums = df.groupBy(F.col(market).alias("_market"), F.col(prediction).alias("_value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), k.alias("_k"), F.coalesce(mean, F.lit(0.0)).alias("_mean"),
        F.coalesce(F.var_pop(actual) * k, F.lit(0.0)).alias("_within"),
    )
    sums = scale.cut_lineage(sums)
    counts = sums.select("_market", F.col("_value").cast("double").alias("_qv"), "n")
    placed = order.positions_of_counts(counts, ["_market"], "_qv")
    edges = placed.groupBy("_market").agg(*order.quantile_columns("_qv", [quantile], ["_q"]))
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = edges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    spread = scale.salted_keys(sums, "_salt", pieces, "_value").join(copies, ["_market", "_salt"], "left")
    centre = sums.agg(F.when(F.sum("_k") > 0, F.sum(F.col("_mean") * F.col("_k")) / F.sum("_k")).alias("_centre"))
    off = F.col("_mean") - F.col("_centre")
    flagged = spread.crossJoin(F.broadcast(centre)).withColumn("in_top", F.col("_value") >= F.col("_q"))  # one row
    shift, total = F.sum(F.col("_k") * off), F.sum("_k")
    return flagged.groupBy("in_top").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.when(total > 0, F.max("_centre") + shift / total).alias("mean"),
        F.when(total > 1, (F.sum("_within") + F.sum(F.col("_k") * off * off) - shift * shift / total) / (total - 1)).alias("variance"),
    )


def screener_test(counts: DataFrame) -> dict:
    """Welch interval of the mean difference, two-proportion z, odds ratio and Fisher's test from two rows."""
    rows = {r["in_top"]: r for r in counts.collect()}  # two rows
    top, rest = rows[True], rows[False]
    a, b, c, d = top["hits"], top["n"] - top["hits"], rest["hits"], rest["n"] - rest["hits"]
    v1, v2 = top["variance"] / top["n"], rest["variance"] / rest["n"]
    se = math.sqrt(v1 + v2)
    df_ = (v1 + v2) ** 2 / (v1**2 / (top["n"] - 1) + v2**2 / (rest["n"] - 1))
    diff, crit = top["mean"] - rest["mean"], dist.t_quantile(0.975, df_)
    pool = (a + c) / (top["n"] + rest["n"])
    se_p = math.sqrt(pool * (1 - pool) * (1 / top["n"] + 1 / rest["n"]))
    z = (a / top["n"] - c / rest["n"]) / se_p if se_p else float("nan")
    odds = (a / b) / (c / d) if b > 0 and c > 0 else 0.0
    return {
        "n_top": top["n"], "n_rest": rest["n"], "hit_rate_top": a / top["n"] * 100, "hit_rate_rest": c / rest["n"] * 100,
        "odds_ratio": odds, "p_fisher": dist.fisher_two_sided(a, b, c, d), "z": z, "p_z": dist.normal_two_sided(z),
        "mean_difference": diff, "ci_low": diff - crit * se, "ci_high": diff + crit * se,
    }
