import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartspark.functions import dist
from chartspark.operators import bootstrap, design, forest, influence, linear, saved_model, stats


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    g = rng.integers(0, 60, n)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * x1 - x2 + rng.normal(size=60)[g] + rng.normal(size=n)
    b = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x1)))).astype(float)
    rows = [(int(a), *map(float, r)) for a, *r in zip(g, x1, x2, y, b)]
    return dict(g=g, x1=x1, x2=x2, y=y, b=b), spark.createDataFrame(rows, "g int, x1 double, x2 double, y double, b double").repartition(6)


def sandwich(X, u, g, inv):
    s = np.array([X[g == k].T @ u[g == k] for k in np.unique(g)])
    return inv @ (s.T @ s) @ inv


def test_cluster_robust_ols(table):
    d, df = table
    X = np.column_stack([np.ones(len(d["y"])), d["x1"], d["x2"]])
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ d["y"]
    u = d["y"] - X @ beta
    n, k, G = len(u), 3, len(np.unique(d["g"]))
    cov = sandwich(X, u, d["g"], inv) * G / (G - 1) * (n - 1) / (n - k)
    fit = linear.fit_ols(df, "y", ["x1", "x2"], "g")
    assert fit.beta == pytest.approx(beta, abs=1e-9) and fit.cov == pytest.approx(cov, abs=1e-9)
    assert (fit.n, fit.n_clusters) == (n, G) and fit.r2 == pytest.approx(1 - u @ u / np.sum((d["y"] - d["y"].mean()) ** 2))
    w = fit.wald(["x1", "x2"])
    assert w["statistic"] == pytest.approx(beta[1:] @ np.linalg.inv(cov[1:, 1:]) @ beta[1:])
    influence = linear.with_influence(linear.with_const(df), fit, "y").agg(F.sum("leverage"), F.max("cooks_distance")).first()
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    cook = u**2 / (k * (u @ u) / (n - k)) * h / (1 - h) ** 2
    assert influence[0] == pytest.approx(3) and influence[1] == pytest.approx(cook.max())


def test_ladder_equals_single_fits(table):
    _, df = table
    ladder = linear.fit_ladder(df, "y", {"a": ["x1"], "b": ["x1", "x2"]}, "g")
    single = linear.fit_ols(df, "y", ["x1"], "g")
    assert ladder["a"].beta == pytest.approx(single.beta) and ladder["a"].cov == pytest.approx(single.cov)
    assert ladder["b"].r2 > ladder["a"].r2


def test_logistic(table):
    d, df = table
    X = np.column_stack([np.ones(len(d["b"])), d["x1"]])
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ beta))
        inv = np.linalg.inv(X.T @ (X * (p * (1 - p))[:, None]))
        beta = beta + inv @ X.T @ (d["b"] - p)
    p = 1 / (1 + np.exp(-X @ beta))
    fit = linear.fit_logistic(df, "b", ["x1"], "g")
    assert fit.beta == pytest.approx(beta, abs=1e-7)
    assert fit.cov == pytest.approx(sandwich(X, d["b"] - p, d["g"], inv), abs=1e-7)


def test_reset_and_heteroskedasticity(table):
    d, df = table
    fit = linear.fit_ols(df, "y", ["x1", "x2"], "g")
    X = np.column_stack([np.ones(len(d["y"])), d["x1"], d["x2"]])
    u = d["y"] - X @ fit.beta
    fitted = X @ fit.beta
    wide = np.column_stack([X, fitted**2, fitted**3])
    ssr = np.sum((d["y"] - wide @ np.linalg.lstsq(wide, d["y"], rcond=None)[0]) ** 2)
    f = (u @ u - ssr) / 2 / (ssr / (len(u) - 5))
    assert linear.reset_test(df, fit, "y", "g")["f"] == pytest.approx(f, rel=1e-6)
    v = u**2 - np.mean(u**2)
    aux = u**2 - X @ np.linalg.lstsq(X, u**2, rcond=None)[0]
    assert linear.breusch_pagan(df, fit, "y")["lm"] == pytest.approx(len(u) * (1 - aux @ aux / (v @ v)), rel=1e-6)


def test_vif(table):
    d, df = table
    corr = np.corrcoef([d["x1"], d["x2"], d["y"]])
    assert list(linear.vif(df, ["x1", "x2", "y"]).values()) == pytest.approx(list(np.diag(np.linalg.inv(corr))))


def test_missing_rows_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 6.0), (4.0, 8.5)], "x double, y double")
    assert linear.fit_ols(df, "y", ["x"]).n == 3


def test_multiple_testing():
    p = [0.01, 0.04, 0.03, 0.005]
    assert linear.holm(p) == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert linear.benjamini_hochberg(p) == pytest.approx([0.02, 0.04, 0.04, 0.02])


def test_tails():
    assert dist.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert dist.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert dist.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert dist.f_tail(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)
    assert dist.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857142857)


def test_draws_use_every_cluster_count(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "c int, y double, p double").withColumn("part", F.lit("all"))
    sums = bootstrap.cluster_sums(df, "c", "part", "y", ["p"])
    columns = ["n", "sy", "syy", "p_se2", "p_abs"]
    first = bootstrap.replicate_sums(sums, "c", columns, 200, 7, "_scope").orderBy("replicate").collect()
    again = bootstrap.replicate_sums(sums.repartition(3), "c", columns, 200, 7, "_scope").orderBy("replicate").collect()
    assert [r["n"] for r in first] == [100.0] * 200
    assert [r["sy"] for r in first] == pytest.approx([r["sy"] for r in again])
    means = np.array([r["sy"] / 100 for r in first])
    y = np.array([r[1] for r in rows])
    assert means.mean() == pytest.approx(y.mean(), abs=0.08) and means.std() == pytest.approx(y.std() / 10, rel=0.25)


@pytest.mark.parametrize("n, p", [(0, 0.3), (1, 0.5), (7, 0.25), (60, 0.9)])
def test_binomial_quantiles(n, p):
    below = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    u = (np.arange(997) + 0.5) / 997
    assert bootstrap.binomial_quantile(u, n, p).tolist() == np.searchsorted(below, u, side="right").tolist()


def test_blocks_share_out_every_draw():
    size, length, replicates = 1030, 100, 300
    blocks = range(-(-size // length))
    shares = np.array([bootstrap.block_draws("s", b, size, replicates, 5, length) for b in blocks])
    assert (shares.sum(axis=0) == size).all()
    assert shares.mean(axis=1) == pytest.approx([100.0] * 10 + [30.0], rel=0.06)
    assert shares[0].std() == pytest.approx((size * 0.1 * 0.9) ** 0.5, rel=0.3)
    counts = np.concatenate([np.concatenate([c for _, c in bootstrap.block_counts("s", b, size, replicates, 5, length)]) for b in blocks], axis=1)
    assert counts.shape == (replicates, size) and (counts.sum(axis=1) == size).all()
    # one cluster's count is binomial with mean 1 and variance 1 - 1 / size; different clusters repel each other a little
    assert counts.mean() == 1 and counts.var() == pytest.approx(1, rel=0.02)
    assert len({tuple(row) for row in counts}) == replicates


def test_sums_of_several_blocks(spark):
    df = spark.createDataFrame([(i % 90, "s%d" % (i % 3), float(i % 4), float(i % 7)) for i in range(900)], "c int, m string, y double, a double")
    sums = bootstrap.cluster_sums(df, "c", "m", "y", ["a"])
    wide = bootstrap.replicate_sums(sums, "c", ["n", "sy"], 50, 3, "_scope", "Overall", block=16)
    again = bootstrap.replicate_sums(sums.repartition(5, "n"), "c", ["n", "sy"], 50, 3, "_scope", "Overall", block=16)
    got = {(r["replicate"], r["scope"]): (r["n"], r["sy"]) for r in wide.collect()}
    assert got == {(r["replicate"], r["scope"]): (r["n"], r["sy"]) for r in again.collect()}
    # clusters hold the rows of one scope, so the overall number of drawn rows is fixed, that of a scope is not
    assert all(sum(got.get((r, s), (0, 0))[0] for s in ("s0", "s1", "s2")) == 900 for r in range(50))


def test_empty_bootstrap(spark):
    df = spark.createDataFrame([], "c int, m string, y double, a double")
    assert bootstrap.bootstrap_metrics(df, "c", "y", "a", "m", replicates=5).collect() == []


def test_paired_difference_of_equal_models_is_zero(spark):
    df = spark.createDataFrame([(i % 9, "s%d" % (i % 2), float(i % 4), 1.0) for i in range(60)], "c int, m string, y double, a double").withColumn("b", F.col("a"))
    out = bootstrap.paired_differences(df, "c", "m", "y", "a", ["b"], replicates=20).collect()
    assert len(out) == 9 and all(r["mean_delta"] == pytest.approx(0) for r in out)


def test_kruskal_wallis_known_value(spark):
    groups = {"a": [1.0, 2.0, 3.0, 4.0], "b": [2.0, 3.0, 5.0, 6.0], "c": [7.0, 8.0, 9.0, 9.0]}
    rows = [("f", g, v) for g, vs in groups.items() for v in vs]
    r = stats.kruskal_wallis(spark.createDataFrame(rows, "feature string, market string, value double"), "feature", "market", "value").first()
    data = [v for vs in groups.values() for v in vs]
    ranks = {v: np.mean([i + 1 for i, x in enumerate(sorted(data)) if x == v]) for v in data}
    n = len(data)
    h = 12 / (n * (n + 1)) * sum(sum(ranks[v] for v in vs) ** 2 / len(vs) for vs in groups.values()) - 3 * (n + 1)
    h /= 1 - sum(data.count(v) ** 3 - data.count(v) for v in set(data)) / (n**3 - n)
    assert r["h"] == pytest.approx(h) and r["p_value"] == pytest.approx(math.exp(-h / 2))


def test_group_split_is_exact_and_disjoint(spark):
    df = spark.range(500).selectExpr("id % 101 as track", "id as row")
    sides = design.group_split(df, "track", 0.2, 3).groupBy("track").agg(F.count_distinct("is_test").alias("k"), F.bool_or("is_test").alias("t"))
    row = sides.agg(F.max("k"), F.count_if("t"), F.count("*")).first()
    assert tuple(row) == (1, math.ceil(0.2 * 101), 101)


def test_unknown_p_values_count_for_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", 0.01), ("c", 0.04), ("d", float("nan"))], "f string, p double")
    got = {r["f"]: (r["p_holm"], r["p_bh"]) for r in stats.with_benjamini_hochberg(stats.with_holm(df, "p"), "p").collect()}
    assert got["a"] == got["d"] == (None, None)
    assert got["b"] == pytest.approx((0.02, 0.02)) and got["c"] == pytest.approx((0.04, 0.04))


def test_constant_feature_has_no_adjusted_p(spark):
    rows = [("flat", g, 1.0) for g in "aabb"] + [("f", "a", 1.0), ("f", "a", 2.0), ("f", "b", 3.0), ("f", "b", 4.0)]
    got = {r["feature"]: r for r in stats.kruskal_wallis(spark.createDataFrame(rows, "feature string, market string, value double"), "feature", "market", "value").collect()}
    assert got["flat"]["h"] is None and got["flat"]["p_holm"] is None and got["f"]["p_holm"] == pytest.approx(got["f"]["p_value"])


def test_degenerate_tables_and_columns(spark):
    one_row = stats.chi_square(spark.createDataFrame([("x", c) for c in "abb"], "r string, c string"), "r", "c").first()
    assert one_row["n"] == 3 and one_row["df"] == 0 and one_row["chi_square"] is None and one_row["cramers_v"] is None
    rows = [(float(i), 2.0 * i, 7.0, float(i % 3), float("nan") if i == 0 else 1.0 * i) for i in range(12)]
    got = {(r["x"], r["y"]): r for r in stats.spearman(spark.createDataFrame(rows, "a double, b double, k double, c double, n double"), "a", ["a", "b", "k", "c", "n"]).collect()}
    assert got["a", "b"]["rho"] == pytest.approx(1) and got["a", "b"]["p_value"] == 0 and got["a", "k"]["rho"] is None and got["a", "n"]["n"] == 11
    frame = spark.createDataFrame([(float(i), float(i * i), 5.0) for i in range(9)], "a double, b double, k double")
    found = linear.vif(frame, ["a", "b", "k"])
    assert found["k"] == math.inf and 1 < found["a"] < 100


def test_separated_logistic_fit_says_so(spark):
    df = spark.createDataFrame([(i, float(i), float(i > 9)) for i in range(20)], "c int, x double, y double")
    with pytest.raises(ValueError, match="converge"):
        linear.fit_logistic(df, "y", ["x"], "c")


def test_a_deep_forest_cut_at_a_depth_is_the_forest_of_that_depth(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from chartspark.operators import forest

    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = np.sin(6 * x[:, 0]) + x[:, 1] ** 2
    rows = spark.createDataFrame([(i % 40, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "g int, a double, b double, c double, y double").coalesce(1).cache()
    names = ["a", "b", "c"]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    fit = lambda depth: RandomForestRegressor(labelCol="y", seed=3, maxDepth=depth, numTrees=5, minInstancesPerNode=2, featureSubsetStrategy="all").fit(vectors)
    nodes = forest.NodeTable(fit(6)).predict(x, (2, 4, 6))
    for place, depth in enumerate((2, 4, 6)):
        wanted = [r.prediction for r in fit(depth).transform(vectors).collect()]
        np.testing.assert_allclose(nodes[:, place], wanted)
    found = forest.search_forest(rows, names, "y", "g", forest.Grid(depths=(1, 4), leaves=(2, 150), trees=3, folds=3))
    assert len(found.scores) == 12 and (found.max_depth, found.min_leaf) == (4, 2) and found.model.getNumTrees == 3
    folds = {}
    for r in forest.group_folds(rows, "g", 3, 42).collect():
        assert folds.setdefault(r.g, r.fold) == r.fold


def test_dual_scores_keep_repeated_and_null_keys(spark):
    from chartspark.operators import forest

    spec = design.FeatureSpec(audio=("energy", "spectral_centroid"), lyrics=("repetition_ratio", "word_count"), markets=("A", "B"), base="A")
    kinds = "k int, " + ", ".join(f"{c} double" for c in spec.continuous) + f", {spec.mode} string, {spec.market} string"
    rows = spark.createDataFrame([(k, *[float(k or 0)] * len(spec.continuous), "major", "A") for k in (1, 1, 1, None)], kinds)
    fit = linear.LinearFit(spec.columns, np.ones(len(spec.columns)), None, None, None, 4, 0.0, 0.0)
    found = forest.dual_scores(rows, spec, design.fit_scaler(rows, spec), dict.fromkeys(spec.continuous, 0.0), fit, None, ["k"]).collect()
    assert sorted(str(r.k) for r in found) == ["1", "1", "1", "None"] and len({r.ols_prediction for r in found if r.k}) == 1


SPLIT_SPEC = design.FeatureSpec(
    key="k", market="m", target="y", audio=("e",), lyrics=("word_count",), year="yr", mode="mode_text", interactions=("e",), markets=("A", "B"), base="A",
    logged=(), tier_cuts=(5.0,), fill={},
)


@pytest.fixture(scope="module")
def split_design(spark):
    rows = [(i // 2, "AB"[i % 2], float(i % 11), float(i % 7), float(i % 5), 2000.0 + i % 3, "major" if i % 3 else "minor") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, m string, y double, e double, word_count double, yr double, mode_text string")
    split = design.group_split(df, "k", 0.2, 1)
    fitted = design.fit_scaler(split.where("not is_test"), SPLIT_SPEC)
    return split, design.design_matrix(split, SPLIT_SPEC, fitted, ["k", "m", "y", "is_test"])


def statuses(checks):
    return {r["check"]: r["status"] for r in checks.collect()}


def test_sound_split_passes_all_checks(split_design):
    split, x = split_design
    found = statuses(design.split_checks(x, SPLIT_SPEC, split, min_test_rows=20, drift_limit=10.0, balance_limit=0.6))
    assert len(found) == 18 and set(found.values()) == {"PASS"}


def test_broken_splits_are_found(split_design, spark):
    split, x = split_design
    wrong = x.withColumn("mode", F.lit(0.5)).withColumn("e_std__x__B", F.col("e_std")).withColumn("is_test", F.col("y") > 8)
    found = statuses(design.split_checks(wrong, SPLIT_SPEC, split, min_test_rows=1000))
    bad = {"shared_groups", "worst_mean", "worst_deviation", "not_binary", "base_not_zero", "interaction_off", "least_variance", "repeat_differs"}
    assert {c for c, s in found.items() if s == "FAIL"} >= bad - {"worst_mean", "worst_deviation"}
    assert found["least_market_rows"] == found["empty_cells"] == found["target_gap"] == "WARNING"
    holes = x.withColumn("y", F.when(F.col("y") > 1, F.col("y")))
    assert statuses(design.split_checks(holes, SPLIT_SPEC))["not_finite"] == "FAIL"
    leak = design.FeatureSpec(audio=("rank",), lyrics=(), interactions=(), markets=("A",), base="A")
    assert [design.design_root(c) in leak.forbidden for c in leak.columns][0] and design.design_root("e_std__x__B") == "e"


def test_seed_audit_agrees_with_the_checks_of_its_seed(split_design):
    split, x = split_design
    audit = {r["seed"]: r for r in design.seed_audit(split.drop("is_test"), SPLIT_SPEC, [0, 1, 2], min_test_rows=20).collect()}
    own = {r["check"]: r["value"] for r in design.split_checks(x, SPLIT_SPEC).collect()}
    assert sorted(audit) == [0, 1, 2]
    for name in ("market_drift", "least_market_rows", "empty_cells", "target_gap"):
        assert audit[1][name] == pytest.approx(own[name])


def test_list_hashes_do_not_depend_on_partitions(spark):
    ids = spark.range(1000).select((F.col("id") % 2 == 0).alias("is_test"), F.floor(F.col("id") / 2).alias("place"), (F.col("id") * 3).alias("k"))
    got = {r["is_test"]: (r["n"], r["digest"]) for r in design.list_hashes(ids.repartition(7, "k"), "is_test", "place", "k", fan=10).collect()}

    def tree(values):
        level = [str(v) for v in values]
        for _ in range(2):
            level = [hashlib.sha256(",".join(level[i : i + 10]).encode()).hexdigest() for i in range(0, len(level), 10)]
        return hashlib.sha256(",".join(level).encode()).hexdigest()

    assert got == {s: (500, tree([3 * i for i in range(1000) if (i % 2 == 0) == s])) for s in (True, False)}


def test_saved_model_predicts_raw_rows(split_design, spark, tmp_path):
    split, x = split_design
    train = x.where("not is_test")
    scaler = design.fit_scaler(split.where("not is_test"), SPLIT_SPEC)
    fit = linear.fit_ols(train, "y", [c for c in SPLIT_SPEC.columns])
    medians = {**design.train_medians(split.where("not is_test"), SPLIT_SPEC), "mode": 1.0}
    saved_model.save_model(spark, str(tmp_path / "m"), SPLIT_SPEC, scaler, fit, medians)
    model = saved_model.load_model(spark, str(tmp_path / "m"))
    assert model.columns == fit.columns and model.beta.tolist() == fit.beta.tolist() and model.scaler == scaler
    assert model.spec.columns == SPLIT_SPEC.columns and model.spec.markets == ("A", "B")
    own = {r["k"]: r["p"] for r in linear.with_const(x).where("m = 'B'").select("k", linear.prediction(fit.columns, fit.beta).alias("p")).collect()}
    again = {r["k"]: r for r in saved_model.predict_raw(split.where("m = 'B'").drop("y"), model).collect()}
    assert {k: r["predicted"] for k, r in again.items()} == pytest.approx(own) and all(r["known_market"] for r in again.values())

    rows = [(1, "A", 2.0, 3.0, 2001.0, "major"), (2, "Z", 2.0, 3.0, 2001.0, "major"), (3, None, 2.0, 3.0, 2001.0, "major"), (4, "B", None, 3.0, 2001.0, "major"),
            (5, "B", float("nan"), 3.0, 2001.0, "major"), (6, "A", 2.0, 3.0, 2001.0, None), (7, "A", 2.0, 3.0, 2001.0, "odd")]
    raw = spark.createDataFrame(rows, "k long, m string, e double, word_count double, yr double, mode_text string").withColumn("e_std", F.lit("extra"))
    plain = {r["k"]: r for r in saved_model.predict_raw(raw, model).collect()}
    assert plain[1]["predicted"] == plain[2]["predicted"] == plain[3]["predicted"] and plain[1]["e_std"] == "extra"
    assert [plain[k]["known_market"] for k in (1, 2, 3)] == [True, False, False]
    assert all(plain[k]["predicted"] is None for k in (4, 5, 6, 7))
    filled = {r["k"]: r["predicted"] for r in saved_model.predict_raw(raw, model, fill=True).collect()}
    assert filled[4] == filled[5] is not None and filled[6] == filled[7] == filled[1] == plain[1]["predicted"]
    assert saved_model.predict_raw(raw.limit(0), model).collect() == []
    spark.createDataFrame([("mean", 0, "e", 1.0)], saved_model.SCHEMA).write.parquet(str(tmp_path / "part"))
    with pytest.raises(ValueError, match="holds no model"):
        saved_model.load_model(spark, str(tmp_path / "part"))


def test_cohort_influence_against_hat_matrices(spark):
    rng = np.random.default_rng(11)
    n = 240
    names = [None, "a", "b", "few"]
    g = np.array([0] * 90 + [1] * 60 + [2] * 88 + [3] * 2)
    x = np.exp(rng.normal(size=n) * 2) + 1e6 * (g == 1)
    w, y = rng.normal(size=n), rng.normal(size=n) + 1e5
    rows = [(i, names[a], float(p), float(q), float(r)) for i, (a, p, q, r) in enumerate(zip(g, x, w, y))]
    df = spark.createDataFrame([*rows, (900, "a", None, 1.0, 1.0), (901, "b", 1.0, float("nan"), 1.0)], "i int, g string, x double, w double, y double")
    for parts in (1, 7):
        got = {r.i: r for r in influence.with_cohort_influence(df.repartition(parts), "y", ["x", "w"], ["g"]).collect()}
        assert set(got) == set(range(n))
        for k in range(3):
            at = np.flatnonzero(g == k)
            X = np.column_stack([np.ones(len(at)), x[at] - x[at].mean(), w[at]])
            H = X @ np.linalg.inv(X.T @ X) @ X.T
            u = y[at] - H @ y[at]
            h, s2 = np.diag(H), u @ u / (len(at) - 3)
            assert [got[i].leverage for i in at] == pytest.approx(h, abs=1e-9)
            assert [got[i].cooks_distance for i in at] == pytest.approx(u * u / (3 * s2) * h / (1 - h) ** 2, rel=1e-6)
        # two rows and three parameters: the fit goes through them, there is no Cook's distance
        assert [got[i].cooks_distance for i in (238, 239)] == [None, None]


def test_transform_audit_of_cohorts(spark):
    rng = np.random.default_rng(3)
    raw, w, y = np.floor(np.exp(rng.normal(size=120) + 5)), rng.normal(size=120), rng.normal(size=120)
    df = spark.createDataFrame([("k", *map(float, r)) for r in zip(raw, w, y)], "g string, x double, w double, y double")
    rows = {r.form: r for r in influence.transform_audit(df, "x", "y", ["w"], ["g"], 300.0).collect()}
    assert set(rows) == set(influence.FORMS)
    for form, v in (("raw", raw), ("log1p", np.log1p(raw))):
        X = np.column_stack([np.ones(120), v, w])
        h = np.diag(X @ np.linalg.inv(X.T @ X) @ X.T)
        z = (v - v.mean()) / v.std()
        r = rows[form]
        assert (r.n, r.p, r.n_over_2p, r.n_over_3p) == (120, 3, int((h > 6 / 120).sum()), int((h > 9 / 120).sum()))
        assert r.max_leverage == pytest.approx(h.max()) and r.high_mean_leverage == pytest.approx(h[raw >= 300].mean())
        assert r.n_high == int((raw >= 300).sum()) and r.max_abs_z == pytest.approx(np.abs(z).max()) and r.n_abs_z_over_3 == int((np.abs(z) > 3).sum())
        assert r.median == pytest.approx(np.median(v)) and r.iqr == pytest.approx(np.quantile(v, 0.75) - np.quantile(v, 0.25))
        assert r.vif == pytest.approx(1 / (1 - np.corrcoef(v, w)[0, 1] ** 2))
    assert influence.transform_audit(df.where("x < 0"), "x", "y", ["w"], ["g"], 300.0).count() == 0


def test_partners_of_rows_with_equal_keys(spark):
    df = spark.createDataFrame([(i // 3, float(i)) for i in range(30)], "k int, x double")
    rows = forest.random_partners(df, ["k"], ["x"], 2, 7).collect()
    for repeat in (1, 2):
        assert sorted(r.x for r in rows if r.repeat == repeat) == sorted(r._p_x for r in rows if r.repeat == repeat) == [float(i) for i in range(30)]


def test_expected_counts_of_given_labels(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("a", "y"), ("b", "y"), ("b", "z"), ("c", None)], "r string, c string")
    got = {(r.r, r.c): (r.observed, r.expected, r.row_percent) for r in stats.expected_counts(df, "r", "c", ["x", "y", "none"]).collect()}
    assert got == {
        ("a", "x"): (3, 2.0, 75.0), ("a", "y"): (1, pytest.approx(8 / 6), 25.0), ("a", "none"): (0, 0.0, 0.0),
        ("b", "x"): (0, 1.0, 0.0), ("b", "y"): (1, pytest.approx(4 / 6), 50.0), ("b", "none"): (0, 0.0, 0.0),
    }
    seen = {(r.r, r.c) for r in stats.expected_counts(df, "r", "c").collect()}
    assert seen == {("a", "x"), ("a", "y"), ("b", "y"), ("b", "z")}
