import numpy as np
import pytest
from pyspark.sql import functions as F

from chartspark.operators import order


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{i % 3}", float(v)) for i, v in enumerate(np.round(rng.gamma(2, 10, 3000), 1))]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_quantiles_match_numpy(values):
    rows, df = values
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    for r in order.exact_quantiles(df, ["k"], "v", probs, names).collect():
        expected = np.quantile([v for k, v in rows if k == r["k"]], probs)
        assert [r[n] for n in names] == pytest.approx(list(expected), abs=1e-9)


def test_average_ranks_share_ties(values):
    rows, df = values
    got = {(r["k"], r["v"]): r["average_rank"] for r in order.average_ranks(df, ["k"], "v").collect()}
    for key in {k for k, _ in rows}:
        ordered = sorted(v for k, v in rows if k == key)
        for v in set(ordered):
            places = [i + 1 for i, x in enumerate(ordered) if x == v]
            assert got[key, v] == pytest.approx(sum(places) / len(places))


def test_neighbour_steps_cross_blocks(spark):
    df = spark.createDataFrame([("a", float(t)) for t in (0, 3, 4, 17, 18, 55)], "k string, t double")
    got = {r["t"]: r["previous"] for r in order.neighbour_steps(df, ["k"], "t", F.floor(F.col("t") / 10)).collect()}
    assert got == {0.0: None, 3.0: 0.0, 4.0: 3.0, 17.0: 4.0, 18.0: 17.0, 55.0: 18.0}


def test_first_per_key_follows_position(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, p int, v string")
    assert {tuple(r) for r in order.first_per_key(df, ["k"], ["p"]).select("k", "v").collect()} == {("a", "y"), ("b", "z")}


def test_nan_and_null_are_no_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,), (None,)], "v double")
    assert tuple(order.exact_quantiles(df, [], "v", [0.5, 0.9], ["a", "b"]).first()) == pytest.approx((2.0, 3.6))
    keyed = df.withColumn("k", F.lit("x"))
    assert {r["v"] for r in order.average_ranks(keyed, ["k"], "v").collect()} == {1.0, 2.0, 4.0}
    none = order.exact_quantiles(df.where("v is null"), [], "v", [0.5], ["a"]).collect()
    assert [r["a"] for r in none] == [None]
