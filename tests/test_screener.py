"""Screener counts meet the quantiles as sums, never as the rows of a market."""

import numpy as np
from pyspark.sql import functions as F

from chartspark.operators import stats


def test_counts_of_uneven_markets(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 10 else "b", float(p), 1e6 + float(y)) for i, (p, y) in enumerate(zip(rng.integers(0, 40, 3000), rng.normal(0, 3, 3000)))]
    rows += [("c", 1.0, None), (None, 2.0, 1e6), ("a", None, 1e6)]
    df = spark.createDataFrame(rows, "m string, p double, y double")
    out = stats.screener_counts(df, "m", "p", "y", F.col("y") >= 1e6)
    got = {r.in_top: r for r in out.collect()}
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    cut = {m: np.quantile([p for k, p, _ in known if k == m], 0.78) for m in "abc"}
    for side in (True, False):
        mine = [y for m, p, y in known if (p >= cut[m]) == side]
        y = np.array([v for v in mine if v is not None])
        assert (got[side].n, got[side].hits) == (len(mine), (y >= 1e6).sum())
        np.testing.assert_allclose([got[side].mean, got[side].variance], [y.mean(), y.var(ddof=1)], rtol=1e-9)
    assert (got[None].n, got[None].mean, got[None].variance) == (2, 1e6, 0.0)


def test_no_task_joins_the_rows_of_a_market(spark):
    df = spark.range(1000).select(F.lit("a").alias("m"), (F.col("id") % 5).cast("double").alias("p"), F.col("id").cast("double").alias("y"))
    plan = stats.screener_counts(df, "m", "p", "y", F.col("y") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan  # the joins read sums that were written once
