"""Counted positions are joined by merge, whatever size the planner guesses."""

from chartspark.operators import order


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_without_broadcast(spark):
    rows = spark.createDataFrame([(1, float(v)) for v in (3, 1, 2, 2)], "k int, v double")
    placed = order.counted_positions(rows, ["k"], "v")
    assert "BroadcastExchange" not in plan_of(placed)
    assert sorted((r["v"], r["n"], r["start"], r["total"]) for r in placed.collect()) == [(1.0, 1, 0, 4), (2.0, 2, 1, 4), (3.0, 1, 3, 4)]
