"""Plan properties that matter at scale."""

from pathlib import Path

import pytest

from chartspark.operators import order
from chartspark.plans import registry
from chartspark.plans import shapes as S

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranking_is_cut_before_the_shuffle(spark):
    text = plan(S.weekly(spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_needed_columns(spark):
    text = plan(S.perf(spark, SF))
    assert "l_extendedprice" in text and "l_tax" not in text and "l_discount" not in text


@pytest.mark.parametrize("name", ["agg_01_chart_performance", "jon_02_modeling_dataset", "win_04_stratified_sample", "mat_19_decision", "frm_04_segment_similarity"])
def test_no_cartesian_product(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_spread_ranking_orders_within_buckets_only(spark):
    rows = S.table(spark, SF, "lineitem").selectExpr("1 as k", "l_extendedprice as v")
    text = plan(order.counted_positions(rows, ["k"], "v"))
    assert "_bucket" in text


def test_no_local_checkpoint_anywhere():
    word = "local" + "Checkpoint"
    assert not [p for p in (ROOT / "chartspark").rglob("*.py") if word in p.read_text()]
