"""The modelling table is prepared without sending growing tables through the driver, and its charts are made once."""

from chartspark.plans import dataset, shapes

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_growing_table_is_broadcast_and_line_items_are_read_for_features_only(spark):
    plan = plan_of(dataset.modeling(spark, SF))
    sent = plan.split("BroadcastExchange")[1:]
    assert len(sent) == 1 and "is_sampled" in sent[0].split("\n")[1]  # the sample is bounded by quarters and strata
    assert plan.count("l_partkey#") > 0 and "l_shipdate" not in plan  # the charts stand in a table of their own


def test_suppliers_meet_line_items_without_order_and_broadcast(spark):
    plan = plan_of(shapes.line_market(spark, SF, "l_partkey"))
    assert "ShuffledHashJoin" in plan
    broadcast = plan.split("BroadcastExchange")[1:]
    assert all("s_suppkey" not in part.split("\n")[1] for part in broadcast)


def test_texts_are_cut_once(spark):
    counted = shapes.lyric_rows(spark, SF).where("word_count is not null")
    assert plan_of(counted).count("split(trim(") == 1
