"""Evidence is dealt by song once, in pieces that grow in number with the input; the decision needs no further exchange."""

from chartspark import scale
from chartspark.plans import matching

SF = "/root/testdata/sf0.001"


def test_pieces_grow_in_number_with_the_input(spark):
    line = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert scale.pieces_of(line, "l_orderkey", piece=1000).rdd.getNumPartitions() >= scale.input_bytes(line) // 1000


def test_decision_moves_its_rows_once(spark):
    plan = matching.decision(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
