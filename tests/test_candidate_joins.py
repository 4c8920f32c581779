"""Candidates of a small file: all tasks share the work, and no side of the join goes through the driver."""

from chartspark.plans import matching as queries

SF = "/root/testdata/sf0.001"


def test_candidates_are_dealt_over_all_tasks(spark):
    assert queries.candidates(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_candidates_are_never_broadcast(spark):
    assert "Broadcast" not in queries.candidates(spark, SF)._jdf.queryExecution().executedPlan().toString()
