"""Pairing for the importance moves rows by shuffles only and scores them once."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from chartspark.operators import forest


def rows(spark):
    return spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).cast("double").alias("x"), F.col("id").cast("double").alias("y"))


def test_rows_and_repeats_are_joined_by_merge(spark):
    plan = forest.random_partners(rows(spark), ["k"], ["x"], 3, 7)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 3


def test_importance_pairs_and_scores_rows_once(spark):
    class Model:
        def transform(self, vectors):
            return vectors.withColumn("prediction", vector_to_array("features")[0])

    out = forest.permutation_importance(Model(), rows(spark), ["x"], "y", ["k"], repeats=2)
    assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 3  # one place a hash order, one pairing
    assert out.collect()[0]["feature"] == "x"
