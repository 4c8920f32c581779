"""Weekly shards that arrive as files: dedupe against the sink and refresh the aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chartspark.operators import chart, integrate
from chartspark.sources import sinks

WEEKLY_SCHEMA = T.StructType([
    T.StructField("track", T.LongType()),
    T.StructField("market", T.StringType()),
    T.StructField("chart_date", T.DateType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("streams", T.LongType()),
])
KEYS = ["track", "market", "chart_date"]


def ingest_available(
    spark: SparkSession, source: str, facts: str, checkpoint: str, fmt: str = "parquet", files_per_batch: int = 1000,
    options: dict[str, str] | None = None,
) -> None:
    """Merge all new files of a folder into the fact table, then stop.

    Keys are checked against the sink, not against a time window, so files may come late and in any order. The checkpoint
    remembers the files; a batch repeated after a failure rewrites the same partitions with the same rows.
    """
    shards = spark.readStream.schema(WEEKLY_SCHEMA).format(fmt).option("maxFilesPerTrigger", files_per_batch)
    rows = shards.options(**(options or {})).load(source)

    def merge(batch: DataFrame, _: int) -> None:
        clean = chart.clean_fact(batch, KEYS)
        sinks.merge_partitions(clean.select(*WEEKLY_SCHEMA.names), facts, KEYS, "chart_date")

    query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(merge).start()
    query.awaitTermination()


def refreshed_performance(spark: SparkSession, facts: str) -> DataFrame:
    """Performance table of everything ingested so far."""
    return chart.chart_performance(spark.read.schema(WEEKLY_SCHEMA).parquet(facts), "track")


def refresh_changed(facts: DataFrame, performance: DataFrame, changed: DataFrame) -> DataFrame:
    """Performance table in which only the (track, market) pairs of the changed rows are recomputed."""
    pairs = changed.select("track", "market").distinct()
    fresh = chart.chart_performance(facts.join(pairs, ["track", "market"], "left_semi"), "track")
    return integrate.upsert(performance, fresh.select(*performance.columns), ["track", "market"])
