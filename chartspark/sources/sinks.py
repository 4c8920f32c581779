"""Writers: reports, append logs, views, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.operators import integrate, order


def write_report(df: DataFrame, path: str, fmt: str = "parquet", sort: list | None = None) -> None:
    """Overwrite a report folder; arrays become JSON text for CSV."""
    out = df.orderBy(*sort) if sort else df
    if fmt == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        out = out.withColumns({c: F.to_json(c) for c in nested}) if nested else out
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").format(fmt).save(path)


def append_log(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merge_partitions(updates: DataFrame, path: str, keys: list[str], partition: str, order_by: list[str | Column] | None = None) -> DataFrame:
    """Upsert into a table partitioned by one column: only partitions the updates touch are read and rewritten.

    Of updates with the same key the first by order_by counts, without it the first by all other columns, so repeating the
    same updates gives the same table and a retried batch is harmless. The touched partition values of a batch go into the
    scan as a filter. The new rows are first written to the shared folder, because the partitions they replace are also
    their source; a partition with many rows is written by several tasks. Returns the updates as stored.
    """
    spark = updates.sparkSession
    fresh = order.first_per_key(updates, keys, order_by or [c for c in updates.columns if c not in keys]).select(*updates.columns)
    if path_exists(spark, path):
        fresh = scale.cut_lineage(fresh)
        touched = [r[0] for r in fresh.select(partition).distinct().collect()]
        merged = integrate.upsert(stored_partitions(spark, path, partition, touched).select(*updates.columns), fresh, keys)
    else:
        merged = fresh
    ready = scale.cut_lineage(merged)
    ready.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return ready


def stored_partitions(spark: SparkSession, path: str, partition: str, values: list) -> DataFrame:
    """The stored rows with one of the partition values; other partitions are not read."""
    known = [v for v in values if v is not None]
    wanted = F.col(partition).isin(known)
    return spark.read.parquet(path).where(wanted | F.col(partition).isNull() if len(known) < len(values) else wanted)


def handoff(df: DataFrame, conditions: dict[str, Column], columns: list[str], sort: list[str], folder: str, fmt: str = "csv") -> None:
    """One filtered, sorted export per name."""
    for name, condition in conditions.items():
        write_report(df.where(condition).select(*columns), f"{folder}/{name}", fmt, sort)
