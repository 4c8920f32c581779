"""Exact order statistics that never hold one group in one task.

Values are first counted per (keys, value). A pass over the values gives equal-depth edges, every value goes to a bucket,
small bucket totals give each bucket its starting position, and only rows of one bucket are ordered together. Edges only
steer the work; results are exact. There are as many buckets as shuffle partitions, at every size. NULL and NaN are no values.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale

ALL_KEY = "_all"


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide numeric columns to (keys, name, value) rows."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, name, value)


def _edges(values: DataFrame, value: str, pieces: int) -> list[float]:
    probs = [i / pieces for i in range(1, pieces)]
    found = values.stat.approxQuantile(value, probs, 0.25 / pieces)
    return sorted({e for e in found if e is not None}) or [0.0]


def known(df: DataFrame, value: str) -> DataFrame:
    """Rows with a value."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def counted_positions(df: DataFrame, keys: list[str], value: str, pieces: int | None = None) -> DataFrame:
    """(keys, value, n, start, total): n copies of value take the 0-based positions start .. start + n - 1."""
    counts = known(df, value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return positions_of_counts(counts, keys, value, pieces, df)


def positions_of_counts(
    counts: DataFrame, keys: list[str], value: str, pieces: int | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """The same from a table that already holds each value of a key once with its count n."""
    counts, source = known(counts, value), known(counts if rows is None else rows, value)
    pieces = pieces or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splits = [float("-inf"), *_edges(source.select(F.col(value).cast("double").alias("v")), "v", pieces), float("inf")]
    double = counts.withColumn("_v", F.col(value).cast("double"))
    placed = Bucketizer(splits=splits, inputCol="_v", outputCol="_bucket").transform(double).drop("_v")
    # one row per (keys, bucket): the window below sees at most len(splits) rows per key
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_in"))
    per_key = W.partitionBy(*keys)
    running = F.sum("_in").over(per_key.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    totals = totals.withColumn("_base", running - F.col("_in")).withColumn("total", F.sum("_in").over(per_key))
    inside = F.sum("n").over(
        W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    )
    # the window orders both by bucket; as a merge neither the counted values nor the totals of many keys pass the driver
    return (
        placed.join(totals.drop("_in").hint("merge"), [*keys, "_bucket"])
        .withColumn("start", F.col("_base") + inside - F.col("n"))
        .drop("_bucket", "_base")
    )


def quantile_columns(value: str, probs: list[float], names: list[str]) -> list[Column]:
    """Linear-interpolated quantiles as aggregates over counted positions."""
    out = []
    first, last = F.col("start"), F.col("start") + F.col("n") - 1
    for p, name in zip(probs, names):
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        v_low = F.max(F.when((first <= low) & (low <= last), F.col(value)))
        v_high = F.max(F.when((first <= high) & (high <= last), F.col(value)))
        share = F.max(at - low)
        out.append((v_low + share * (v_high - v_low)).alias(name))
    return out


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str]) -> DataFrame:
    """Exact quantiles with linear interpolation per key (one row in all when keys is empty)."""
    use = keys or [ALL_KEY]
    base = df if keys else df.withColumn(ALL_KEY, F.lit(1))
    placed = counted_positions(base.withColumn("_qv", F.col(value).cast("double")), use, "_qv")
    if keys:
        return placed.groupBy(*keys).agg(*quantile_columns("_qv", probs, names))
    return placed.agg(*quantile_columns("_qv", probs, names))


def with_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str]) -> DataFrame:
    """Group quantiles on every row of the group; NULL where the group has no value."""
    return scale.join_back(df, exact_quantiles(df, keys, value, probs, names), keys)


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, average_rank, total): 1-based rank, ties share the mean."""
    placed = counted_positions(df, keys, value)
    return placed.withColumn("average_rank", F.col("start") + (F.col("n") + 1) / 2).drop("start")


def with_average_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank on every row; rows without value get NULL."""
    ranks = average_ranks(df, keys, value).select(*keys, value, F.col("average_rank").alias(out))
    return df.join(ranks, [*keys, value], "left")


def first_per_key(df: DataFrame, keys: list[str], position: list[str | Column]) -> DataFrame:
    """First row of each key by position, as an aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*position)
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def neighbour_steps(df: DataFrame, keys: list[str], at: str, block: Column, out: str = "previous") -> DataFrame:
    """Previous position inside each key, ordered in blocks.

    block must not decrease with the position. Only rows of one (key, block) are ordered together; the first row of a
    block takes the last position of the key's block before it, found on one row per (key, block).
    """
    rows = df.withColumn("_block", block)
    ends = rows.groupBy(*keys, "_block").agg(F.max(at).alias("_last"))
    ends = ends.withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy("_block"))).drop("_last")
    near = F.lag(at).over(W.partitionBy(*keys, "_block").orderBy(at))
    return (
        rows.withColumn("_near", near)
        .join(ends, [*keys, "_block"])
        .withColumn(out, F.coalesce("_near", "_before"))
        .drop("_near", "_before", "_block")
    )


def run_lengths(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive whole positions per key: (keys, first, run_length). Positions are distinct per key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(at))
    islands = df.withColumn("_island", F.col(at) - place)
    return islands.groupBy(*keys, "_island").agg(
        F.min(at).alias("first"), F.count(F.lit(1)).alias("run_length")
    ).drop("_island")
