"""Summaries, distributions and crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark.operators import order

ALL = "ALL"


def with_overall(df: DataFrame, group: str, label: str = ALL) -> DataFrame:
    """Every row once in its group and once in the overall group; aggregate next, so partial sums run first."""
    return df.withColumn(group, F.explode(F.array(F.col(group), F.lit(label))))


def describe(long: DataFrame, keys: list[str], value: str = "value", quantiles: dict[str, float] | None = None) -> DataFrame:
    """n, mean, sample deviation, min, quantiles, max per key."""
    quantiles = quantiles or {"q1": 0.25, "median": 0.5, "q3": 0.75}
    basic = long.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    marks = order.exact_quantiles(long, keys, value, list(quantiles.values()), list(quantiles))
    return basic.join(marks, keys, "left")


def unbiased_shape(n: Column, skew: Column, excess: Column) -> tuple[Column, Column]:
    """Population skewness and excess kurtosis to the bias-corrected forms, NULL below 3 and 4 values."""
    g1 = F.when(n > 2, skew * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6))
    return g1, g2


def full_profile(long: DataFrame, keys: list[str], value: str = "value", digits: int = 4) -> DataFrame:
    """Valid and missing counts, moments, quartiles, spread and bias-corrected shape; features without values drop out."""
    basic = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count(value).alias("valid_n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.skewness(value).alias("_s"),
        F.kurtosis(value).alias("_k"),
    )
    marks = order.exact_quantiles(long, keys, value, [0.25, 0.5, 0.75], ["q25", "median", "q75"])
    n = F.col("valid_n").cast("double")
    g1, g2 = unbiased_shape(n, F.col("_s"), F.col("_k"))
    joined = basic.where("valid_n > 0").join(marks, keys)
    missing = F.col("n_obs") - F.col("valid_n")
    plain = ["mean", "std", "median", "q25", "q75", "min", "max"]
    return joined.select(
        *keys,
        "n_obs",
        "valid_n",
        missing.alias("missing_n"),
        F.round(missing / F.col("n_obs") * 100, 2).alias("missing_pct"),
        *[F.round(c, digits).alias(c) for c in plain],
        F.round(F.col("q75") - F.col("q25"), digits).alias("iqr"),
        F.round(g1, digits).alias("skewness"),
        F.round(g2, digits).alias("kurtosis"),
    )


def missingness(long: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Missing values per (feature, group) and overall."""
    return (
        with_overall(long, group, "Overall")
        .groupBy(feature, group)
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(value).isNull()).alias("missing"))
        .withColumn("pct", F.round(F.col("missing") / F.col("total") * 100, 2))
    )


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of NULLs of each column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def range_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = [f(c).alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.agg(*cols)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def boolean_profile(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(flag).alias("valid"),
        F.count_if(F.col(flag)).alias("true_n"),
        F.count_if(~F.col(flag)).alias("false_n"),
        F.avg(F.col(flag).cast("int")).alias("true_ratio"),
    )


def fixed_histogram(df: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per fixed-width bin and group, empty bins kept; the last bin holds its right edge too."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    known = df.where(F.col(value).isNotNull())
    sizes = known.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    counts = (
        known.where(F.col(value).between(low, high)).groupBy(group, place.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    )
    axis = sizes.select(group, "_size", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    return axis.join(counts, [group, "bin"], "left").select(
        group,
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("bin_left"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("bin_right"),
        n.alias("n"),
        F.round(n / F.col("_size") * 100, 4).alias("pct"),
    )


def frequency(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count and share of each discrete value inside its group; totals come from the counted rows."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(group))
    return counts.withColumn("group_total", total).withColumn("share_pct", F.round(F.col("n") / total * 100, 4))


def bracket_counts(df: DataFrame, group: str, bracket: Column, labels: list[str]) -> DataFrame:
    """Counts per (group, bracket) with empty brackets kept."""
    counted = df.withColumn("_b", bracket).groupBy(group).agg(
        F.count(F.lit(1)).alias("_size"), *[F.count_if(F.col("_b") == label).alias(label) for label in labels]
    )
    cells = F.array(*[F.struct(F.lit(label).alias("b"), F.col(f"`{label}`").alias("n")) for label in labels])
    return counted.select(group, "_size", F.explode(cells).alias("c")).select(
        group,
        F.col("c.b").alias("bracket"),
        F.col("c.n").alias("n"),
        F.round(F.col("c.n") / F.col("_size") * 100, 2).alias("share_pct"),
    )


def crosstab(df: DataFrame, row: str, column: Column, values: list[str]) -> DataFrame:
    """Counts and row percentages with a fixed column list."""
    counts = df.withColumn("_c", column).groupBy(row).agg(
        F.count(F.lit(1)).alias("row_total"), *[F.count_if(F.col("_c") == v).alias(f"{v}_n") for v in values]
    )
    return counts.select(
        row, "row_total", *[f"{v}_n" for v in values],
        *[F.round(F.col(f"{v}_n") / F.col("row_total") * 100, 2).alias(f"{v}_pct") for v in values],
    )


def min_max_scaled(df: DataFrame, columns: list[str], flat: float | None = 0.5, eps: float = 1e-9) -> DataFrame:
    """Columns scaled to 0..1 by their overall range; a constant column becomes `flat`."""
    spans = df.agg(*[f(c).alias(f"_{name}_{c}") for c in columns for name, f in (("lo", F.min), ("hi", F.max))])
    # one row, so the join needs no key: the constant key keeps it an equi-join
    joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(spans.withColumn("_one", F.lit(1))), "_one")
    scaled = []
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        scaled.append(F.when(span > eps, (F.col(c) - F.col(f"_lo_{c}")) / span).otherwise(F.lit(flat)).alias(c))
    return joined.select(*[c for c in df.columns if c not in columns], *scaled)


def pearson_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every column pair in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*keys).agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(
        *[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.x", "c.y", "c.r")


def fingerprint(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """Content hash that depends neither on row order nor on partitioning.

    Each row is hashed on its own; the 64-bit parts are added with wide decimals, which is order-free, and the sums and
    the count are hashed once more.
    """
    types = dict(df.dtypes)
    cells = [
        F.coalesce((F.round(c, digits) if types[c] in ("double", "float") else F.col(c)).cast("string"), F.lit("<null>"))
        for c in [*keys, *columns]
    ]
    digest = F.sha2(F.concat_ws("\u001f", *cells), 256)
    parts = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"p{i}").alias(f"s{i}") for i in range(4)]
    )
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("n_rows", F.sha2(text, 256).alias("fingerprint"))


def registry_rows(df: DataFrame, source: str, row: Column, columns: list[str]) -> DataFrame:
    """Wide report table to long (source, row, column, value) rows."""
    base = df.select(F.lit(source).alias("source"), row.cast("string").alias("row"),
                     *[F.col(c).cast("double").alias(c) for c in columns])
    return base.unpivot(["source", "row"], columns, "column", "value")
