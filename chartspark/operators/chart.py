"""Weekly chart facts: ranking, cleaning, performance, quarterly sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark.functions.clean import chart_score, closed_range_label
from chartspark.operators import order as first_rows

# Rank strata of the quarterly sample and songs taken from each.
RANK_STRATA = [("1-10", 1, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("51+", 51, None)]
SONGS_PER_STRATUM = 10


def top_positions(df: DataFrame, groups: list[str], order: list[Column], positions: int, out: str = "rank") -> DataFrame:
    """First rows of each group with their position.

    The filter on row_number lets Spark keep only `positions` rows per group on the map side before the shuffle,
    so a hot group reaches its task already cut to the chart length.
    """
    place = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= positions)


def weekly_ranking(
    sales: DataFrame, item: str, market: str, date: str, amount: str, positions: int = 200, exact_total: str = "bigint"
) -> DataFrame:
    """Rows of sales to one ranked row per (item, market, date)."""
    totals = sales.groupBy(item, market, date).agg(F.sum(amount).cast(exact_total).alias("streams"))
    return top_positions(totals, [market, date], [F.desc("streams"), F.asc(item)], positions)


def clean_fact(
    df: DataFrame,
    key: list[str],
    market: str = "market",
    markets: list[str] | None = None,
    rank: str = "rank",
    rank_range: tuple[int, int] = (1, 200),
    date: str = "chart_date",
    order_by: list[str | Column] | None = None,
) -> DataFrame:
    """The first row of each key, kept if its market is known, its rank inside the chart and its date present.

    First is by order_by, without it by all other columns. A key whose first row is not valid drops out.
    """
    first = first_rows.first_per_key(df, key, order_by or [c for c in df.columns if c not in key])
    keep = F.col(rank).between(*rank_range) & F.col(date).isNotNull()
    if markets is not None:
        keep = keep & F.col(market).isin(markets)
    return first.where(keep).select(*df.columns)


def chart_performance(
    df: DataFrame, item: str, market: str = "market", rank: str = "rank", top: int = 101, front: int = 10
) -> DataFrame:
    """Average, best and count of ranks per (item, market); partial sums run before the shuffle."""
    r = F.col(rank)
    return (
        df.groupBy(item, market)
        .agg(
            F.avg(r).alias("lifetime_average_rank"),
            F.min(r).alias("peak_rank"),
            F.count(F.lit(1)).alias("weeks_on_chart"),
            F.count_if(r.between(1, front)).alias("weeks_in_top10"),
        )
        .withColumn("chart_score", chart_score("lifetime_average_rank", top))
    )


def best_rank(df: DataFrame, groups: list[str], rank: str = "rank") -> DataFrame:
    return df.groupBy(*groups).agg(F.min(rank).alias(rank))


def seeded_order(*parts: str | Column, seed: int) -> Column:
    """Repeatable pseudo-random order that does not depend on partitioning."""
    texts = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))))


def stratified_sample(
    df: DataFrame,
    item: str,
    groups: list[str],
    rank: str = "rank",
    strata: list[tuple[str, int, int | None]] = RANK_STRATA,
    per_stratum: int = SONGS_PER_STRATUM,
    seed: int = 42,
) -> DataFrame:
    """Fixed number of items per (group, stratum); a short stratum is taken whole."""
    labelled = df.withColumn("rank_stratum", closed_range_label(rank, strata)).where("rank_stratum is not null")
    order = [seeded_order(item, seed=seed), F.col(item)]
    picked = top_positions(labelled, [*groups, "rank_stratum"], order, per_stratum, out="_place")
    return picked.drop("_place").withColumn("sampled", F.lit(True))


def stratum_shortage(
    df: DataFrame, groups: list[str], rank: str = "rank", strata=RANK_STRATA, per_stratum: int = SONGS_PER_STRATUM
) -> DataFrame:
    """Strata with fewer items than wanted, empty strata of a seen group included."""
    labelled = df.withColumn("rank_stratum", closed_range_label(rank, strata))
    counts = labelled.groupBy(*groups).agg(
        *[F.count_if(F.col("rank_stratum") == label).alias(label) for label, _, _ in strata]
    )
    pairs = F.array(*[F.struct(F.lit(label).alias("s"), F.col(f"`{label}`").alias("n")) for label, _, _ in strata])
    return (
        counts.select(*groups, F.explode(pairs).alias("p"))
        .select(*groups, F.col("p.s").alias("rank_stratum"), F.col("p.n").alias("n_available"))
        .where(F.col("n_available") < per_stratum)
        .withColumn("n_missing", F.lit(per_stratum).cast("bigint") - F.col("n_available"))
    )
