"""Cluster bootstrap of regression metrics from cluster sums.

A replicate draws as many clusters as there are, with replacement. Clusters are numbered in the order of their hashes and cut
into blocks of neighbouring numbers. The draws of a replicate are split over the blocks by a tree of binomial halvings whose
uniforms are hashes of (replicate, node), so the task of a block finds its share of every replicate without seeing the others.
Within the block a counter generator places the draws, and one matrix product turns counts into replicate sums. No draw is
ever a row; one vector per replicate and block leaves a task, added up map side. Results depend on the seed and the block
length only, not on partitioning, and SQL can repeat them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.operators import order
from chartspark.operators.design import seeded_hash

BLOCK = 1024  # clusters a block: 1,000 replicates of counts take 8 MB
NEIGHBOURS = 16  # blocks of one task that follow each other
DRAW_CHUNK = 1 << 20  # draws placed at once
# Increment and multipliers of the SplitMix64 generator.
STEP, FIRST_MIX, SECOND_MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

DOMAIN = (-99.0, 100.0)


def cluster_sums(df: DataFrame, cluster: str, scope: str | None, y: str, predictions: list[str]) -> DataFrame:
    """Per (cluster, scope) sums from which every metric follows."""
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")]
    for p in predictions:
        e = F.col(y) - F.col(p)
        sums += [F.sum(e * e).alias(f"{p}_se2"), F.sum(F.abs(e)).alias(f"{p}_abs")]
    keyed = df if scope is None else df.withColumn("_scope", F.col(scope))
    keys = [cluster] if scope is None else [cluster, "_scope"]
    return keyed.groupBy(*keys).agg(*sums)


def metric_columns(p: str) -> dict[str, Column]:
    """R2, MAE and RMSE of one model from summed columns."""
    n, sst = F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    se2 = F.col(f"{p}_se2")
    return {
        "r2": F.when(sst > 0, 1 - se2 / sst).otherwise(0.0), "mae": F.col(f"{p}_abs") / n, "rmse": F.sqrt(se2 / n),
    }


def base_metrics(df: DataFrame, y: str, prediction: str, scope: str | None = None, overall: str = "Overall", domain=DOMAIN) -> DataFrame:
    """n, R2, MAE, RMSE and out-of-domain share, overall and per scope."""
    e, p = F.col(y) - F.col(prediction), F.col(prediction)
    rows = df.withColumn("scope", F.explode(F.array(F.lit(overall), F.col(scope))) if scope else F.lit(overall))
    sums = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"),
        F.sum(e * e).alias("m_se2"), F.sum(F.abs(e)).alias("m_abs"),
        F.count_if((p < domain[0]) | (p > domain[1])).alias("out_of_domain"),
    )
    return sums.select(
        "scope", "n", *[c.alias(name) for name, c in metric_columns("m").items()], "out_of_domain",
        (F.col("out_of_domain") / F.col("n") * 100).alias("out_of_domain_pct"),
    )


def cluster_places(sums: DataFrame, cluster: str, scope: str, seed: int) -> DataFrame:
    """(scope, cluster, place, size): the clusters of each scope numbered from 0 in the order of their hashes, and their number."""
    own = sums.select(F.col(scope).alias("scope"), F.col(cluster).alias("_cluster")).distinct().withColumn("_h", seeded_hash("_cluster", seed))
    starts = order.counted_positions(own, ["scope"], "_h").select("scope", "_h", "start", F.col("total").alias("size"))
    tie = F.row_number().over(W.partitionBy("scope", "_h").orderBy("_cluster")) - 1
    numbered = own.withColumn("_tie", tie).join(starts, ["scope", "_h"])
    return numbered.select("scope", F.col("_cluster").alias(cluster), (F.col("start") + F.col("_tie")).alias("place"), "size")


def node_hash(replicate: int, scope: str, low: int, high: int, seed: int) -> int:
    """60 bits for the node of blocks [low, high) in a replicate."""
    return int(hashlib.md5(f"{replicate}|{scope}|{low}|{high}|{seed}".encode()).hexdigest()[:15], 16)


def binomial_quantile(u: np.ndarray, n: int, p: float) -> np.ndarray:
    """Smallest k with P(X <= k) > u of a binomial X; probabilities beyond 14 deviations (under 1e-40) are left out."""
    if n == 0:
        return np.zeros(len(u), dtype=np.int64)
    reach = 14 * math.sqrt(n * p * (1 - p)) + 20
    low, high = max(0, int(n * p - reach)), min(n, int(n * p + reach))
    log_first = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    k = np.arange(low, high)
    log_steps = np.log((n - k) / (k + 1)) + (math.log(p) - math.log1p(-p))
    below = np.cumsum(np.exp(log_first + np.concatenate([[0.0], np.cumsum(log_steps)])))
    return low + np.minimum(np.searchsorted(below, u, side="right"), high - low)


def block_draws(
    scope: str, block: int, size: int, replicates: int, seed: int, length: int, path: list[tuple[str, int, int, np.ndarray]] | None = None,
) -> np.ndarray:
    """Draws of each replicate that fall into a block: the path of binomial halvings from all blocks down to it.

    path keeps the nodes (scope, low, high, draws) of the block before, so a neighbour halves only the nodes they do not share.
    """
    path = [] if path is None else path
    while path and not (path[-1][0] == scope and path[-1][1] <= block < path[-1][2]):
        path.pop()
    if not path:
        path.append((scope, 0, -(-size // length), np.full(replicates, size, dtype=np.int64)))
    _, low, high, n = path[-1]
    while high - low > 1:
        middle = (low + high) // 2
        left, both = min(middle * length, size) - low * length, min(high * length, size) - low * length
        u = np.array([node_hash(r, scope, low, high, seed) / 2.0**60 for r in range(replicates)])
        taken = np.empty_like(n)
        for value in np.unique(n):
            at = n == value
            taken[at] = binomial_quantile(u[at], int(value), left / both)
        if block < middle:
            n, high = taken, middle
        else:
            n, low = n - taken, middle
        path.append((scope, low, high, n))
    return n


def block_counts(
    scope: str, block: int, size: int, replicates: int, seed: int, length: int, path: list[tuple[str, int, int, np.ndarray]] | None = None,
) -> Iterator[tuple[int, np.ndarray]]:
    """(first replicate, counts of replicate x place in the block), some replicates at a time."""
    n = block_draws(scope, block, size, replicates, seed, length, path)
    places = min(length, size - block * length)
    keys = np.array([node_hash(r, scope, block, block + 1, seed) for r in range(replicates)], dtype=np.uint64)
    rows = max(1, DRAW_CHUNK // length)
    for first in range(0, replicates, rows):
        part = n[first : first + rows]
        owner = np.repeat(np.arange(len(part)), part)
        slot = np.arange(len(owner)) - np.repeat(np.cumsum(part) - part, part)
        z = keys[first : first + rows][owner] + (slot + 1).astype(np.uint64) * np.uint64(STEP)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST_MIX)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND_MIX)
        z ^= z >> np.uint64(31)
        place = ((z >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)
        counts = np.bincount(owner * places + place.astype(np.int64), minlength=len(part) * places)
        yield first, counts.reshape(len(part), places)


def replicate_sums(
    sums: DataFrame, cluster: str, columns: list[str], replicates: int, seed: int, scope: str, draw_scope: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(replicate, scope, summed columns) of the drawn clusters.

    Each scope draws from its own clusters; with draw_scope, one draw of that name from all clusters serves all scopes. A task
    holds one block: at most `block` clusters times the scopes they occur in.
    """
    sums = scale.cut_lineage(sums.select(cluster, F.col(scope).alias("scope"), *columns).withColumn("_draw", F.lit(draw_scope) if draw_scope else F.col("scope").cast("string")))
    places = cluster_places(sums, cluster, "_draw", seed).withColumnRenamed("scope", "_draw")
    rows = sums.join(places, ["_draw", cluster]).withColumn("_block", F.floor(F.col("place") / block))

    path: list[tuple[str, int, int, np.ndarray]] = []  # each task has its own; one node a halving

    def drawn(group: pd.DataFrame) -> pd.DataFrame:
        name, number, size = str(group["_draw"].iloc[0]), int(group["_block"].iloc[0]), int(group["size"].iloc[0])
        place = (group["place"] - number * block).to_numpy()
        scopes, owner = np.unique(group["scope"].to_numpy(), return_inverse=True)
        out = {(i, c): np.zeros(replicates) for i in range(len(scopes)) for c in columns}
        values = group[columns].to_numpy(dtype=float)
        for first, counts in block_counts(name, number, size, replicates, seed, block, path):
            for i in range(len(scopes)):
                own = owner == i
                found = counts[:, place[own]] @ values[own]
                for j, c in enumerate(columns):
                    out[i, c][first : first + len(found)] = found[:, j]
        parts = [pd.DataFrame({"replicate": np.arange(replicates), "scope": s, **{c: out[i, c] for c in columns}}) for i, s in enumerate(scopes)]
        return pd.concat(parts)

    schema = f"replicate bigint, scope {sums.schema['scope'].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in columns)
    # neighbouring blocks come to one task one after the other, as they share most of their path
    slim = rows.where("_draw is not null").withColumn("_run", F.floor(F.col("_block") / NEIGHBOURS))
    slim = scale.spread_for_cpu(slim, "_draw", "_run")
    return slim.groupBy("_draw", "_run", "_block").applyInPandas(drawn, schema).groupBy("replicate", "scope").agg(*[F.sum(c).alias(c) for c in columns])


def bootstrap_metrics(
    df: DataFrame, cluster: str, y: str, prediction: str, scope: str | None = None, replicates: int = 1000, seed: int = 43,
    alpha: float = 0.05, overall: str = "Overall", block: int = BLOCK,
) -> DataFrame:
    """Percentile intervals of R2, MAE and RMSE, overall and per scope, each scope with its own draws."""
    rows = df.withColumn("_part", F.explode(F.array(F.lit(overall), F.col(scope).cast("string"))) if scope else F.lit(overall))
    sums = cluster_sums(rows, cluster, "_part", y, [prediction])
    columns = ["n", "sy", "syy", f"{prediction}_se2", f"{prediction}_abs"]
    drawn = scale.cut_lineage(replicate_sums(sums, cluster, columns, replicates, seed, "_scope", None, block))
    metrics = drawn.select("scope", "replicate", *[c.alias(name) for name, c in metric_columns(prediction).items()])
    long = order.unpivot(metrics, ["scope"], ["r2", "mae", "rmse"], "metric")
    return order.exact_quantiles(long, ["scope", "metric"], "value", [alpha / 2, 1 - alpha / 2], ["ci_low", "ci_high"])


def paired_differences(
    df: DataFrame, cluster: str, scope: str, y: str, base: str, others: list[str], replicates: int = 1000, seed: int = 43,
    alpha: float = 0.05, overall: str = "Overall", block: int = BLOCK,
) -> DataFrame:
    """Difference of each model to the base on the same draws: estimate interval and share of replicates in which it is better.

    Draws are made once over all clusters; scopes are parts of the same draw.
    """
    models = [base, *others]
    sums = cluster_sums(df, cluster, scope, y, models)
    columns = ["n", "sy", "syy", *[f"{m}_{s}" for m in models for s in ("se2", "abs")]]
    drawn = scale.cut_lineage(replicate_sums(sums, cluster, columns, replicates, seed, "_scope", overall, block))
    both = drawn.withColumn("scope", F.explode(F.array(F.col("scope"), F.lit(overall))))
    summed = both.groupBy("replicate", "scope").agg(*[F.sum(c).alias(c) for c in columns]).where("n > 0")
    reference = metric_columns(base)
    cells = []
    for m in others:
        own = metric_columns(m)
        cells += [F.struct(F.lit(m).alias("model"), F.lit(k).alias("metric"), (own[k] - reference[k]).alias("delta")) for k in own]
    long = summed.select("scope", F.explode(F.array(*cells)).alias("c")).select("scope", "c.model", "c.metric", "c.delta")
    better = F.when(F.col("metric") == "r2", F.col("delta") > 0).otherwise(F.col("delta") < 0)
    facts = long.groupBy("scope", "model", "metric").agg(
        F.avg("delta").alias("mean_delta"), (F.avg(better.cast("double")) * 100).alias("pct_better")
    )
    marks = order.exact_quantiles(long, ["scope", "model", "metric"], "delta", [alpha / 2, 1 - alpha / 2], ["ci_low", "ci_high"])
    return facts.join(marks, ["scope", "model", "metric"])
