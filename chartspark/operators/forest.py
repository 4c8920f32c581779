"""Forest benchmark: imputation, group folds, grid, importance, joint inference with the linear model."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions.clean import clip
from chartspark.functions.score import SCORE_DOMAIN, heuristic_scores
from chartspark.operators import design, order
from chartspark.operators.linear import LinearFit, prediction

SIDE_BY_SIDE = 4


def forest_features(df: DataFrame, spec: design.FeatureSpec, medians: dict[str, float], keep: list[str]) -> tuple[DataFrame, list[str]]:
    """Raw features with medians for NULLs, logged word count, mode and market flags."""
    numbers = [c for c in spec.continuous if c not in spec.logged]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in spec.continuous}
    out = df.withColumns(filled).withColumns({f"log_{c}": F.log1p(c) for c in spec.logged})
    mode = F.lower(F.trim(F.coalesce(F.col(spec.mode).cast("string"), F.lit("major")))).isin("major", "1", "1.0").cast("double")
    flags = {name: (F.col(spec.market) == m).cast("double") for name, m in zip(spec.dummies, [m for m in spec.markets if m != spec.base])}
    out = out.withColumns({"mode": mode, **flags})
    names = [*numbers, *[f"log_{c}" for c in spec.logged], "mode", *spec.dummies]
    return out.select(*keep, *names), names


def group_folds(df: DataFrame, key: str, folds: int, seed: int, out: str = "fold") -> DataFrame:
    """Fold by group hash, so a group never spans folds; no shuffle."""
    return df.withColumn(out, F.pmod(design.seeded_hash(key, seed), F.lit(folds)).cast("int"))


@dataclass(frozen=True)
class Grid:
    """Settings of the search, all combined."""

    depths: tuple[int, ...] = (6, 8, 10)
    leaves: tuple[int, ...] = (2, 5)
    trees: int = 150
    folds: int = 5
    bins: int = 32


@dataclass
class Search:
    """Mean absolute error of every (max_depth, min_leaf, fold), the best setting and its forest on all rows."""

    scores: list[tuple[int, int, int, float]]
    max_depth: int
    min_leaf: int
    model: RandomForestRegressionModel


class NodeTable:
    """The nodes of a forest as arrays, for predictions at several depth limits in one descent.

    A tree grown level by level on all features is, cut at a depth, the tree grown with that limit, since every inner node keeps its
    own prediction. Its size is bounded by trees and depth, whatever the number of rows.
    """

    def __init__(self, model: RandomForestRegressionModel) -> None:
        spark = SparkSession.active()
        folder = f"{scale.shared_folder(spark)}/forest-{uuid.uuid4().hex}"
        model.write().save(folder)
        split = F.col("nodeData.split")
        found = spark.read.parquet(f"{folder}/data").select(
            F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), "nodeData.prediction", F.col("nodeData.leftChild").alias("left"),
            F.col("nodeData.rightChild").alias("right"), split["featureIndex"].alias("feature"), F.coalesce(F.get(split["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        ).toArrow().sort_by([("tree", "ascending"), ("id", "ascending")])
        column = {n: found.column(n).to_numpy() for n in found.column_names}
        self.roots = np.flatnonzero(column["id"] == 0)
        base = self.roots[column["tree"]]
        leaf, own = column["left"] < 0, np.arange(len(base))
        self.left, self.right = (np.where(leaf, own, base + column[side]) for side in ("left", "right"))
        self.feature, self.threshold, self.prediction = np.maximum(column["feature"], 0), column["threshold"], column["prediction"]

    def predict(self, x: np.ndarray, depths: tuple[int, ...]) -> np.ndarray:
        """A row of x gives a prediction for each depth limit."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows, out = np.arange(len(x))[:, None], {}
        for depth in range(max(depths) + 1):
            if depth in depths:
                out[depth] = self.prediction[at].mean(axis=1)
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return np.stack([out[d] for d in depths], axis=1)


def depth_errors(model: RandomForestRegressionModel, rows: DataFrame, names: list[str], target: str, depths: tuple[int, ...]) -> list[float]:
    """Mean absolute error of the forest cut at each depth."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(vars(NodeTable(model)))  # plain arrays: a broadcast, unlike a function, names its classes

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = object.__new__(NodeTable)
        vars(nodes).update(sent.value)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1)
                off = np.abs(nodes.predict(x, depths) - batch.column(len(names)).to_numpy(zero_copy_only=False)[:, None]).sum(axis=0)
                yield pa.record_batch([pa.array(np.arange(len(depths))), pa.array(off), pa.array([batch.num_rows] * len(depths))], names=["place", "off", "n"])

    columns = rows.select(*[F.col(n).cast("double") for n in (*names, target)])
    sums = columns.mapInArrow(errors, "place long, off double, n long").groupBy("place").agg((F.sum("off") / F.sum("n")).alias("mae"))
    return [r["mae"] for r in sums.orderBy("place").collect()]


def search_forest(train: DataFrame, names: list[str], target: str, key: str, grid: Grid = Grid(), seed: int = 42) -> Search:
    """Group cross-validated search over depth and leaf size, then the best setting on all rows.

    Rows are written once; a fold is a filter on them, so a group is never on both sides. Each fold and leaf size grows one forest
    to the largest depth, and all depths are scored from its nodes. Equal errors: the smaller depth, then the smaller leaf. A
    fold without rows on one side is left out.
    """
    # few rows come together in few partitions, as each partition adds up the statistics of all open nodes
    folded = group_folds(train.select(key, target, *names), key, grid.folds, seed).repartition(key).sortWithinPartitions(key, target, *names)
    rows = scale.cut_lineage(VectorAssembler(inputCols=names, outputCol="features").transform(folded))

    def grown(part: DataFrame, depth: int, leaf: int) -> RandomForestRegressionModel:
        return RandomForestRegressor(
            labelCol=target, featuresCol="features", seed=seed, maxBins=grid.bins, maxDepth=depth, numTrees=grid.trees, minInstancesPerNode=leaf, featureSubsetStrategy="all",
            cacheNodeIds=True,  # rows know their nodes; otherwise every step sends all trees from the driver to every task
        ).fit(part)

    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    folds = [f for f in sorted(sizes) if len(sizes) > 1]

    def judged(cell: tuple[int, int]) -> list[tuple[int, int, int, float]]:
        leaf, fold = cell
        model = grown(rows.where(F.col("fold") != fold), max(grid.depths), leaf)
        found = depth_errors(model, rows.where(F.col("fold") == fold), names, target, grid.depths)
        return [(depth, leaf, fold, mae) for depth, mae in zip(grid.depths, found)]

    with ThreadPool(SIDE_BY_SIDE) as pool:  # jobs of small steps; each holds one growing forest on the driver
        scores = sorted(x for part in pool.map(judged, [(leaf, fold) for leaf in grid.leaves for fold in folds]) for x in part)
    mean = {(d, m): np.mean([e for a, b, _, e in scores if (a, b) == (d, m)]) if folds else 0.0 for d in grid.depths for m in grid.leaves}
    depth, leaf = min(mean, key=lambda s: (mean[s], s))
    return Search(scores, depth, leaf, grown(rows, depth, leaf))


def predict_forest(model: RandomForestRegressionModel, df: DataFrame, names: list[str], out: str) -> DataFrame:
    vectors = df.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in names])))
    return model.transform(vectors).withColumnRenamed("prediction", out).drop("features")


def random_partners(df: DataFrame, keys: list[str], columns: list[str], repeats: int, seed: int) -> DataFrame:
    """Each row once per repeat beside the columns of another row, every row being used once as partner.

    Positions in two hash orders are matched; they come from counted positions, so no order spans all rows in one task.
    """
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    every = df.withColumn("_key", key).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    mine, theirs = F.concat_ws(":", "repeat", F.lit(f"{seed}a")), F.concat_ws(":", "repeat", F.lit(f"{seed}b"))
    # written once, as both orders and all their counts read them; the joins are merges, because the size of exploded
    # rows is guessed from the rows before, and a table of all rows and repeats would be collected for a broadcast
    hashed = scale.cut_lineage(every.withColumn("_h1", design.seeded_hash("_key", mine)).withColumn("_h2", design.seeded_hash("_key", theirs)))

    def place(h: str) -> DataFrame:
        start = order.counted_positions(hashed.select("repeat", h), ["repeat"], h).select("repeat", h, "start")
        # rows of equal key share a start; their order is that of their content
        tie = F.row_number().over(W.partitionBy("repeat", h).orderBy(F.xxhash64(*columns))) - 1
        return hashed.join(start.hint("merge"), ["repeat", h]).withColumn("_at", F.col("start") + tie).drop("start")

    partner = place("_h2").select("repeat", "_at", *[F.col(c).alias(f"_p_{c}") for c in columns])
    return place("_h1").join(partner.hint("merge"), ["repeat", "_at"]).drop("_key", "_h1", "_h2", "_at")


def permutation_importance(
    model: RandomForestRegressionModel, df: DataFrame, names: list[str], target: str, keys: list[str], repeats: int = 10, seed: int = 42,
) -> DataFrame:
    """Rise of the MAE when a column is shuffled: mean, deviation, and whether mean - 2 deviations stays above zero.

    All columns and repeats are scored in one job: each row carries one vector per column with only that value exchanged.
    """
    paired = random_partners(df, keys, names, repeats, seed)
    plain = [F.col(c).cast("double") for c in names]
    variants = [F.struct(F.lit("").alias("feature"), F.array(*plain).alias("x"))] + [
        F.struct(F.lit(c).alias("feature"), F.array(*[F.col(f"_p_{n}").cast("double") if n == c else F.col(n).cast("double") for n in names]).alias("x"))
        for c in names
    ]
    rows = paired.select("repeat", F.col(target).alias("_y"), F.explode(F.array(*variants)).alias("v"))
    vectors = rows.select("repeat", "_y", "v.feature", array_to_vector("v.x").alias("features"))
    scored = model.transform(vectors).groupBy("repeat", "feature").agg(F.avg(F.abs(F.col("_y") - F.col("prediction"))).alias("mae"))
    # a window over the few scores of a repeat, so that all rows are paired and scored once
    base = F.max(F.when(F.col("feature") == "", F.col("mae"))).over(W.partitionBy("repeat"))
    rises = scored.withColumn("rise", F.col("mae") - base).where("feature <> ''")
    out = rises.groupBy("feature").agg(F.avg("rise").alias("importance_mean"), F.stddev_pop("rise").alias("importance_std"))
    return out.withColumn("stable", F.col("importance_mean") - 2 * F.col("importance_std") > 0)


def dual_scores(
    df: DataFrame, spec: design.FeatureSpec, scaler: design.Scaler, medians: dict[str, float], linear: LinearFit | None,
    forest: RandomForestRegressionModel | None, keep: list[str], allow_fallback: bool = True,
) -> DataFrame:
    """Both models on raw rows with defaults for NULLs: clipped scores, their mean, and an error label without fallback."""
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in spec.continuous}
    rows = df.withColumns({**fills, spec.mode: F.coalesce(F.col(spec.mode).cast("string"), F.lit("major"))})
    base, saturated = heuristic_scores(F.col(spec.market), F.col("energy"), F.col("spectral_centroid"), F.col("repetition_ratio"))
    rows = rows.withColumns({"_h1": base, "_h2": saturated})
    # one row stays one row: both models' columns are made side by side, the forest's in a struct
    paired, names = forest_features(rows.select(F.struct("*").alias("_row"), "*"), spec, medians, ["_row"])
    paired = paired.select("_row.*", F.struct(*names).alias("_forest"))
    if linear is not None:
        paired = design.design_matrix(paired, spec, scaler, [*keep, "_h1", "_h2", "_forest"]).withColumn("_ols", prediction(linear.columns, linear.beta))
    else:
        paired = paired.withColumn("_ols", F.lit(None).cast("double"))
    features = paired.select(*keep, "_h1", "_h2", "_ols", *[F.col(f"_forest.{n}").alias(n) for n in names if n not in keep])
    rated = predict_forest(forest, features, names, "_rf") if forest is not None else features.withColumn("_rf", F.lit(None).cast("double"))

    def usable(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))

    ols, rf = usable("_ols"), usable("_rf")
    if allow_fallback:
        ols, rf, error = F.coalesce(ols, F.col("_h1")), F.coalesce(rf, F.col("_h2")), F.lit(None).cast("string")
    else:
        error = F.when(ols.isNull() | rf.isNull(), "no valid score")
    a, b = clip(ols, *SCORE_DOMAIN), clip(rf, *SCORE_DOMAIN)
    return rated.select(
        *keep, F.bround(a, 2).alias("ols_prediction"), F.bround(b, 2).alias("rf_prediction"),
        F.bround(0.5 * a + 0.5 * b, 2).alias("ensemble_prediction"), error.alias("error"),
    )
