"""A fitted linear model as a small table: written once, read and applied to raw rows without refitting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.operators import design
from chartspark.operators.design import FeatureSpec, Scaler
from chartspark.operators.linear import LinearFit, prediction, with_const

SCHEMA = "part string, place int, name string, value double"
LISTS = ("audio", "lyrics", "interactions", "markets", "logged")
NAMES = ("key", "market", "target", "year", "mode", "base")


@dataclass(frozen=True)
class SavedModel:
    spec: FeatureSpec
    scaler: Scaler
    columns: list[str]
    beta: np.ndarray
    medians: dict[str, float]


def save_model(spark: SparkSession, path: str, spec: FeatureSpec, scaler: Scaler, fit: LinearFit, medians: dict[str, float]) -> None:
    """Writes schema, scaler, coefficients and training medians as one Parquet table; an existing table is an error.

    medians may hold `mode`, the median of the mode flag, beside the continuous columns.
    """
    rows = [("names", 0, f"{n}={getattr(spec, n)}", None) for n in NAMES]
    rows += [(part, i, name, None) for part in LISTS for i, name in enumerate(getattr(spec, part))]
    rows += [("fill", 0, c, float(v)) for c, v in spec.fill.items()]
    rows += [("mean", 0, c, float(v)) for c, v in scaler.mean.items()] + [("deviation", 0, c, float(v)) for c, v in scaler.deviation.items()]
    rows += [("year_floor", 0, spec.year, float(scaler.year_floor))]
    rows += [("coefficient", i, c, float(b)) for i, (c, b) in enumerate(zip(fit.columns, fit.beta))]
    rows += [("median", 0, c, float(v)) for c, v in medians.items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)


def load_model(spark: SparkSession, path: str) -> SavedModel:
    """The model of a saved table; a few rows a feature reach the driver. Missing parts are an error."""
    parts: dict[str, list] = {}
    for r in spark.read.schema(SCHEMA).parquet(path).orderBy("part", "place", "name").collect():
        parts.setdefault(r["part"], []).append((r["name"], r["value"]))
    lost = [p for p in ("names", "mean", "deviation", "year_floor", "coefficient") if p not in parts]
    if lost:
        raise ValueError(f"{path} holds no model: no {', '.join(lost)}")
    names = dict(n.split("=", 1) for n, _ in parts["names"])
    lists = {part: tuple(n for n, _ in parts.get(part, [])) for part in LISTS}
    spec = FeatureSpec(**names, **lists, fill=dict(parts.get("fill", [])))
    scaler = Scaler(dict(parts["mean"]), dict(parts["deviation"]), parts["year_floor"][0][1])
    return SavedModel(spec, scaler, [n for n, _ in parts["coefficient"]], np.array([b for _, b in parts["coefficient"]]), dict(parts.get("median", [])))


def predict_raw(df: DataFrame, model: SavedModel, out: str = "predicted", fill: bool = False) -> DataFrame:
    """The rows with a prediction from their raw columns and whether their market is one of the model's.

    Columns with a sanctioned fill are filled. Other NULL or NaN inputs that a coefficient needs make the prediction NULL; with fill, the
    training medians stand in for them. A market that the model does not know, or NULL, is predicted as the base market.
    Other columns of the rows are kept, whatever their names.
    """
    spec, raw = model.spec, [*model.spec.continuous, model.spec.mode, model.spec.market]
    inputs = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in spec.continuous}
    inputs = {c: F.coalesce(v, F.lit(float(spec.fill[c]))) if c in spec.fill else v for c, v in inputs.items()}
    text = F.lower(F.trim(F.col(f"`{spec.mode}`").cast("string")))
    flag = F.when(text.isin("major", "1", "1.0"), 1.0).when(text.isin("minor", "0", "0.0"), 0.0)
    if fill:
        inputs = {c: F.coalesce(v, F.lit(model.medians.get(c)).cast("double")) for c, v in inputs.items()}
        flag = F.coalesce(flag, F.lit(model.medians.get("mode")).cast("double"))
    mode = F.when(flag == 1, "major").otherwise("minor")
    lost = flag.isNull() if "mode" in model.columns else F.lit(False)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`") for c in dict.fromkeys(raw)])
    market = F.coalesce(F.col(spec.market).cast("string"), F.lit(spec.base))
    ready = packed.withColumns({**inputs, "_lost": lost, spec.mode: mode, "_known": F.coalesce(F.col(spec.market).isin(*spec.markets), F.lit(False)), spec.market: market})
    x = design.design_matrix(ready, spec, model.scaler, ["_row", "_known", "_lost"])
    scored = with_const(x).select("_row", "_known", F.when(~F.col("_lost"), prediction(model.columns, model.beta)).alias("_out"))
    return scored.select("_row.*", F.col("_known").alias("known_market"), F.col("_out").alias(out))
