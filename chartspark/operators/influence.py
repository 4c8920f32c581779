"""Least-squares fits within cohorts, the influence of each row on its cohort's fit, and the audit of a transform.

A task adds up the k x k products of the cohorts in a batch, Spark adds these sums, and each cohort's small system is solved
where its sums lie. Nothing of it passes through the driver, so the number of cohorts has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.operators import linear, order

FORMS = ("raw", "log1p")
FIT = "_n long, _center array<double>, _beta array<double>, _inverse array<array<double>>, _s2 double, _vif array<double>, _sd array<double>"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _vector(columns: list[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def cohort_means(rows: DataFrame, y: str, x: list[str], keys: list[str]) -> DataFrame:
    """Number of rows and the mean of each column per cohort, y last."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(F.col(f"`{c}`").cast("double")) for c in [*x, y]]).alias("_center"))


def cohort_products(shifted: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """Sum of the outer products of an array column per cohort, as size * size numbers row by row."""
    schema = f"{shifted.select(*keys).schema.toDDL()}, _flat array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, part in batch.groupby(keys, dropna=False, sort=False):
                m = np.array(part[vector].tolist(), dtype=float)
                out.append((*[None if pd.isna(k) else k for k in key], (m.T @ m).ravel()))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "_flat"])

    parts = shifted.select(*keys, vector).mapInPandas(partial, schema)
    cells = parts.select(*keys, F.posexplode("_flat").alias("_cell", "_v")).groupBy(*keys, "_cell").agg(F.sum("_v").alias("_v"))
    # size * size cells a cohort
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_cell", "_v"))), lambda s: s["_v"]).alias("_g"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Keys agree, NULL with NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_key_{k}"])
    return out


def _with_cohort(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    named = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    return rows.join(named, _same(rows, named, keys)).drop(*[f"_key_{k}" for k in keys])


def cohort_fits(rows: DataFrame, means: DataFrame, y: str, x: list[str], keys: list[str]) -> DataFrame:
    """One fit of y on a constant and x per cohort: rows, centre, slopes, inverse of the centred products, s2, inflation
    factors and population deviations of x and y.

    Columns are shifted by their cohort's means, which keeps digits and takes the constant out of the system. A singular
    system is solved by its pseudo-inverse; s2 is NULL without residual freedom, an inflation factor of a constant column NaN.
    """
    k = len(x)
    shifted = _with_cohort(rows, means, keys).select(*keys, F.zip_with(_vector([*x, y]), "_center", lambda v, m: v - m).alias("_d"))
    sums = _with_cohort(cohort_products(shifted, keys, "_d", k + 1), means, keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "_n", "_center"]].copy()
            beta, inverse, s2, vif, sd = [], [], [], [], []
            for n, flat in zip(batch["_n"], batch["_g"]):
                g = np.asarray(flat, dtype=float).reshape(k + 1, k + 1)
                inv = np.linalg.pinv(g[:k, :k], hermitian=True)
                b = inv @ g[:k, k]
                rest = g[k, k] - 2 * b @ g[:k, k] + b @ g[:k, :k] @ b
                beta.append(b)
                inverse.append(list(inv))
                s2.append(rest / (n - k - 1) if n > k + 1 else None)
                vif.append(np.where(np.diag(g)[:k] > 0, np.diag(inv) * np.diag(g)[:k], np.nan))
                sd.append(np.sqrt(np.diag(g) / n))
            yield out.assign(_beta=beta, _inverse=inverse, _s2=pd.Series(s2, index=out.index, dtype=float), _vif=vif, _sd=sd)

    return sums.mapInPandas(solve, f"{rows.select(*keys).schema.toDDL()}, {FIT}")


def with_cohort_influence(df: DataFrame, y: str, x: list[str], keys: list[str], means: DataFrame | None = None) -> DataFrame:
    """Adds residual, leverage, Cook's distance and the fit of the row's cohort; rows with a missing value are left out.

    Leverage is one quadratic form on arrays, 1/n + d' S d with the centred row d and the inverse S. Cook's distance is NULL
    without residual freedom and where the leverage is 1.
    """
    rows = linear.complete_rows(df, [y, *x])
    means = cohort_means(rows, y, x, keys) if means is None else means
    joined = _with_cohort(rows, cohort_fits(rows, means, y, x, keys), keys)
    k = len(x)
    joined = joined.withColumn("_d", F.zip_with(_vector([*x, y]), "_center", lambda v, m: v - m)).withColumn("_dx", F.slice("_d", 1, k))
    h = 1 / F.col("_n") + _dot(F.col("_dx"), F.transform("_inverse", lambda row: _dot(row, F.col("_dx"))))
    joined = joined.withColumn("leverage", h).withColumn("residual", F.element_at("_d", k + 1) - _dot(F.col("_dx"), F.col("_beta")))
    u, h = F.col("residual"), F.col("leverage")
    cook = F.when((F.col("_s2") > 0) & (h < 1), u * u / ((k + 1) * F.col("_s2")) * h / ((1 - h) * (1 - h)))
    return joined.withColumn("cooks_distance", cook).drop("_d", "_dx")


def with_omnibus_k2(df: DataFrame, n: str, skew: str, kurtosis: str, out: str = "k2") -> DataFrame:
    """Adds D'Agostino's omnibus statistic from population skewness and kurtosis (not excess); defined from eight rows on.

    Each intermediate value is its own column, because the later ones use it several times.
    """
    c, b2, w2, a, inner = F.col(n).cast("double"), F.col("_b2"), F.col("_w2"), F.col("_a"), F.col("_inner")
    root = 6 * (c * c - 5 * c + 2) / ((c + 7) * (c + 9)) * F.sqrt(6 * (c + 3) * (c + 5) / (c * (c - 2) * (c - 3)))
    rows = df.withColumns({
        "_b2": 3 * (c * c + 27 * c - 70) * (c + 1) * (c + 3) / ((c - 2) * (c + 5) * (c + 7) * (c + 9)), "_root": root,
        "_y": F.col(skew) * F.sqrt((c + 1) * (c + 3) / (6 * (c - 2))),
        "_x": (F.col(kurtosis) - 3 * (c - 1) / (c + 1)) / F.sqrt(24 * c * (c - 2) * (c - 3) / ((c + 1) * (c + 1) * (c + 3) * (c + 5))),
    })
    rows = rows.withColumns({"_w2": F.sqrt(2 * (b2 - 1)) - 1, "_a": 6 + 8 / F.col("_root") * (2 / F.col("_root") + F.sqrt(1 + 4 / (F.col("_root") * F.col("_root"))))})
    rows = rows.withColumns({
        "_z1": F.asinh(F.col("_y") / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.ln(w2)), "_inner": (1 - 2 / a) / (1 + F.col("_x") * F.sqrt(2 / (a - 4))),
    })
    rows = rows.withColumn("_z2", (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1.0) / 3)) / F.sqrt(2 / (9 * a)))
    k2 = F.when(c >= 8, F.col("_z1") * F.col("_z1") + F.col("_z2") * F.col("_z2"))
    return rows.withColumn(out, k2).drop("_b2", "_root", "_y", "_x", "_w2", "_a", "_z1", "_inner", "_z2")


def transform_audit(df: DataFrame, value: str, y: str, others: list[str], keys: list[str], high_from: float) -> DataFrame:
    """Raw against log1p of a column, per cohort: moments, omnibus test, extreme z scores, and its influence on a linear model.

    The model is y on the column's form and the others, fitted per cohort and form. Leverage is counted against 2p/n and 3p/n,
    Cook's distance against 4/n; both are also reported for the rows whose raw value is at least high_from (NULL without any).
    Skewness and excess kurtosis have the small-sample correction, the omnibus test takes the uncorrected ones.
    """
    raw = F.col(f"`{value}`").cast("double")
    base = linear.complete_rows(df, [value, y, *others]).select(
        *keys, raw.alias("_raw"), F.col(f"`{y}`").cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(f"_o{i}") for i, c in enumerate(others)]
    )
    forms = F.explode(F.array(F.struct(F.lit("raw").alias("form"), F.col("_raw").alias("_x")), F.struct(F.lit("log1p").alias("form"), F.log1p("_raw").alias("_x"))))
    # passed over for the means, the products, the influence and the quantiles
    rows = scale.cut_lineage(base.select("*", forms.alias("_f")).select(*base.columns, "_f.form", "_f._x"))
    by, x = [*keys, "form"], ["_x", *[f"_o{i}" for i in range(len(others))]]
    spread = order.exact_quantiles(rows.select(*by, "_x"), by, "_x", [0.25, 0.5, 0.75], ["_q1", "median", "_q3"])
    rows = with_cohort_influence(rows, "_y", x, by)
    n, p = F.col("_n"), len(x) + 1
    d = F.col("_x") - F.element_at("_center", 1)
    rows = rows.withColumn("_dv", d).withColumn("_dev", F.element_at("_sd", 1)).withColumn("_high", F.col("_raw") >= high_from)
    h, cook, high = F.col("leverage"), F.col("cooks_distance"), F.col("_high")
    first = rows.groupBy(*by).agg(
        F.first("_n").alias("n"), F.avg("_x").alias("mean"), F.first("_dev").alias("_sd"), F.avg(F.col("_dv") ** 3).alias("_m3"),
        F.avg(F.col("_dv") ** 4).alias("_m4"), F.max(F.abs("_dv")).alias("_far"), F.count_if(F.abs("_dv") > 3 * F.col("_dev")).alias("n_abs_z_over_3"),
        F.min("_x").alias("low"), F.max("_x").alias("high"),
        F.max(h).alias("max_leverage"), F.count_if(h > 2 * p / n).alias("n_over_2p"), F.count_if(h > 3 * p / n).alias("n_over_3p"),
        F.max(cook).alias("max_cooks"), F.count_if(cook > 4 / n).alias("n_cooks_over"), F.count_if(high).alias("n_high"),
        F.max(F.when(high, h)).alias("high_max_leverage"), F.avg(F.when(high, h)).alias("high_mean_leverage"),
        F.max(F.when(high, cook)).alias("high_max_cooks"), F.first(F.element_at("_vif", 1)).alias("vif"),
    )
    whole = _with_cohort(first, spread, by)
    n, s = F.col("n").cast("double"), F.col("_sd")
    g1, g2 = F.col("_g1"), F.col("_g2")
    out = with_omnibus_k2(whole.withColumns({"_g1": F.col("_m3") / s**3, "_g2": F.col("_m4") / s**4}), "n", "_g1", "_g2")
    return out.select(
        *by, "n", F.lit(p).alias("p"), "mean", (s * F.sqrt(n / (n - 1))).alias("sd"), "median", (F.col("_q3") - F.col("_q1")).alias("iqr"), "low", "high",
        (g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (g2 - 3) + 6)).alias("kurtosis"),
        "k2", F.exp(-F.col("k2") / 2).alias("p_value"), (F.col("_far") / s).alias("max_abs_z"), "n_abs_z_over_3",
        ((1 + (F.col("_far") / s) ** 2) / n).alias("max_own_leverage"), (2 * p / n).alias("limit_2p"), (3 * p / n).alias("limit_3p"), (4 / n).alias("limit_cooks"),
        "max_leverage", "n_over_2p", "n_over_3p", "max_cooks", "n_cooks_over", "n_high", "high_max_leverage", "high_mean_leverage", "high_max_cooks", "vif",
    )
