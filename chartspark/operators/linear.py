"""Linear and logistic models from distributed cross products.

Rows never reach the driver: tasks add up k x k products, Spark adds the task sums, and the driver solves the small system.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions import dist, score

CONST = "const"


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL or NaN in the columns.

    One condition per column: dropna() makes a single condition over all of them, and following it through renamed columns
    costs the optimizer exponential time.
    """
    keep = F.lit(True)
    for c in columns:
        x = F.col(f"`{c}`")
        keep = keep & x.isNotNull() & ~F.isnan(x.cast("double"))
    return df.where(keep)


def cross_products(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sum over rows of the outer product of the columns; rows with a NULL or NaN are left out."""
    k = len(columns)
    rows = complete_rows(df, columns).select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            m = batch.to_numpy(dtype=float)
            total += m.T @ m
        yield pd.DataFrame({"g": [total.ravel()]})

    parts = rows.mapInPandas(partial, "g array<double>")
    cells = parts.select(F.posexplode("g").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(k * k)
    for cell, v in cells.collect():  # k * k numbers
        out[cell] = v
    return out.reshape(k, k)


def prediction(columns: list[str], beta: np.ndarray) -> Column:
    """Dot product with coefficient literals; const stands for one."""
    out = F.lit(0.0)
    for c, b in zip(columns, beta):
        out = out + (F.lit(float(b)) if c == CONST else F.col(f"`{c}`") * float(b))
    return out


@dataclass
class LinearFit:
    columns: list[str]
    beta: np.ndarray
    cov: np.ndarray
    cov_plain: np.ndarray
    xtx_inv: np.ndarray
    n: int
    ssr: float
    sst: float
    n_clusters: int | None = None
    extra: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.columns)

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.sst

    @property
    def adj_r2(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / (self.n - self.k)

    def _loglik(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi * self.ssr / self.n) + 1)

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self._loglik()

    @property
    def bic(self) -> float:
        return self.k * math.log(self.n) - 2 * self._loglik()

    def index(self, names: list[str]) -> list[int]:
        missing = [c for c in names if c not in self.columns]
        if missing:
            raise ValueError(f"no such coefficients: {missing}")
        return [self.columns.index(c) for c in names]

    def wald(self, names: list[str]) -> dict:
        """Joint chi-square test that the named coefficients are zero; a singular block reports its rank."""
        at = self.index(names)
        b, v = self.beta[at], self.cov[np.ix_(at, at)]
        rank = int(np.linalg.matrix_rank(v))
        stat = float(b @ np.linalg.pinv(v) @ b)
        return {"statistic": stat, "df": len(at), "rank": rank, "p_value": dist.chi2_tail(stat, len(at))}

    def combination(self, weights: dict[str, float]) -> dict:
        """Linear combination of coefficients with its standard error and z test."""
        w = np.zeros(self.k)
        for name, weight in weights.items():
            w[self.index([name])[0]] = weight
        value, se = float(w @ self.beta), float(math.sqrt(w @ self.cov @ w))
        return {"estimate": value, "se": se, "z": value / se, "p_value": dist.normal_two_sided(value / se)}


def _solve(gram: np.ndarray, columns: list[str], n_x: int) -> tuple[np.ndarray, np.ndarray, float]:
    xtx, xty = gram[:n_x, :n_x], gram[:n_x, n_x]
    inv = np.linalg.pinv(xtx, hermitian=True)
    beta = inv @ xty
    return beta, inv, float(gram[n_x, n_x] - 2 * beta @ xty + beta @ xtx @ beta)


def with_const(df: DataFrame) -> DataFrame:
    return df if CONST in df.columns else df.withColumn(CONST, F.lit(1.0))


def cluster_scores(df: DataFrame, x: list[str], residual: Column, cluster: str) -> DataFrame:
    """Sum of x times residual per cluster; partial sums run before the shuffle, so a hot cluster is one row."""
    rows = df.withColumn("_u", residual)
    return rows.groupBy(cluster).agg(*[F.sum(F.col(f"`{c}`") * F.col("_u")).alias(f"s{i}") for i, c in enumerate(x)])


def cluster_meat(df: DataFrame, x: list[str], residual: Column, cluster: str) -> tuple[np.ndarray, int]:
    """Sum of outer products of cluster scores, and the number of clusters."""
    scores = cluster_scores(df, x, residual, cluster).withColumn("one", F.lit(1.0))
    gram = cross_products(scores, [*[f"s{i}" for i in range(len(x))], "one"])
    return gram[:-1, :-1], int(round(gram[-1, -1]))


def fit_ladder(df: DataFrame, y: str, models: dict[str, list[str]], cluster: str | None = None, correct: bool = True) -> dict[str, LinearFit]:
    """Several nested models from one pass of cross products over the union of their columns.

    With a cluster column each model gets a cluster-robust covariance; correct applies the small-sample factor.
    """
    data = with_const(df)
    every = [CONST, *dict.fromkeys(c for cols in models.values() for c in cols if c != CONST)]
    data = complete_rows(data, [y, *every])
    gram = cross_products(data, [*every, y])
    n, sum_y = int(round(gram[0, 0])), gram[0, -1]
    sst = float(gram[-1, -1] - sum_y**2 / n)
    fits = {}
    for name, cols in models.items():
        x = [CONST, *[c for c in cols if c != CONST]]
        at = [every.index(c) for c in x] + [len(every)]
        beta, inv, ssr = _solve(gram[np.ix_(at, at)], x, len(x))
        plain = inv * ssr / (n - len(x))
        cov, clusters = plain, None
        if cluster is not None:
            meat, clusters = cluster_meat(data, x, F.col(f"`{y}`") - prediction(x, beta), cluster)
            factor = clusters / (clusters - 1) * (n - 1) / (n - len(x)) if correct else 1.0
            cov = inv @ meat @ inv * factor
        fits[name] = LinearFit(x, beta, cov, plain, inv, n, ssr, sst, clusters)
    return fits


def fit_ols(df: DataFrame, y: str, x: list[str], cluster: str | None = None, correct: bool = True) -> LinearFit:
    return fit_ladder(df, y, {"model": x}, cluster, correct)["model"]


def fit_logistic(df: DataFrame, y: str, x: list[str], cluster: str, steps: int = 50, tol: float = 1e-10) -> LinearFit:
    """Logistic model with independence working correlation and cluster sandwich.

    The rows are written once; each step adds up the weighted cross products and X'(y - p). Without convergence within the
    steps, as under separation, there is no estimate and a ValueError says so.
    """
    data = scale.cut_lineage(complete_rows(with_const(df).where(F.col(cluster).isNotNull()), [y, *x]))
    names = [CONST, *[c for c in x if c != CONST]]
    beta, inv = np.zeros(len(names)), None
    for done in range(1, steps + 1):
        p = 1 / (1 + F.exp(-prediction(names, beta)))
        weighted = data.withColumn("_p", p).withColumn("_w", F.sqrt(F.col("_p") * (1 - F.col("_p"))))
        gram = cross_products(weighted.select(*[(F.col(f"`{c}`") * F.col("_w")).alias(f"x{i}") for i, c in enumerate(names)]), [f"x{i}" for i in range(len(names))])
        score = weighted.agg(*[F.coalesce(F.sum(F.col(f"`{c}`") * (F.col(f"`{y}`") - F.col("_p"))), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(names)]).first()
        inv = np.linalg.pinv(gram, hermitian=True)
        move = inv @ np.array(score, dtype=float)
        beta = beta + move
        if np.max(np.abs(move)) < tol:
            break
    else:
        raise ValueError(f"the logistic fit did not converge in {steps} steps; the classes may be separated")
    residual = F.col(f"`{y}`") - 1 / (1 + F.exp(-prediction(names, beta)))
    meat, clusters = cluster_meat(data, names, residual, cluster)
    n = int(round(data.count()))
    return LinearFit(names, beta, inv @ meat @ inv, inv, inv, n, float("nan"), float("nan"), clusters, {"iterations": done})


# ---- multiple testing ------------------------------------------------------------------------------

def holm(p: list[float]) -> list[float]:
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, high = [0.0] * len(p), 0.0
    for place, i in enumerate(order):
        high = max(high, (len(p) - place) * p[i])
        out[i] = min(1.0, high)
    return out


def benjamini_hochberg(p: list[float]) -> list[float]:
    order = sorted(range(len(p)), key=lambda i: -p[i])
    out, low = [0.0] * len(p), 1.0
    for place, i in enumerate(order):
        low = min(low, p[i] * len(p) / (len(p) - place))
        out[i] = low
    return out


def coefficient_table(spark: SparkSession, fit: LinearFit, vif: dict[str, float] | None = None, tested: list[str] | None = None) -> DataFrame:
    """Estimates with both standard errors, z test, interval, adjusted p-values and evidence tier."""
    tested = [c for c in (tested or fit.columns) if c != CONST]
    se, plain = np.sqrt(np.diag(fit.cov)), np.sqrt(np.diag(fit.cov_plain))
    z = fit.beta / se
    p = {c: dist.normal_two_sided(z[i]) for i, c in enumerate(fit.columns)}
    adj = dict(zip(tested, zip(holm([p[c] for c in tested]), benjamini_hochberg([p[c] for c in tested]))))
    q = dist.normal_quantile(0.975)
    rows = [
        (c, float(fit.beta[i]), float(se[i]), float(plain[i]), float(se[i] / plain[i]), float(z[i]), p[c],
         float(fit.beta[i] - q * se[i]), float(fit.beta[i] + q * se[i]), *(adj.get(c, (None, None))), (vif or {}).get(c))
        for i, c in enumerate(fit.columns)
    ]
    schema = (
        "term string, estimate double, se double, se_plain double, se_ratio double, z double, p_value double, ci_low double, "
        "ci_high double, p_holm double, p_bh double, vif double"
    )
    table = spark.createDataFrame(rows, schema)
    tier = F.when(F.col("p_holm").isNotNull(), score.evidence_tier(F.col("p_value"), F.col("p_holm"), F.col("p_bh")))
    return table.withColumn("evidence", tier)


# ---- collinearity ----------------------------------------------------------------------------------

def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix from one pass; columns are shifted by their means first to keep digits."""
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shifted = df.select(*[(F.col(c) - float(means[i])).alias(c) for i, c in enumerate(columns)], F.lit(1.0).alias(CONST))
    g = cross_products(shifted, [CONST, *columns])
    cov = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
    dev = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(dev, dev)  # a constant column has NaN


def vif_of(corr: np.ndarray) -> list[float]:
    """Infinite for constant columns; for all others too if they depend on each other."""
    varies = np.flatnonzero(np.isfinite(np.diag(corr)))
    rest = corr[np.ix_(varies, varies)]
    out = np.full(len(corr), np.inf)
    if len(varies) and np.linalg.matrix_rank(rest) == len(varies):
        out[varies] = np.diag(np.linalg.inv(rest))
    return [float(v) for v in out]


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return dict(zip(columns, vif_of(correlation_matrix(df, columns))))


def vif_elimination(df: DataFrame, columns: list[str], limit: float = 5.0) -> list[dict]:
    """Drop the worst column until all are below the limit; every step uses a part of the same matrix."""
    corr, left, log = correlation_matrix(df, columns), list(range(len(columns))), []
    while len(left) > 1:
        values = vif_of(corr[np.ix_(left, left)])
        worst = int(np.argmax(values))
        if values[worst] < limit:
            break
        dropped, before = left.pop(worst), values[worst]
        after = vif_of(corr[np.ix_(left, left)])
        log.append({"step": len(log) + 1, "dropped": columns[dropped], "vif_before": before, "max_vif_after": max(after)})
    return log


# ---- diagnostics -----------------------------------------------------------------------------------

def residual_column(fit: LinearFit, y: str) -> Column:
    return F.col(f"`{y}`") - prediction(fit.columns, fit.beta)


def leverage(fit: LinearFit) -> Column:
    """x' (X'X)^-1 x with the inverse as literals."""
    out = F.lit(0.0)
    for i, a in enumerate(fit.columns):
        for j, b in enumerate(fit.columns[: i + 1]):
            weight = float(fit.xtx_inv[i, j]) * (1 if i == j else 2)
            ca = F.lit(1.0) if a == CONST else F.col(f"`{a}`")
            cb = F.lit(1.0) if b == CONST else F.col(f"`{b}`")
            out = out + ca * cb * weight
    return out


def with_influence(df: DataFrame, fit: LinearFit, y: str) -> DataFrame:
    """Adds residual, leverage and Cook's distance."""
    u, h = F.col("residual"), F.col("leverage")
    s2 = fit.ssr / (fit.n - fit.k)
    rows = df.withColumn("residual", residual_column(fit, y)).withColumn("leverage", leverage(fit))
    return rows.withColumn("cooks_distance", u * u / (fit.k * s2) * h / ((1 - h) * (1 - h)))


def breusch_pagan(df: DataFrame, fit: LinearFit, y: str) -> dict:
    """Lagrange and F form of the regression of squared residuals on the same columns."""
    squared = with_const(df).withColumn("_u2", residual_column(fit, y) ** 2)
    aux = fit_ols(squared, "_u2", fit.columns)
    q = fit.k - 1
    lm = aux.n * aux.r2
    f = (aux.r2 / q) / ((1 - aux.r2) / (aux.n - fit.k))
    return {"lm": lm, "lm_p": dist.chi2_tail(lm, q), "f": f, "f_p": dist.f_tail(f, q, aux.n - fit.k)}


def reset_test(df: DataFrame, fit: LinearFit, y: str, cluster: str | None = None, powers: tuple[int, ...] = (2, 3)) -> dict:
    """Adds powers of the fitted value: F from the residual sums, Wald from the cluster covariance.

    The fitted value is standardised first, which leaves both tests as they are and keeps the system well scaled.
    """
    fitted = with_const(df).withColumn("_fit", prediction(fit.columns, fit.beta))
    m, s = fitted.agg(F.avg("_fit"), F.stddev_pop("_fit")).first()
    unit = (F.col("_fit") - float(m)) / float(s or 1.0)
    names = [f"_fit{p}" for p in powers]
    for p, name in zip(powers, names):
        fitted = fitted.withColumn(name, unit**p)
    wide = fit_ols(fitted, y, [*fit.columns, *names], cluster)
    q, rest = len(powers), wide.n - wide.k
    f = ((fit.ssr - wide.ssr) / q) / (wide.ssr / rest)
    wald = wide.wald(names)
    return {"f": f, "f_p": dist.f_tail(f, q, rest), "wald": wald["statistic"], "wald_p": wald["p_value"]}


def compare_fits(spark: SparkSession, full: LinearFit, reduced: LinearFit) -> DataFrame:
    """Change of each coefficient after dropping rows, in standard errors, with a sign flag."""
    rows = []
    for c in full.columns:
        i, j = full.columns.index(c), reduced.columns.index(c)
        se = float(math.sqrt(full.cov[i, i]))
        delta = float(reduced.beta[j] - full.beta[i])
        rows.append((c, float(full.beta[i]), float(reduced.beta[j]), delta / se, bool(full.beta[i] * reduced.beta[j] < 0)))
    return spark.createDataFrame(rows, "term string, full double, reduced double, delta_in_se double, sign_change boolean")
