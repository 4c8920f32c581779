"""Scores, tiers and displayed numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions.clean import threshold_label
from chartspark.operators import order, profile

# Quartiles of the performance score used as tier cut points.
SCORE_CUTS = [(37.58, "Tier 1"), (15.16, "Tier 2"), (-11.93, "Tier 3")]
LAST_TIER = "Tier 4"

# Quantiles kept per market, the screener mark first after the quartiles.
BAND_PROBS = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p78": 0.78, "p90": 0.9}

# Score domain of predictions and effect-size steps.
SCORE_DOMAIN = (-99.0, 100.0)
EFFECT_STEPS = [(0.14, "large"), (0.06, "medium"), (0.01, "small")]


def score_tier(c: str | Column, cuts=SCORE_CUTS, last: str = LAST_TIER) -> Column:
    return threshold_label(c, cuts, last)


def quantile_bands(df: DataFrame, market: str, value: str, overall: str | None = None, probs: dict[str, float] = BAND_PROBS) -> DataFrame:
    """min, quantiles, max, mean and deviation of a score per market, with an overall row when named."""
    rows = profile.with_overall(df.select(market, value), market, overall) if overall else df.select(market, value)
    return profile.describe(rows, [market], value, probs)


def interpolated_percentile(s: Column, digits: int | None = 1) -> Column:
    """Percentile of a score between the quantile columns min, q1, median, q3, p90, max on the same row."""
    steps = [("min", "q1", 1.0, 24.0), ("q1", "median", 25.0, 25.0), ("median", "q3", 50.0, 25.0),
             ("q3", "p90", 75.0, 15.0), ("p90", "max", 90.0, 9.0)]
    out = F.when(s <= F.col("min"), F.lit(1.0)).when(s >= F.col("max"), F.lit(99.0))
    for i, (low, high, base, width) in enumerate(steps):
        span = F.col(high) - F.col(low)
        share = F.when(span > 1e-6, (s - F.col(low)) / span).otherwise(F.lit(0.5))
        value = base + share * width
        out = out.when(s < F.col(high), value) if i < len(steps) - 1 else out.otherwise(value)
    out = F.when(s.isNotNull(), out)
    return out if digits is None else F.bround(out, digits)


def fit_tier(s: Column) -> Column:
    """Tier of a score against the quartile columns q1, median, q3 on the same row."""
    return (
        F.when(s >= F.col("q3"), "Tier 1").when(s >= F.col("median"), "Tier 2").when(s >= F.col("q1"), "Tier 3").otherwise(LAST_TIER)
    )


def fit_profile(scores: DataFrame, bands: DataFrame, score: str, market: str, fallback: str = "ALL") -> DataFrame:
    """Percentile, top share, screener flag and tier of each score; unknown markets use the fallback bands."""
    known = bands.select(F.col(market).alias("_known"))
    used = F.when(F.col("_known").isNotNull(), F.col(market)).otherwise(F.lit(fallback))
    placed = scores.join(known, scores[market] == F.col("_known"), "left").withColumn("_used", used).drop("_known")
    marks = bands.drop("n", "mean", "std").withColumnRenamed(market, "_used")
    joined = placed.join(marks, "_used")
    s = F.col(score)
    pct = interpolated_percentile(s)
    return joined.select(
        *scores.columns,
        F.col("_used").alias("reference_market"),
        pct.alias("percentile"),
        F.greatest(F.lit(1.0), F.bround(100.0 - pct, 1)).alias("top_percent"),
        (s >= F.col("p78")).alias("is_top22"),
        fit_tier(s).alias("tier"),
    )


def gap_category(actual_tier: Column, fit_tier_: Column) -> Column:
    """Code of the gap between reached tier and expected tier; a tier without digit counts as 2."""
    def digit(c: Column) -> Column:
        last = F.substring(c, -1, 1)
        return F.when(last.rlike(r"^\d$"), last.cast("int")).otherwise(F.lit(2))

    act, fit = digit(actual_tier), digit(fit_tier_)
    return (
        F.when((act == 1) & (fit == 1), "consensus_hit")
        .when((act == 1) & (fit > 1), "superstar")
        .when((act >= 3) & (fit == 1), "sleeper")
        .when((act == 4) & (fit == 4), "atypical")
        .otherwise("mainstream")
    )


def evidence_tier(p: Column, holm: Column, bh: Column, alpha: float = 0.05) -> Column:
    return (
        F.when(holm < alpha, "confirmed")
        .when(bh < alpha, "suggestive")
        .when(p < alpha, "nominal")
        .otherwise("none")
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def effect_size(c: str | Column) -> Column:
    return threshold_label(c, EFFECT_STEPS, "negligible")


def heuristic_scores(market: Column, energy: Column, centroid: Column, repetition: Column) -> tuple[Column, Column]:
    """Linear and saturating fallback scores used when no model is present."""
    # Market bases, centres and weights of the fallback.
    base = F.when(market == "US", 12.67).when(market == "KR", 1.09).otherwise(-2.12)
    effect = (
        F.when(market == "KR", (energy - 0.25) * 45.0 + (centroid - 2380.0) / 440.0 * 8.5)
        .when(market == "VN", -(energy - 0.22) * 35.0 - (centroid - 2150.0) / 440.0 * 7.2)
        .otherwise((repetition - 0.60) * 12.0)
    )
    return base + effect, base + F.tanh(effect / 15.0) * 12.0


def interval_bounds(c: str | Column) -> tuple[Column, Column, Column]:
    """Low, high and does-it-contain-zero of an interval text; NULL unless it holds exactly two numbers."""
    text = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(text, F.lit(r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"), F.lit(1))
    numbers = F.when(F.size(found) == 2, F.transform(found, lambda x: x.try_cast("double")))
    low, high = numbers[0], numbers[1]
    return low, high, (low <= 0) & (high >= 0)


def display_number(c: str | Column, digits: int = 3) -> Column:
    """Fixed digits; values that would show as zero in scientific form; NULL as n/a."""
    v = F.col(c) if isinstance(c, str) else c
    tiny = (v != 0) & (F.abs(v) < 0.5 * 10 ** -digits)
    return (
        F.when(v.isNull(), "n/a").when(tiny, F.format_string(f"%.{digits - 1}e", v)).otherwise(F.format_string(f"%.{digits}f", v))
    )


def display_p(c: str | Column) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    return F.when(v.isNull(), "n/a").when(v < 0.001, "< 0.001").otherwise(F.format_string("%.3f", v))
