"""Splits, scaling, design matrices and split checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions.clean import mode_flag
from chartspark.operators import order
from chartspark.operators.profile import fingerprint

# Columns that leak the target or repeat a feature, never roots of a design column.
FORBIDDEN = (
    "rank", "peak_rank", "streams", "weeks_on_chart", "weeks_in_top10", "lifetime_average_rank", "tempo_bpm", "rms_energy",
    "dynamic_range", "beat_interval_variability", "loudness_proxy", "spectral_bandwidth", "unique_word_count", "lexical_diversity",
)


@dataclass(frozen=True)
class FeatureSpec:
    """Columns of a model table and how they enter the design."""

    key: str = "track"
    market: str = "market"
    target: str = "chart_score"
    audio: tuple[str, ...] = ("tempo", "energy", "tempo_stability", "rms_variability", "spectral_centroid", "chord_change_rate")
    lyrics: tuple[str, ...] = ("word_count", "repetition_ratio", "avg_word_length", "line_count", "chorus_repetition_count")
    year: str = "release_year"
    mode: str = "audio_mode"
    interactions: tuple[str, ...] = ("energy", "spectral_centroid", "word_count")
    markets: tuple[str, ...] = ("US", "VN", "KR")
    base: str = "US"
    logged: tuple[str, ...] = ("word_count",)
    fill: dict = field(default_factory=lambda: {"chorus_repetition_count": 0.0})
    tier_cuts: tuple[float, ...] = (70.0, 30.0, 0.0)
    forbidden: tuple[str, ...] = FORBIDDEN

    @property
    def continuous(self) -> list[str]:
        return [*self.audio, *self.lyrics, self.year]

    @property
    def dummies(self) -> list[str]:
        return [f"Market_{_name(m)}" for m in self.markets if m != self.base]

    @property
    def columns(self) -> list[str]:
        """Design columns in their fixed order."""
        std = [f"{c}_std" for c in self.audio] + ["mode"] + [f"{c}_std" for c in self.lyrics] + [f"{self.year}_std"]
        crossed = [f"{c}_std__x__{_name(m)}" for c in self.interactions for m in self.markets if m != self.base]
        return [*std, *self.dummies, *crossed]


def _name(market: str) -> str:
    return market.replace(" ", "_")


def drop_and_fill(df: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """Usable rows with the sanctioned fills, and dropped rows with a reason."""
    empty = F.lit(True)
    for c in spec.lyrics:
        empty = empty & F.col(c).isNull()
    bad = empty | F.col("word_count").isNull()
    kept = df.where(~bad).fillna(spec.fill)
    status = F.coalesce(F.col("lyrics_status"), F.lit("")) if "lyrics_status" in df.columns else F.lit("")
    instrumental = F.lower(F.coalesce(F.col("title"), F.lit(""))).contains("instrumental") if "title" in df.columns else F.lit(False)
    reason = F.when(instrumental | (status == "not_found"), "missing lyrics").otherwise("all lyric features null")
    return kept, df.where(bad).withColumn("reason", reason)


def seeded_hash(key: str, seed: int | Column) -> Column:
    """60 bits of md5(key|seed) as a whole number; the same order as the text of the digest."""
    tail = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), tail))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def group_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: the first ceil(share * G) groups in hash order; all rows of a group fall on one side."""
    groups = df.select(key).distinct().withColumn("_h", seeded_hash(key, seed)).withColumn("_all", F.lit(1))
    placed = order.counted_positions(groups, ["_all"], "_h")
    # merges: the groups of the whole table would be guessed small and sent through the driver in each use of the split
    sides = groups.join(placed.select("_h", "start", "total").hint("merge"), "_h")
    return df.join(sides.select(key, (F.col("start") < F.ceil(F.col("total") * share)).alias("is_test")).hint("merge"), key)


@dataclass(frozen=True)
class Scaler:
    mean: dict[str, float]
    deviation: dict[str, float]
    year_floor: float


def prepared(df: DataFrame, spec: FeatureSpec, year_floor: float) -> DataFrame:
    """log1p of the logged columns and the floor on the year."""
    out = df.withColumn(spec.year, F.when(F.col(spec.year).isNotNull(), F.greatest(F.col(spec.year).cast("double"), F.lit(year_floor))))
    return out.withColumns({c: F.log1p(F.col(c).cast("double")) for c in spec.logged})


def fit_scaler(train: DataFrame, spec: FeatureSpec) -> Scaler:
    """Means and population deviations of the training rows; the year is floored at its 1 % quantile first."""
    floor = float(order.exact_quantiles(train, [], spec.year, [0.01], ["q"]).first()["q"])
    rows = prepared(train, spec, floor)
    facts = rows.agg(*[f(c).alias(f"{n}_{c}") for c in spec.continuous for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = {c: float(facts[f"m_{c}"]) for c in spec.continuous}
    return Scaler(mean, {c: float(facts[f"s_{c}"]) or 1.0 for c in spec.continuous}, floor)


def design_matrix(df: DataFrame, spec: FeatureSpec, scaler: Scaler, keep: list[str] = ()) -> DataFrame:
    """Kept columns followed by the design columns in their fixed order."""
    rows = prepared(df, spec, scaler.year_floor)
    std = {f"{c}_std": (F.col(c) - scaler.mean[c]) / scaler.deviation[c] for c in spec.continuous}
    flags = {f"Market_{_name(m)}": (F.col(spec.market) == m).cast("double") for m in spec.markets if m != spec.base}
    rows = rows.withColumns({**std, **flags, "_mode": mode_flag(spec.mode, strict=True).cast("double")})
    crossed = {
        f"{c}_std__x__{_name(m)}": F.col(f"{c}_std") * F.col(f"Market_{_name(m)}")
        for c in spec.interactions for m in spec.markets if m != spec.base
    }
    rows = rows.withColumns(crossed)
    return rows.select(*keep, *[F.col("_mode").alias("mode") if c == "mode" else F.col(c) for c in spec.columns])


# ---- checks ----------------------------------------------------------------------------------------

def design_root(column: str) -> str:
    """The raw column or market that a design column is made from."""
    return column.split("__x__")[0].removesuffix("_std").removeprefix("Market_")


def tier(score: Column, cuts: tuple[float, ...]) -> Column:
    """Number of cuts above the score: 0 is the best tier. NULL scores have none."""
    return F.when(score.isNotNull(), sum((F.when(score < c, 1).otherwise(0) for c in cuts), F.lit(0)))


def split_checks(
    design: DataFrame, spec: FeatureSpec, again: DataFrame | None = None, drift_limit: float = 5.0, balance_limit: float = 0.2,
    min_test_rows: int = 100, row_share: tuple[float, float] = (0.17, 0.23),
) -> DataFrame:
    """(number, check, kind, value, status) of a design that keeps key, market, target and is_test: nine hard and four soft checks.

    Some checks have several rows. again is a second run of the split (key, is_test): the two are compared by content
    fingerprints of their groups; without it check 9 is left out. Row facts come from one aggregate, group facts and the
    market x tier table from one each; values that cannot be computed (no row on a side) are NULL and fail.
    """
    test = F.col("is_test")
    std = [c for c in spec.columns if c.endswith("_std")]
    binary = ["mode", *spec.dummies]
    crossed = [c for c in spec.columns if "__x__" in c]
    finite = F.lit(True)
    for c in [*spec.columns, spec.target]:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    exact = F.lit(True)
    for c in spec.interactions:
        for m in spec.markets:
            if m != spec.base:
                exact = exact & (F.abs(F.col(f"{c}_std__x__{_name(m)}") - F.col(f"{c}_std") * F.col(f"Market_{_name(m)}")) < 1e-9)
    zeroed = F.lit(True)
    for c in [*spec.dummies, *crossed]:
        zeroed = zeroed & (F.col(c) == 0)
    on = lambda c, side: F.when(test if side else ~test, F.col(c))
    y = F.col(spec.target)
    facts = design.agg(
        F.count_if(~finite).alias("not_finite"),
        F.greatest(*[F.abs(F.avg(on(c, False))) for c in std]).alias("worst_mean"),
        F.greatest(*[F.abs(F.stddev_pop(on(c, False)) - 1) for c in std]).alias("worst_deviation"),
        F.greatest(*[F.abs(F.avg(on(c, True))) for c in std]).alias("largest_test_mean"),
        F.count_if(~F.array_min(F.array(*[F.coalesce(F.col(c).isin(0.0, 1.0), F.lit(False)) for c in binary]))).alias("not_binary"),
        F.count_if((F.col(spec.market) == spec.base) & ~zeroed).alias("base_not_zero"),
        F.count_if(~exact).alias("interaction_off"),
        F.least(*[F.var_samp(on(c, False)) for c in spec.columns]).alias("least_variance"),
        (F.avg(test.cast("double")) * 100).alias("test_row_pct"),
        (F.abs(F.avg(on(spec.target, True)) - F.avg(on(spec.target, False))) / F.stddev_samp(on(spec.target, False))).alias("target_gap"),
    )
    sides = design.groupBy(spec.key).agg(F.count_distinct("is_test").alias("sides"), F.bool_or("is_test").alias("t"))
    groups = sides.agg(F.count_if(F.col("sides") > 1).alias("shared_groups"), (F.avg(F.col("t").cast("double")) * 100).alias("test_group_pct"))
    cells = [(m, t) for m in spec.markets for t in range(len(spec.tier_cuts) + 1)]
    count = lambda m, side: F.count_if((F.col(spec.market) == m) & (test if side else ~test))
    share = lambda m, side: count(m, side) / F.count_if(test if side else ~test)
    tiers = tier(y, spec.tier_cuts)
    markets = design.agg(
        F.greatest(*[F.abs(share(m, True) - share(m, False)) * 100 for m in spec.markets]).alias("market_drift"),
        F.least(*[count(m, True) for m in spec.markets]).alias("least_market_rows"),
        sum((F.when(F.count_if((F.col(spec.market) == m) & (tiers == t) & test) == 0, 1).otherwise(0) for m, t in cells), F.lit(0)).alias("empty_cells"),
    )
    one = F.lit(1).alias("_one")
    row = facts.select("*", one).join(groups.select("*", one), "_one").join(markets.select("*", one), "_one")
    missing = [c for c in spec.columns if c not in design.columns]
    order_off = int([c for c in design.columns if c in spec.columns] != spec.columns)
    forbidden = sum(design_root(c) in spec.forbidden or c in spec.forbidden for c in spec.columns)
    row = row.withColumns({"forbidden_columns": F.lit(forbidden), "column_order_off": F.lit(order_off + len(missing))})
    value = F.col
    rules = [
        (1, "shared_groups", "hard", value("shared_groups") == 0), (2, "forbidden_columns", "hard", value("forbidden_columns") == 0),
        (3, "not_finite", "hard", value("not_finite") == 0), (4, "column_order_off", "hard", value("column_order_off") == 0),
        (5, "worst_mean", "hard", value("worst_mean") < 1e-7), (5, "worst_deviation", "hard", value("worst_deviation") < 1e-7),
        (5, "largest_test_mean", "hard", value("largest_test_mean") >= 1e-7),
        (6, "not_binary", "hard", value("not_binary") == 0), (6, "base_not_zero", "hard", value("base_not_zero") == 0),
        (7, "interaction_off", "hard", value("interaction_off") == 0), (8, "least_variance", "hard", value("least_variance") > 1e-12),
        (10, "test_row_pct", "soft", value("test_row_pct").between(row_share[0] * 100, row_share[1] * 100)),
        (10, "test_group_pct", "soft", value("test_group_pct").isNotNull()),
        (11, "market_drift", "soft", value("market_drift") < drift_limit),
        (11, "least_market_rows", "soft", value("least_market_rows") >= min_test_rows),
        (12, "empty_cells", "soft", value("empty_cells") == 0), (13, "target_gap", "soft", value("target_gap") < balance_limit),
    ]
    if again is not None:
        own = fingerprint(design.select(spec.key, "is_test").distinct(), [spec.key], ["is_test"])
        other = fingerprint(again.select(spec.key, "is_test").distinct(), [spec.key], ["is_test"])
        both = own.select(F.col("fingerprint").alias("_a"), one).join(other.select(F.col("fingerprint").alias("_b"), one), "_one")
        row = row.join(both.select("_one", (F.col("_a") != F.col("_b")).cast("int").alias("repeat_differs")), "_one")
        rules.append((9, "repeat_differs", "hard", value("repeat_differs") == 0))
    found = [
        F.struct(F.lit(i).alias("number"), F.lit(n).alias("check"), F.lit(k).alias("kind"), F.col(n).cast("double").alias("value"),
                 F.when(ok, "PASS").otherwise("FAIL" if k == "hard" else "WARNING").alias("status")) for i, n, k, ok in rules
    ]
    return row.select(F.explode(F.array(*found)).alias("c")).select("c.*")


def seed_audit(
    df: DataFrame, spec: FeatureSpec, seeds: list[int], share: float = 0.2, drift_limit: float = 5.0, min_test_rows: int = 100
) -> DataFrame:
    """(seed, market_drift, least_market_rows, empty_cells, target_gap, passes) of the split of every seed, in one job.

    A seed passes when the markets' shares drift less than the limit, every market has rows enough in the test part, and every
    market x tier cell occurs there. Groups are summed once; each seed's last test hash is one row, so groups and seeds meet
    without a shuffle of their product.
    """
    y, tiers = F.col(spec.target).cast("double"), tier(F.col(spec.target), spec.tier_cuts)
    cells = {f"c_{i}_{t}": (m, t) for i, m in enumerate(spec.markets) for t in range(len(spec.tier_cuts) + 1)}
    sums = df.groupBy(spec.key).agg(
        *[F.count_if(F.col(spec.market) == m).alias(f"n_{i}") for i, m in enumerate(spec.markets)],
        *[F.count_if((F.col(spec.market) == m) & (tiers == t)).alias(c) for c, (m, t) in cells.items()],
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"),
    )
    sums = scale.cut_lineage(sums)
    tried = sums.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("_h", seeded_hash(spec.key, F.col("seed")))
    placed = order.counted_positions(tried.select("seed", "_h"), ["seed"], "_h")
    last = placed.where(F.col("start") < F.ceil(F.col("total") * share)).groupBy("seed").agg(F.max("_h").alias("_last"))
    sided = tried.join(F.broadcast(last), "seed").withColumn("t", F.col("_h") <= F.col("_last"))  # one row a seed
    on = lambda c, side: F.sum(F.when(F.col("t") == side, F.col(c)).otherwise(0))
    split = ["n", "y", "yy", *[f"n_{i}" for i in range(len(spec.markets))]]
    facts = sided.groupBy("seed").agg(
        *[on(c, side).alias(f"{c}_{int(side)}") for c in split for side in (True, False)], *[on(c, True).alias(c) for c in cells]
    )
    markets = range(len(spec.markets))
    drift = F.greatest(*[F.abs(F.col(f"n_{i}_1") / F.col("n_1") - F.col(f"n_{i}_0") / F.col("n_0")) * 100 for i in markets])
    sd = F.sqrt((F.col("yy_0") - F.col("y_0") ** 2 / F.col("n_0")) / (F.col("n_0") - 1))
    gap = F.abs(F.col("y_1") / F.col("n_1") - F.col("y_0") / F.col("n_0")) / sd
    least = F.least(*[F.col(f"n_{i}_1") for i in markets])
    empty = sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in cells), F.lit(0))
    passes = (drift < drift_limit) & (least >= min_test_rows) & (empty == 0)
    return facts.select(
        "seed", drift.alias("market_drift"), least.alias("least_market_rows"), empty.alias("empty_cells"), gap.alias("target_gap"),
        F.coalesce(passes, F.lit(False)).alias("passes"),
    )


def first_passing_seed(audit: DataFrame) -> int | None:
    return audit.where("passes").agg(F.min("seed").alias("s")).first()["s"]


def train_medians(train: DataFrame, spec: FeatureSpec) -> dict[str, float]:
    """Exact medians of the continuous columns; one number per column reaches the driver."""
    long = order.unpivot(train, [], spec.continuous)
    rows = order.exact_quantiles(long, ["feature"], "value", [0.5], ["m"]).collect()
    return {r["feature"]: r["m"] for r in rows}


def split_artifacts(train: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Median, 1 % and 99 % quantile of every continuous training column, and the median of the mode flag."""
    flagged = train.withColumn("_flag", mode_flag(spec.mode, strict=True).cast("double"))
    long = order.unpivot(flagged, [], [*spec.continuous, "_flag"])
    facts = order.exact_quantiles(long, ["feature"], "value", [0.5, 0.01, 0.99], ["median", "p01", "p99"])
    plain = F.col("feature") != "_flag"
    return facts.select(
        F.when(plain, F.col("feature")).otherwise("mode").alias("feature"), "median", F.when(plain, F.col("p01")).alias("p01"),
        F.when(plain, F.col("p99")).alias("p99"),
    )


def split_ids(rows: DataFrame, key: str) -> DataFrame:
    """(is_test, place, key): the sorted list of the groups of each side, as rows numbered from 0. Keys are whole numbers."""
    ids = rows.select("is_test", key).distinct()
    return order.counted_positions(ids, ["is_test"], key).select("is_test", F.col("start").alias("place"), key)


def list_hashes(ids: DataFrame, side: str, place: str, value: str, fan: int = 1024, levels: int = 3) -> DataFrame:
    """(side, n, digest): SHA-256 tree over a numbered list.

    The first level hashes `fan` neighbouring values joined by commas, each further level the joined digests of `fan`
    neighbours, the last level all that are left: with the defaults 1,000 digests for a list of 10^9. No list is ever one value.
    """
    rows = ids.select(side, F.col(place).alias("_i"), F.col(value).cast("string").alias("_v"), F.lit(1).cast("bigint").alias("_n"))
    for level in range(levels):
        piece = F.lit(0) if level == levels - 1 else F.floor(F.col("_i") / fan)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]), ",")
        rows = rows.groupBy(side, piece.cast("bigint").alias("_p")).agg(F.sha2(joined, 256).alias("_v"), F.sum("_n").alias("_n")).withColumnRenamed("_p", "_i")
    return rows.select(side, F.col("_n").alias("n"), F.col("_v").alias("digest"))
