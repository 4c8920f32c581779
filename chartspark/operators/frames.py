"""Aggregates over frame series of a track: seconds, recurrence, key, chords, energy, events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions import vectors as V
from chartspark.operators import order
from chartspark.operators.recurrence import recurrence  # noqa: F401

# Pitch classes and key profiles.
PITCH_CLASSES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def second_means(df: DataFrame, track: str, time: str, vector: str, size: int) -> DataFrame:
    """Mean vector per whole second; one average per dimension, so nothing is exploded."""
    dims = [F.avg(F.element_at(vector, i + 1).cast("double")).alias(f"_d{i}") for i in range(size)]
    sums = df.groupBy(track, F.floor(time).cast("int").alias("second")).agg(*dims)
    return sums.select(track, "second", F.array(*[F.col(f"_d{i}") for i in range(size)]).alias("vector"))


def l2_normalized(df: DataFrame, vector: str, eps: float = 1e-8) -> DataFrame:
    """Unit vectors; near-zero and non-finite vectors drop out."""
    n = V.norm(F.col(vector))
    sized = df.withColumn("_norm", n).where((F.col("_norm") > eps) & (F.col("_norm") < float("inf")))
    return sized.withColumn(vector, F.transform(vector, lambda x: x / F.col("_norm"))).drop("_norm")


def time_standardized(df: DataFrame, track: str, vector: str, size: int) -> DataFrame:
    """Each dimension minus its mean over time by its population deviation; a flat dimension is only centred."""
    at = [F.element_at(vector, i + 1) for i in range(size)]
    facts = df.groupBy(track).agg(
        F.array(*[F.avg(x) for x in at]).alias("_mean"), F.array(*[F.stddev_pop(x) for x in at]).alias("_dev")
    )
    flat = F.transform("_dev", lambda d: F.when(d < 1e-8, 1.0).otherwise(d))
    centred = F.zip_with(F.col(vector), F.col("_mean"), lambda x, m: x - m)
    return df.join(facts, track).withColumn(vector, F.zip_with(centred, flat, lambda x, d: x / d)).drop("_mean", "_dev")


def segment_similarity(df: DataFrame, track: str, second: str, vector: str, size: int, length: int = 10) -> DataFrame:
    """Mean cosine over all pairs of whole segments.

    For unit vectors the sum over pairs is (|sum|^2 - n) / 2, so one sum per dimension replaces the pairs.
    """
    segments = df.groupBy(track, F.floor(F.col(second) / length).alias("segment")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(F.element_at(vector, i + 1)).alias(f"_d{i}") for i in range(size)]
    ).where(F.col("_n") == length)
    packed = segments.select(track, F.array(*[F.col(f"_d{i}") for i in range(size)]).alias("v"))
    units = l2_normalized(packed, "v", 1e-10)
    sums = units.groupBy(track).agg(
        F.count(F.lit(1)).alias("n_segments"), *[F.sum(F.element_at("v", i + 1)).alias(f"_s{i}") for i in range(size)]
    )
    n, square = F.col("n_segments"), sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(size)), F.lit(0.0))
    return sums.select(track, "n_segments", F.when(n > 1, (square - n) / (n * (n - 1))).alias("self_similarity"))


def _centred_unit(values: list[float]) -> list[float]:
    mean = sum(values) / len(values)
    centred = [v - mean for v in values]
    length = math.sqrt(sum(v * v for v in centred))
    return [v / length for v in centred]


def rotations(profile: list[float]) -> list[list[float]]:
    """The profile moved to each of its twelve roots."""
    n = len(profile)
    return [[profile[(i - root) % n] for i in range(n)] for root in range(n)]


def key_and_mode(df: DataFrame, track: str, chroma: str) -> DataFrame:
    """Key, mode and confidence: best Pearson correlation of the mean chroma with 24 rotated profiles.

    The mean is one aggregate per pitch class; the profiles are literals, so there is no join.
    """
    means = df.groupBy(track).agg(*[F.avg(F.element_at(chroma, i + 1).cast("double")).alias(f"_c{i}") for i in range(12)])
    packed = means.select(track, F.array(*[F.col(f"_c{i}") for i in range(12)]).alias("c"))
    centre = packed.withColumn("_m", V.total(F.col("c")) / 12)
    centred = centre.withColumn("d", F.transform("c", lambda x: x - F.col("_m"))).withColumn("_len", V.norm(F.col("d")))
    scored = []
    for root, (major, minor) in enumerate(zip(rotations(MAJOR_PROFILE), rotations(MINOR_PROFILE))):
        for k, (mode, profile) in enumerate((("major", major), ("minor", minor))):
            r = V.dot(F.col("d"), V.literal(_centred_unit(profile))) / F.col("_len")
            scored.append(F.struct(r.alias("r"), F.lit(-(2 * root + k)).alias("o"), F.lit(PITCH_CLASSES[root]).alias("key"), F.lit(mode).alias("mode")))
    silent = ~(F.col("_len") > 0)
    default = F.struct(F.lit(0.5).alias("r"), F.lit(0).alias("o"), F.lit("C").alias("key"), F.lit("major").alias("mode"))
    best = centred.withColumn("_b", F.when(silent, default).otherwise(F.array_max(F.array(*scored))))
    return best.select(
        track, F.col("_b.key").alias("key"), F.col("_b.mode").alias("mode"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_b.r"))).alias("key_confidence"),
    )


def chord_index(chroma: Column) -> Column:
    """Best of 24 triads: even numbers major, odd numbers minor, first wins on equal scores."""
    scored = []
    for root in range(12):
        for k, third in enumerate((4, 3)):
            notes = {root, (root + third) % 12, (root + 7) % 12}
            s = sum((F.element_at(chroma, i + 1) for i in sorted(notes)), F.lit(0.0))
            scored.append(F.struct(s.alias("s"), F.lit(-(2 * root + k)).alias("o")))
    return -F.array_max(F.array(*scored))["o"]


def chord_change_rate(df: DataFrame, track: str, beat: str, chroma: str, minutes: Column) -> DataFrame:
    """Chord changes per minute after a median filter of three over the beats.

    Each beat is handed to the beats around it and grouped by (track, beat), so a long track is never ordered in one
    task. The filter is padded with zeros at both ends, the first beat is no change. Beats are numbered without gaps.
    """
    chords = df.select(track, F.col(beat).alias("_b"), chord_index(F.col(chroma)).alias("_c"))
    facts = df.groupBy(track).agg(minutes.alias("_minutes"), F.count(F.lit(1)).alias("_n"))
    # a row is needed by the filters of the next two rows and of the row before
    shifts = F.array(*[F.struct((F.col("_b") + s).alias("at"), F.lit(s).alias("s")) for s in (-1, 0, 1, 2)])
    near = chords.select(track, F.explode(shifts).alias("x"), "_c").select(track, "x.at", "x.s", "_c")
    wide = near.groupBy(track, "at").agg(
        *[F.max(F.when(F.col("s") == s, F.col("_c"))).alias(name) for s, name in ((-1, "next"), (0, "here"), (1, "prev"), (2, "prev2"))]
    ).where("here is not null")
    zero = F.lit(0)

    def median3(a: Column, b: Column, c: Column) -> Column:
        return F.element_at(F.array_sort(F.array(F.coalesce(a, zero), b, F.coalesce(c, zero))), 2)

    joined = wide.join(facts, track)
    n = F.col("_n")
    now = F.when(n >= 3, median3(F.col("prev"), F.col("here"), F.col("next"))).otherwise(F.col("here"))
    before = F.when(n >= 3, median3(F.col("prev2"), F.col("prev"), F.col("here"))).otherwise(F.col("prev"))
    changes = F.count_if(F.col("prev").isNotNull() & (now != before))
    counted = joined.groupBy(track).agg(changes.alias("changes"), F.first("_minutes").alias("_minutes"))
    rate = F.when(F.col("_minutes") <= 0.05, 0.0).otherwise(F.col("changes") / F.col("_minutes"))
    return counted.select(track, "changes", rate.alias("chord_change_rate"))


def energy_profile(df: DataFrame, track: str, rms: str, floor: float = 1e-10) -> DataFrame:
    """Mean, population deviation, dB range between the 10th and 90th percentile, loudness of the mean."""
    finite = df.where(F.col(rms).isNotNull() & ~F.isnan(rms) & (F.abs(F.col(rms)) < float("inf")))
    level = finite.withColumn("_db", 20.0 * F.log10(F.greatest(F.col(rms), F.lit(floor))))
    basic = level.groupBy(track).agg(F.avg(rms).alias("energy"), F.stddev_pop(rms).alias("rms_variability"))
    marks = order.exact_quantiles(level, [track], "_db", [0.1, 0.9], ["_p10", "_p90"])
    return basic.join(marks, track).select(
        track, "energy", "rms_variability", (F.col("_p90") - F.col("_p10")).alias("dynamic_range"),
        (20.0 * F.log10(F.greatest(F.col("energy"), F.lit(floor)))).alias("loudness_proxy"),
    )


def event_rhythm(
    df: DataFrame, track: str, at: str, block: Column, minutes: float, default_variability: float | None = None
) -> DataFrame:
    """Event rate per minute, population deviation of the intervals and stability; fewer than three events have none."""
    steps = order.neighbour_steps(df.select(track, at), [track], at, block)
    basic = steps.groupBy(track).agg(
        F.count(F.lit(1)).alias("n_events"), F.stddev_pop(F.col(at) - F.col("previous")).alias("_sd")
    )
    variability = F.when(F.col("n_events") >= 3, F.col("_sd"))
    if default_variability is not None:
        variability = F.coalesce(variability, F.lit(default_variability))
    return basic.select(
        track, "n_events", (F.col("n_events") / max(minutes, 0.05)).alias("events_per_minute"),
        variability.alias("interval_variability"), (1.0 / (1.0 + variability)).alias("stability"),
    )


def finite_means(df: DataFrame, track: str, columns: dict[str, float]) -> DataFrame:
    """Means over frames in which all columns are finite, with a default for a track without such frames."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.groupBy(track).agg(
        *[F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(default)).alias(c) for c, default in columns.items()]
    )


def envelope(df: DataFrame, track: str, index: str, value: str, bins: int = 1000) -> DataFrame:
    """Lowest and highest value in at most `bins` equal steps."""
    sizes = df.groupBy(track).agg((F.max(index) + 1).alias("_n"))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / bins))
    placed = df.join(sizes, track).withColumn("bin", F.floor(F.col(index) / step))
    return placed.groupBy(track, "bin").agg(F.min(value).alias("low"), F.max(value).alias("high"))
