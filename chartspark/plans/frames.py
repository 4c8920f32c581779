"""Frame-series queries: embeddings as frame vectors, events as beats."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions import vectors as V
from chartspark.operators import frames
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook

PLANS = PlanBook()

CLIP = 120
SIZE = 64


def clips(spark, sf):
    """Two minutes of one-second vectors per clip."""
    e = S.table(spark, sf, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / CLIP).alias("clip"), (F.col("vec_id") % CLIP).cast("int").alias("second"),
        V.doubles(F.col("embedding")).alias("vector"),
    )


CLIPS = f"clips AS (SELECT vec_id // {CLIP} AS clip, CAST(vec_id % {CLIP} AS INTEGER) AS second, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
UNITS = CLIPS + """, units AS (SELECT clip, second, list_transform(vector, lambda x: x / sqrt(list_dot_product(vector, vector))) AS vector
  FROM clips WHERE sqrt(list_dot_product(vector, vector)) > 1e-8)"""


@PLANS.add(
    "frm_01_second_means",
    f"""WITH {CLIPS} SELECT clip, CAST(second // 4 AS INTEGER) AS second, round(AVG(vector[1]), 6) AS d1, round(AVG(vector[{SIZE}]), 6) AS dlast FROM clips GROUP BY 1, 2""",
)
def second_means(spark, sf):
    frames_ = clips(spark, sf).withColumn("t", F.col("second") / 4)
    out = frames.second_means(frames_, "clip", "t", "vector", SIZE)
    return out.select("clip", "second", F.round(F.element_at("vector", 1), 6).alias("d1"), F.round(F.element_at("vector", SIZE), 6).alias("dlast"))


@PLANS.add(
    "frm_02_unit_vectors",
    f"""WITH {UNITS} SELECT clip, second, round(vector[1], 6) AS d1, round(list_dot_product(vector, vector), 6) AS square FROM units""",
)
def unit_vectors(spark, sf):
    out = frames.l2_normalized(clips(spark, sf), "vector")
    return out.select("clip", "second", F.round(F.element_at("vector", 1), 6).alias("d1"), F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("square"))


@PLANS.add(
    "frm_02_time_standardized",
    f"""WITH {CLIPS} SELECT clip, second, round((vector[1] - AVG(vector[1]) OVER w) / stddev_pop(vector[1]) OVER w, 6) AS d1,
    round((vector[7] - AVG(vector[7]) OVER w) / stddev_pop(vector[7]) OVER w, 6) AS d7 FROM clips WINDOW w AS (PARTITION BY clip)""",
)
def time_standardized(spark, sf):
    out = frames.time_standardized(clips(spark, sf), "clip", "vector", SIZE)
    return out.select("clip", "second", *[F.round(F.element_at("vector", i), 6).alias(f"d{i}") for i in (1, 7)])


@PLANS.add(
    "frm_03_recurrence",
    f"""WITH {UNITS}, ranked AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY second) AS i, vector FROM units),
    pairs AS (SELECT a.clip, a.i, b.i - a.i AS gap, list_dot_product(a.vector, b.vector) AS s FROM ranked a JOIN ranked b ON a.clip = b.clip AND b.i - a.i >= 10),
    lim AS (SELECT clip, quantile_cont(s, 0.95) AS t FROM pairs GROUP BY 1),
    hits AS (SELECT p.clip, p.gap, p.i, p.i - row_number() OVER (PARTITION BY p.clip, p.gap ORDER BY p.i) AS island FROM pairs p JOIN lim ON lim.clip = p.clip AND s >= t),
    runs AS (SELECT clip, gap, island, COUNT(*) AS n FROM hits GROUP BY 1, 2, 3),
    facts AS (SELECT clip, SUM(n) AS points, coalesce(SUM(n) FILTER (WHERE n >= 3), 0) AS inside, AVG(n) FILTER (WHERE n >= 3) AS mean_run, MAX(n) FILTER (WHERE n >= 3) AS longest FROM runs GROUP BY 1),
    sizes AS (SELECT clip, COUNT(*) AS n_seconds FROM units GROUP BY 1)
    SELECT z.clip, z.n_seconds, round(coalesce(CAST(inside AS DOUBLE) / points, 0), 6) AS determinism, round(coalesce(mean_run, 0), 6) AS mean_run,
    CAST(coalesce(longest, 0) AS DOUBLE) AS longest_run, 'success' AS status FROM sizes z LEFT JOIN facts f ON f.clip = z.clip""",
)
def recurrence(spark, sf):
    units = frames.l2_normalized(clips(spark, sf), "vector")
    out = frames.recurrence(units, "clip", "second", "vector")
    return out.withColumn("determinism", F.round("determinism", 6)).withColumn("mean_run", F.round("mean_run", 6))


@PLANS.add(
    "frm_04_segment_similarity",
    f"""WITH {CLIPS}, dims AS (SELECT clip, second // 10 AS segment, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM clips),
    means AS (SELECT clip, segment, d, AVG(x) AS x, COUNT(*) AS n FROM dims GROUP BY 1, 2, 3),
    segs AS (SELECT clip, segment, list(x ORDER BY d) AS v FROM means WHERE n = 10 GROUP BY 1, 2),
    nums AS (SELECT clip, COUNT(*) AS n_segments FROM segs GROUP BY 1)
    SELECT n.clip, n.n_segments, round(AVG(list_cosine_similarity(a.v, b.v)), 6) AS self_similarity FROM nums n
    LEFT JOIN segs a ON a.clip = n.clip LEFT JOIN segs b ON b.clip = a.clip AND b.segment > a.segment GROUP BY 1, 2""",
)
def segment_similarity(spark, sf):
    out = frames.segment_similarity(clips(spark, sf), "clip", "second", "vector", SIZE)
    return out.withColumn("self_similarity", F.round("self_similarity", 6))


def chroma(spark, sf):
    """The first twelve dimensions, made positive, as pitch classes of a beat."""
    return clips(spark, sf).select(
        "clip", "second", F.transform(F.slice("vector", 1, 12), lambda x: F.abs(x)).alias("chroma")
    )


_PROFILES = ", ".join(
    f"({2 * root + k}, '{frames.PITCH_CLASSES[root]}', '{mode}', {rot[root]})"
    for root in range(12)
    for k, (mode, rot) in enumerate((("major", frames.rotations(frames.MAJOR_PROFILE)), ("minor", frames.rotations(frames.MINOR_PROFILE))))
)


@PLANS.add(
    "frm_05_key_and_mode",
    f"""WITH {CLIPS}, dims AS (SELECT clip, d, AVG(abs(vector[d])) AS x FROM clips, range(1, 13) r(d) GROUP BY 1, 2),
    profiles AS (SELECT * FROM (VALUES {_PROFILES}) v(o, key, mode, p)),
    cors AS (SELECT clip, o, key, mode, corr(x, p[d]) AS r FROM dims CROSS JOIN profiles GROUP BY 1, 2, 3, 4)
    SELECT clip, key, mode, round(greatest(0, least(1, r)), 6) AS key_confidence FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY r DESC, o) AS place FROM cors) WHERE place = 1""",
)
def key_and_mode(spark, sf):
    return frames.key_and_mode(chroma(spark, sf), "clip", "chroma").withColumn("key_confidence", F.round("key_confidence", 6))


@PLANS.add(
    "frm_06_chord_change_rate",
    f"""WITH {CLIPS}, scores AS (SELECT clip, second, root * 2 + k AS c, abs(vector[root + 1]) + abs(vector[(root + 4 - k) % 12 + 1]) + abs(vector[(root + 7) % 12 + 1]) AS s
      FROM clips, range(12) a(root), range(2) b(k)),
    chords AS (SELECT clip, second, arg_min(c, struct_pack(a := -s, b := c)) AS c FROM scores GROUP BY 1, 2),
    pad AS (SELECT clip, second, c, coalesce(lag(c) OVER w, 0) AS p, coalesce(lead(c) OVER w, 0) AS n, lag(c) OVER w IS NULL AS head FROM chords WINDOW w AS (PARTITION BY clip ORDER BY second)),
    smooth AS (SELECT clip, second, list_sort([p, c, n])[2] AS m FROM pad),
    moves AS (SELECT clip, m <> lag(m) OVER (PARTITION BY clip ORDER BY second) AS moved FROM smooth)
    SELECT clip, COUNT(*) FILTER (WHERE moved) AS changes, round(COUNT(*) FILTER (WHERE moved) / (COUNT(*) / 60.0), 6) AS chord_change_rate FROM moves GROUP BY 1""",
)
def chord_change_rate(spark, sf):
    out = frames.chord_change_rate(chroma(spark, sf), "clip", "second", "chroma", F.count(F.lit(1)) / 60.0)
    return out.withColumn("chord_change_rate", F.round("chord_change_rate", 6))


@PLANS.add(
    "frm_07_energy_profile",
    """SELECT user_id, round(AVG(value), 6) AS energy, round(stddev_pop(value), 6) AS rms_variability,
    round(quantile_cont(20 * log10(greatest(value, 1e-10)), 0.9) - quantile_cont(20 * log10(greatest(value, 1e-10)), 0.1), 6) AS dynamic_range,
    round(20 * log10(greatest(AVG(value), 1e-10)), 6) AS loudness_proxy FROM events GROUP BY 1""",
)
def energy_profile(spark, sf):
    out = frames.energy_profile(S.table(spark, sf, "events"), "user_id", "value")
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


_BEATS = """beats AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t FROM events),
steps AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS previous FROM beats)"""


def beats(spark, sf):
    return S.table(spark, sf, "events").select(
        "user_id", (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts") / F.lit(1000000.0)).alias("t")
    )


@PLANS.add("win_05_intervals", f"WITH {_BEATS} SELECT user_id, round(t, 6) AS t, round(t - previous, 6) AS step FROM steps")
def intervals(spark, sf):
    from chartspark.operators.order import neighbour_steps

    steps = neighbour_steps(beats(spark, sf), ["user_id"], "t", F.floor(F.col("t") / 86400))
    return steps.select("user_id", F.round("t", 6).alias("t"), F.round(F.col("t") - F.col("previous"), 6).alias("step"))


@PLANS.add(
    "frm_08_event_rhythm",
    f"""WITH {_BEATS} SELECT user_id, COUNT(*) AS n_events, round(COUNT(*) / 43200.0, 9) AS events_per_minute,
    round(CASE WHEN COUNT(*) >= 3 THEN stddev_pop(t - previous) END, 3) AS interval_variability,
    round(1 / (1 + CASE WHEN COUNT(*) >= 3 THEN stddev_pop(t - previous) END), 9) AS stability FROM steps GROUP BY 1""",
)
def event_rhythm(spark, sf):
    out = frames.event_rhythm(beats(spark, sf), "user_id", "t", F.floor(F.col("t") / 86400), 43200.0)
    return out.select(
        "user_id", "n_events", F.round("events_per_minute", 9).alias("events_per_minute"),
        F.round("interval_variability", 3).alias("interval_variability"), F.round("stability", 9).alias("stability"),
    )


@PLANS.add(
    "frm_09_finite_means",
    """WITH f AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE ELSE value END AS a, value * 2 AS b FROM events)
    SELECT user_id, round(coalesce(AVG(a) FILTER (WHERE isfinite(a) AND isfinite(b)), 2200), 6) AS centroid,
    round(coalesce(AVG(b) FILTER (WHERE isfinite(a) AND isfinite(b)), 2400), 6) AS bandwidth FROM f GROUP BY 1""",
)
def finite_means(spark, sf):
    i = F.col("event_id")
    a = F.when(i % 5 == 0, F.lit(float("nan"))).when(i % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = S.table(spark, sf, "events").select("user_id", a.alias("centroid"), (F.col("value") * 2).alias("bandwidth"))
    out = frames.finite_means(rows, "user_id", {"centroid": 2200.0, "bandwidth": 2400.0})
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("centroid", "bandwidth")])


@PLANS.add(
    "frm_10_envelope",
    """WITH n AS (SELECT event_type, (MAX(event_id) + 1) AS n FROM events GROUP BY 1)
    SELECT e.event_type, CAST(event_id // greatest(1, CAST(ceil(n / 1000.0) AS BIGINT)) AS BIGINT) AS bin, MIN(value) AS low, MAX(value) AS high
    FROM events e JOIN n ON n.event_type = e.event_type GROUP BY 1, 2""",
)
def envelope(spark, sf):
    return frames.envelope(S.table(spark, sf, "events"), "event_type", "event_id", "value")


@PLANS.add(
    "win_07_runs",
    """WITH d AS (SELECT DISTINCT l_partkey AS track, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS day FROM lineitem),
    i AS (SELECT track, day, day - row_number() OVER (PARTITION BY track ORDER BY day) AS island FROM d)
    SELECT track, n AS run_length, COUNT(*) AS runs FROM (SELECT track, island, COUNT(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1, 2""",
)
def runs(spark, sf):
    from chartspark.operators.order import run_lengths

    days = S.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("track"), F.date_diff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).alias("day")
    )
    out = run_lengths(days.distinct(), ["track"], "day")
    return out.groupBy("track", "run_length").agg(F.count(F.lit(1)).alias("runs"))
