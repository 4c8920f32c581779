"""Integration queries: star joins, flags, exclusions, reconciliation, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark.functions import clean, score
from chartspark.operators import chart, design, integrate, order, quality
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook
from chartspark.scale import cut_lineage

PLANS = PlanBook()

DATASET = f"""{S.SAMPLE}, perf AS (
  SELECT track, market, AVG(rank) AS lifetime_average_rank, MIN(rank) AS peak_rank, COUNT(*) AS weeks_on_chart,
         COUNT(*) FILTER (WHERE rank BETWEEN 1 AND 10) AS weeks_in_top10, 101 - AVG(rank) AS chart_score
  FROM weekly GROUP BY 1, 2),
{S.SONGS}, {S.AUDIO}, {S.MAPPING}, {S.LYRICS},
dataset AS (
  SELECT p.track, p.market, p.chart_score, p.peak_rank, p.weeks_on_chart, s.title, s.artist, s.album,
         CAST(year(s.release_date) AS INTEGER) AS release_year, a.tempo_bpm, a.beat_interval_variability, a.rms_energy,
         a.rms_variability, a.spectral_centroid, a.chord_change_rate, a.audio_mode, m.is_selected AS mapping_is_selected,
         l.word_count, l.unique_word_count, l.lexical_diversity, l.repetition_ratio, l.avg_word_length, l.line_count,
         l.chorus_repetition_count, l.title_word_in_lyrics, l.language, l.lyrics_status,
         a.track IS NOT NULL AS has_audio, l.track IS NOT NULL AS has_lyrics_row,
         a.track IS NOT NULL AND l.track IS NOT NULL AS has_both_rows,
         EXISTS (SELECT 1 FROM sample q WHERE q.track = p.track) AS is_sampled
  FROM perf p JOIN songs s ON s.track = p.track LEFT JOIN audio a ON a.track = p.track
  LEFT JOIN mapping m ON m.mapping_id = a.mapping_id AND m.is_selected = TRUE
  LEFT JOIN lyric_rows l ON l.track = p.track)"""

_FLAGS = ["has_audio", "has_lyrics_row", "has_both_rows", "is_sampled"]


def modeling(spark, sf):
    # performance and sample come from the same charts, whose filters differ too much for Spark to share the work on all line items
    weeks = cut_lineage(S.weekly(spark, sf))
    return integrate.modeling_dataset(
        S.perf(spark, sf, weeks), S.songs(spark, sf), S.audio(spark, sf), S.mapping(spark, sf), S.lyric_rows(spark, sf),
        S.sample(spark, sf, weeks), "track",
    )


def _w(body: str) -> str:
    return f"WITH {DATASET} {body}"


@PLANS.add(
    "jon_02_modeling_dataset",
    _w("""SELECT track, market, round(chart_score, 6) AS chart_score, title, artist, release_year,
    round(tempo_bpm, 6) AS tempo_bpm, audio_mode, mapping_is_selected, word_count, lyrics_status,
    has_audio, has_lyrics_row, has_both_rows, is_sampled FROM dataset"""),
)
def modeling_dataset(spark, sf):
    return modeling(spark, sf).select(
        "track", "market", F.round("chart_score", 6).alias("chart_score"), "title", "artist", "release_year",
        F.round("tempo_bpm", 6).alias("tempo_bpm"), "audio_mode", "mapping_is_selected", "word_count", "lyrics_status", *_FLAGS,
    )


@PLANS.add(
    "prj_08_clean_dataset",
    _w("""SELECT track, market, title, artist, round(chart_score, 6) AS chart_score, release_year,
    round(tempo_bpm, 6) AS tempo, round(rms_energy, 6) AS energy, round(1 / (1 + beat_interval_variability), 6) AS tempo_stability,
    CASE WHEN audio_mode IN ('1', 'major', 'Major') THEN 1 ELSE 0 END AS mode, word_count,
    round(repetition_ratio, 6) AS repetition_ratio FROM dataset WHERE is_sampled AND has_both_rows"""),
)
def clean_dataset(spark, sf):
    return modeling(spark, sf).where("is_sampled and has_both_rows").select(
        "track", "market", "title", "artist", F.round("chart_score", 6).alias("chart_score"), "release_year",
        F.round("tempo_bpm", 6).alias("tempo"), F.round("rms_energy", 6).alias("energy"),
        F.round(clean.tempo_stability("beat_interval_variability"), 6).alias("tempo_stability"),
        clean.mode_flag("audio_mode", strict=False).alias("mode"), "word_count",
        F.round("repetition_ratio", 6).alias("repetition_ratio"),
    )


@PLANS.add(
    "prj_07_flags_by_status",
    _w("""SELECT track, market, tempo_bpm IS NOT NULL AS has_audio, lyrics_status IS NOT NULL AS has_lyrics_row,
    tempo_bpm IS NOT NULL AND coalesce(lyrics_status = 'success', FALSE) AS has_both_rows FROM dataset"""),
)
def flags_by_status(spark, sf):
    flagged = integrate.completeness_by_status(modeling(spark, sf), "tempo_bpm")
    return flagged.select("track", "market", "has_audio", "has_lyrics_row", "has_both_rows")


@PLANS.add(
    "prj_06_mode_flag",
    f"WITH {S.AUDIO} SELECT track, CASE audio_mode WHEN 'major' THEN 1 ELSE 0 END AS mode FROM audio WHERE audio_mode IS NOT NULL",
)
def mode_flag(spark, sf):
    known = S.audio(spark, sf).where("audio_mode is not null")
    return known.select("track", clean.mode_flag("audio_mode", strict=True).alias("mode"))


@PLANS.add(
    "prj_09_drop_and_fill",
    _w("""SELECT track, market, word_count, CASE WHEN word_count IS NULL THEN chorus_repetition_count ELSE coalesce(chorus_repetition_count, 0) END AS chorus_repetition_count,
    CASE WHEN word_count IS NULL THEN CASE WHEN lower(title) LIKE '%instrumental%' OR lyrics_status = 'not_found' THEN 'missing lyrics'
      ELSE 'all lyric features null' END END AS dropped_for FROM dataset"""),
)
def drop_and_fill(spark, sf):
    kept, dropped = design.drop_and_fill(modeling(spark, sf), design.FeatureSpec())
    kept = integrate.require_no_nulls(kept, ["word_count", "chorus_repetition_count"])
    columns = ["track", "market", "word_count", F.col("chorus_repetition_count").cast("double").alias("chorus_repetition_count")]
    return kept.select(*columns, F.lit(None).cast("string").alias("dropped_for")).unionByName(dropped.select(*columns, F.col("reason").alias("dropped_for")))


def _exclusion_rules():
    return [
        (F.col("lyrics_status") == "not_found", "no vocal lyrics"),
        (F.col("chorus_repetition_count").isNull(), "unmeasurable chorus repetition"),
        (F.col("word_count").isNull(), F.concat(F.lit("no words for language "), F.coalesce("language", F.lit("None")))),
    ]


@PLANS.add(
    "prj_10_exclusion_reasons",
    _w("""SELECT track, market, exclusion_reasons FROM (SELECT track, market, concat_ws('; ',
      CASE WHEN lyrics_status = 'not_found' THEN 'no vocal lyrics' END,
      CASE WHEN chorus_repetition_count IS NULL THEN 'unmeasurable chorus repetition' END,
      CASE WHEN word_count IS NULL THEN 'no words for language ' || coalesce(language, 'None') END) AS exclusion_reasons
    FROM dataset WHERE is_sampled) WHERE exclusion_reasons <> ''"""),
)
def exclusion_reasons(spark, sf):
    sampled = modeling(spark, sf).where("is_sampled")
    return integrate.exclusions(sampled, _exclusion_rules(), ["track", "market"])


@PLANS.add(
    "prj_10_complete_case",
    _w("""SELECT track, market, word_count FROM dataset WHERE track NOT IN
    (SELECT track FROM dataset WHERE chorus_repetition_count IS NULL OR tempo_bpm IS NULL)"""),
)
def complete_case(spark, sf):
    kept = integrate.complete_case(modeling(spark, sf), "track", ["chorus_repetition_count", "tempo_bpm"])
    return kept.select("track", "market", "word_count")


@PLANS.add(
    "jon_01_known_items_only",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10""",
)
def known_items(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = S.table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return line.join(part, "l_partkey")


@PLANS.add(
    "jon_03_left_join_on_predicate",
    f"""WITH {S.AUDIO}, {S.MAPPING} SELECT a.track, a.mapping_id, m.video_id, m.is_selected FROM audio a
    LEFT JOIN mapping m ON m.mapping_id = a.mapping_id AND m.is_selected = TRUE""",
)
def left_join_on_predicate(spark, sf):
    chosen = S.mapping(spark, sf).where("is_selected").select("mapping_id", "video_id", "is_selected")
    return S.audio(spark, sf).select("track", "mapping_id").join(chosen, "mapping_id", "left")


@PLANS.add(
    "jon_04_exists_flag",
    """SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48) AS has_large FROM orders""",
)
def exists_flag(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_orderkey")
    large = S.table(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return integrate.exists_flag(orders, large, ["o_orderkey"], "has_large")


@PLANS.add(
    "jon_05_integrate_sampled",
    _w("""SELECT track, market, round(chart_score, 6) AS chart_score, title, release_year, round(rms_energy, 6) AS rms_energy,
    word_count, lyrics_status FROM dataset WHERE is_sampled"""),
)
def integrate_sampled(spark, sf):
    out = integrate.integrate_sampled(
        S.perf(spark, sf), S.sample(spark, sf), S.songs(spark, sf), S.audio(spark, sf), S.lyric_rows(spark, sf),
        "track", ["track", "market"],
    )
    return out.select(
        "track", "market", F.round("chart_score", 6).alias("chart_score"), "title", "release_year",
        F.round("rms_energy", 6).alias("rms_energy"), "word_count", "lyrics_status",
    )


@PLANS.add(
    "jon_06_features_on_longitudinal_rows",
    f"""WITH {S.SAMPLE}, {S.AUDIO} SELECT s.track, s.market, s.quarter, s.rank_stratum, round(a.tempo_bpm, 6) AS tempo_bpm
    FROM sample s LEFT JOIN audio a ON a.track = s.track""",
)
def longitudinal(spark, sf):
    features = S.audio(spark, sf).select("track", F.round("tempo_bpm", 6).alias("tempo_bpm"))
    return integrate.spread_over_rows(S.sample(spark, sf), features, "track").select(
        "track", "market", "quarter", "rank_stratum", "tempo_bpm"
    )


@PLANS.add(
    "jon_07_feature_tables",
    """SELECT a.track, round(a.q, 6) AS q, round(b.p, 6) AS p, c.n FROM
    (SELECT l_partkey AS track, AVG(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) a
    JOIN (SELECT l_partkey AS track, MAX(l_extendedprice) AS p FROM lineitem GROUP BY 1) b ON a.track = b.track
    JOIN (SELECT l_partkey AS track, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON a.track = c.track""",
)
def feature_tables(spark, sf):
    line = S.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "track")
    a = line.where("l_linenumber <= 3").groupBy("track").agg(F.round(F.avg("l_quantity"), 6).alias("q"))
    b = line.groupBy("track").agg(F.round(F.max("l_extendedprice"), 6).alias("p"))
    c = line.where("l_returnflag = 'R'").groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    return integrate.join_feature_tables([a, b, c], "track")


@PLANS.add(
    "jon_08_scalar_lookup",
    """SELECT o_orderkey, round(o_totalprice - m, 4) AS deviation FROM orders
    JOIN (SELECT o_orderstatus AS s, AVG(o_totalprice) AS m FROM orders GROUP BY 1) ON s = o_orderstatus""",
)
def scalar_lookup(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    means = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    return orders.join(means, "o_orderstatus").select(
        "o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 4).alias("deviation")
    )


@PLANS.add(
    "jon_09_reconcile",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v,
          CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_second' WHEN b.k IS NULL THEN 'only_first' ELSE 'both' END AS side,
    CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN abs(a.v - b.v) > 1e-9 THEN 'v' END,
      CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END) END AS different FROM a FULL JOIN b ON a.k = b.k""",
)
def reconcile(spark, sf):
    o = S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s")
    )
    b = o.where("k % 11 <> 0").select(
        "k", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("v"),
        F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")).alias("s"),
    )
    out = quality.reconcile(o.where("k % 10 <> 0"), b, ["k"], ["v", "s"])
    return out.withColumn("different", F.array_join("different", ","))


@PLANS.add(
    "jon_10_checked_join",
    """SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def checked_join(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return quality.checked_join(orders, customer, ["c_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@PLANS.add(
    "jon_11_orphans",
    f"""WITH {S.AUDIO} SELECT DISTINCT l_partkey AS track FROM lineitem WHERE l_partkey NOT IN (SELECT track FROM audio)""",
)
def orphans(spark, sf):
    child = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("track"))
    return quality.orphan_keys(child, S.audio(spark, sf), ["track"])


@PLANS.add(
    "jon_11_progress",
    f"""WITH {S.AUDIO} SELECT COUNT(*) AS n_keys, COUNT(a.track) AS n_matched, round(100.0 * COUNT(a.track) / COUNT(*), 4) AS progress_pct
    FROM (SELECT DISTINCT l_partkey AS track FROM lineitem) l LEFT JOIN audio a ON a.track = l.track""",
)
def progress(spark, sf):
    child = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("track"))
    return quality.reference_progress(child, S.audio(spark, sf), ["track"])


@PLANS.add(
    "jon_12_curated_list",
    _w("""SELECT d.track, d.market, c.position, round(d.chart_score, 6) AS chart_score, d.title FROM dataset d
    JOIN (SELECT p_partkey AS track, p_size AS position FROM part WHERE p_brand = 'Brand#7') c ON c.track = d.track
    WHERE d.has_audio"""),
)
def curated_list(spark, sf):
    listed = S.table(spark, sf, "part").where("p_brand = 'Brand#7'").select(
        F.col("p_partkey").alias("track"), F.col("p_size").alias("position")
    )
    rows = modeling(spark, sf).where("has_audio").select("track", "market", F.round("chart_score", 6).alias("chart_score"), "title")
    return rows.join(listed, "track").orderBy("position", "track", "market")


@PLANS.add(
    "jon_13_top_with_metadata",
    f"""WITH {S.PERF}, {S.SONGS}, top AS (SELECT track, market, weeks_on_chart FROM perf ORDER BY weeks_on_chart DESC, track, market LIMIT 20)
    SELECT t.track, t.market, t.weeks_on_chart, s.title, s.artist FROM top t LEFT JOIN songs s ON s.track = t.track""",
)
def top_with_metadata(spark, sf):
    top = S.perf(spark, sf).select("track", "market", "weeks_on_chart").orderBy(F.desc("weeks_on_chart"), "track", "market").limit(20)
    # twenty rows by construction: they cut the songs down first
    songs = S.songs(spark, sf).select("track", "title", "artist").join(F.broadcast(top.select("track").distinct()), "track", "left_semi")
    return top.join(songs, "track", "left")


@PLANS.add(
    "jon_15_expand_provenance",
    f"""WITH {S.SAMPLE}, packed AS (SELECT track, string_agg(DISTINCT market, ';' ORDER BY market) AS markets FROM sample GROUP BY 1)
    SELECT track, unnest(string_split(markets, ';')) AS market FROM packed""",
)
def expand_provenance(spark, sf):
    from chartspark.sources import readers

    packed = S.sample(spark, sf).groupBy("track").agg(F.array_join(F.array_sort(F.collect_set("market")), ";").alias("markets"))
    return readers.split_membership(packed, "markets", "market")


@PLANS.add(
    "jon_16_layered_defaults",
    """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
    g AS (SELECT event_type, quantile_cont(v, 0.5) AS m FROM e WHERE event_type <> 'error' GROUP BY 1),
    t AS (SELECT quantile_cont(v, 0.5) AS m FROM e)
    SELECT event_id, round(coalesce(v, g.m, t.m, 0), 6) AS filled,
      CASE WHEN v IS NOT NULL THEN 'own' WHEN g.m IS NOT NULL THEN 'market median' WHEN t.m IS NOT NULL THEN 'train median'
      ELSE 'default' END AS source FROM e LEFT JOIN g ON g.event_type = e.event_type, t""",
)
def layered_defaults(spark, sf):
    e = S.table(spark, sf, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v")
    )
    by_type = order.exact_quantiles(e.where("event_type <> 'error'"), ["event_type"], "v", [0.5], ["gm"])
    overall = order.exact_quantiles(e, [], "v", [0.5], ["tm"]).withColumn("_one", F.lit(1))
    joined = e.join(by_type, "event_type", "left").withColumn("_one", F.lit(1)).join(F.broadcast(overall), "_one")
    value, source = integrate.layered_fill(
        F.col("v"), [(F.col("gm"), "market median"), (F.col("tm"), "train median")], "own", 0.0, "default"
    )
    return joined.select("event_id", F.round(value, 6).alias("filled"), source.alias("source"))


_BANDS = """bands AS (SELECT event_type AS market, MIN(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.78) AS p78, quantile_cont(value, 0.9) AS p90, MAX(value) AS max
  FROM events GROUP BY 1)"""
_PCT = """CASE WHEN s <= min THEN 1.0 WHEN s >= max THEN 99.0
  WHEN s < q1 THEN 1 + (s - min) / (q1 - min) * 24 WHEN s < median THEN 25 + (s - q1) / (median - q1) * 25
  WHEN s < q3 THEN 50 + (s - median) / (q3 - median) * 25 WHEN s < p90 THEN 75 + (s - q3) / (p90 - q3) * 15
  ELSE 90 + (s - p90) / (max - p90) * 9 END"""


@PLANS.add(
    "jon_17_percentile_in_bands",
    f"""WITH {_BANDS} SELECT event_id, round({_PCT}, 4) AS percentile,
    s >= p78 AS is_top22, CASE WHEN s >= q3 THEN 'Tier 1' WHEN s >= median THEN 'Tier 2' WHEN s >= q1 THEN 'Tier 3' ELSE 'Tier 4' END AS tier
    FROM (SELECT event_id, event_type, value * 1.1 - 2 AS s FROM events) e JOIN bands b ON b.market = e.event_type""",
)
def percentile_in_bands(spark, sf):
    events = S.table(spark, sf, "events")
    bands = score.quantile_bands(events, "event_type", "value").drop("n", "mean", "std")
    scored = events.select("event_id", "event_type", (F.col("value") * 1.1 - 2).alias("s"))
    joined = scored.join(bands, "event_type")
    return joined.select(
        "event_id", F.round(score.interpolated_percentile(F.col("s"), digits=None), 4).alias("percentile"),
        (F.col("s") >= F.col("p78")).alias("is_top22"), score.fit_tier(F.col("s")).alias("tier"),
    )


# ---- sinks as lazy plans ---------------------------------------------------------------------------

_UPSERT = """existing AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
updates AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS v
  FROM orders WHERE o_orderkey % 5 = 0)"""


def _upsert_sides(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    updates = o.where("k % 5 = 0").select("k", F.when(F.col("k") % 2 == 0, F.col("v")).otherwise(-F.col("v")).alias("v"))
    return o.where("k % 3 <> 0"), updates


@PLANS.add(
    "snk_01_upsert",
    f"WITH {_UPSERT} SELECT k, v FROM existing WHERE k NOT IN (SELECT k FROM updates) UNION ALL SELECT k, v FROM updates",
)
def upsert(spark, sf):
    return integrate.upsert(*_upsert_sides(spark, sf), ["k"])


@PLANS.add(
    "snk_02_upsert_counts",
    f"""WITH {_UPSERT} SELECT COUNT(*) FILTER (WHERE e.k IS NULL) AS inserted,
    COUNT(*) FILTER (WHERE e.k IS NOT NULL AND u.k IS NOT NULL AND abs(e.v - u.v) > 1e-9) AS updated,
    COUNT(*) FILTER (WHERE e.k IS NOT NULL AND u.k IS NOT NULL AND abs(e.v - u.v) <= 1e-9) AS unchanged,
    COUNT(*) FILTER (WHERE u.k IS NULL) AS untouched FROM existing e FULL JOIN updates u ON e.k = u.k""",
)
def upsert_counts(spark, sf):
    existing, updates = _upsert_sides(spark, sf)
    return integrate.upsert_counts(existing, updates, ["k"], ["v"])


@PLANS.add(
    "snk_06_replace_keys",
    """SELECT l_orderkey, l_partkey, CAST(NULL AS VARCHAR) AS note FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 7)
    UNION ALL SELECT -1, p_partkey, 'patched' FROM part WHERE p_size = 7
    UNION ALL SELECT -2, p_partkey, 'patched' FROM part WHERE p_size = 7""",
)
def replace_keys(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.lit(None).cast("string").alias("note"))
    part = S.table(spark, sf, "part").where("p_size = 7")
    patch = part.select(
        F.explode(F.array(F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"))).alias("l_orderkey"),
        F.col("p_partkey").alias("l_partkey"), F.lit("patched").alias("note"),
    )
    return integrate.replace_keys(line, patch, ["l_partkey"])


@PLANS.add(
    "inc_01_skip_processed",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def skip_processed(spark, sf):
    done = S.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@PLANS.add(
    "inc_03_retry_and_merge",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'retried' ELSE o_orderstatus END AS status FROM orders""",
)
def retry_and_merge(spark, sf):
    state = S.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    retried = state.where("status = 'P'").select("o_orderkey", F.lit("retried").alias("status"))
    return integrate.upsert(state, retried, ["o_orderkey"])
