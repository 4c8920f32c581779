"""Matching queries: candidates made from neighbouring parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions import titles as M
from chartspark.operators import matching
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook

PLANS = PlanBook()

FORMS = [" (Official Audio)", " [MV]", " (Live at the Dome)", " (Remix)", " Karaoke", " (Official Music Video)", ""]


def candidates(spark, sf):
    """Five candidates per part: itself and the four parts after it, dressed as video titles."""
    part = S.table(spark, sf, "part").select(
        "p_partkey", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" No ")).alias("p_brand"), "p_retailprice"
    )
    songs = part.select(
        F.col("p_partkey").alias("track"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        (F.col("p_retailprice") * 200).cast("bigint").alias("duration_ms"),
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("candidate_number"),
    )
    other = part.select(
        F.col("p_partkey").alias("video"), F.col("p_name").alias("v_name"), F.col("p_brand").alias("v_brand"), F.col("p_retailprice").alias("v_price")
    )
    # few bytes, heavy work a row: as many tasks as the session shuffles into. Sizes guessed from the file's bytes know nothing
    # of the five rows a part, so neither side is left to a broadcast
    songs = scale.spread_for_cpu(songs.withColumn("video", F.col("track") + F.col("candidate_number") - 1), "video")
    pairs = songs.join(scale.spread_for_cpu(other, "video").hint("merge"), "video")
    c, v = F.col("candidate_number"), F.col("video")
    form = (v + c) % len(FORMS)
    dressed = F.lit(FORMS[-1])
    for i, text in enumerate(FORMS[:-1]):
        dressed = F.when(form == i, F.lit(text)).otherwise(dressed)
    channel = F.when(v % 3 == 0, F.concat("v_brand", F.lit(" - Topic"))).when(v % 3 == 1, F.concat("v_brand", F.lit(" lyrics fan"))).otherwise(F.col("v_brand"))
    prefix = F.when(v % 2 == 0, F.concat("v_brand", F.lit(" - "))).otherwise(F.lit(""))
    return pairs.select(
        "track", "candidate_number", "title", "artist", "duration_ms", F.concat(F.lit("v"), v.cast("string")).alias("video_id"),
        F.concat(prefix, "v_name", dressed).alias("video_title"), channel.alias("channel"),
        (F.col("v_price") / 5 + (c - 1) * 7.0).alias("video_seconds"),
    )


_FORM = "CASE (b.p_partkey + c) % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FORMS)) + " END"
CANDIDATES = f"""named AS (SELECT * REPLACE (replace(p_brand, '#', ' No ') AS p_brand) FROM part),
candidates AS (
  SELECT a.p_partkey AS track, CAST(c AS INTEGER) AS candidate_number, a.p_name AS title, a.p_brand AS artist,
    CAST(floor(a.p_retailprice * 200) AS BIGINT) AS duration_ms, 'v' || b.p_partkey AS video_id,
    CASE WHEN b.p_partkey % 2 = 0 THEN b.p_brand || ' - ' ELSE '' END || b.p_name || {_FORM} AS video_title,
    CASE b.p_partkey % 3 WHEN 0 THEN b.p_brand || ' - Topic' WHEN 1 THEN b.p_brand || ' lyrics fan' ELSE b.p_brand END AS channel,
    b.p_retailprice / 5 + (c - 1) * 7.0 AS video_seconds
  FROM named a CROSS JOIN range(1, 6) r(c) JOIN named b ON b.p_partkey = a.p_partkey + c - 1)"""


def _sql_norm(x: str) -> str:
    steps = [
        "#\\S+", r"\bofficial\s+music\s+video\b", r"\bofficial\s+video\b", r"\bofficial\s+audio\b", r"\bofficial\s+lyric\s+video\b",
        r"\bofficial\s+m\s*/?\s*v\b", r"\blyric\s+video\b", r"\blyrics?\b", r"\baudio\b", r"\bvisualizer\b", r"\bm\s*/\s*v\b", r"\bmv\b",
        r"\bmusic\s+video\b", r"\bhq\b", r"\b4k\b", r"\bfull\s+hd\b", r"\bhd\b",
    ]
    for step in steps:
        x = f"regexp_replace({x}, '(?i){step}', ' ', 'g')"
    x = rf"regexp_replace(lower({x}), '[^\w\s]', ' ', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


@PLANS.add(
    "mat_05_normalized_titles",
    f"WITH {CANDIDATES} SELECT track, candidate_number, {_sql_norm('video_title')} AS normalized FROM candidates",
)
def normalized_titles(spark, sf):
    rows = candidates(spark, sf).select("track", "candidate_number", "video_title")
    return rows.select("track", "candidate_number", M.normalize_title(F.col("video_title")).alias("normalized"))


@PLANS.add(
    "mat_05_core_titles",
    f"""WITH {CANDIDATES}, s AS (SELECT track, candidate_number,
      regexp_replace(CASE WHEN starts_with(video_title, artist || ' - ') THEN substr(video_title, length(artist) + 4) ELSE video_title END,
        '(?i)\\((?:remix|live at the dome)\\)', ' ', 'g') AS t FROM candidates)
    SELECT track, candidate_number, {_sql_norm('t')} AS core FROM s""",
)
def core_titles(spark, sf):
    rows = candidates(spark, sf).sortWithinPartitions("artist")
    return rows.select("track", "candidate_number", M.core_title(F.col("video_title"), F.col("artist")).alias("core"))


@PLANS.add(
    "mat_06_version_tags",
    f"""WITH {CANDIDATES} SELECT track, candidate_number, concat_ws(',', CASE WHEN contains(video_title, 'Remix') THEN 'remix' END,
    CASE WHEN contains(video_title, 'Live') THEN 'live' END) AS tags FROM candidates""",
)
def version_tags(spark, sf):
    rows = candidates(spark, sf).select("track", "candidate_number", "video_title")
    return rows.select("track", "candidate_number", F.array_join(M.version_tags(F.col("video_title")), ",").alias("tags"))


@PLANS.add(
    "mat_08_version_conflict",
    f"""WITH {CANDIDATES} SELECT track, candidate_number, contains(video_title, 'Remix') OR contains(video_title, 'Live') AS version_conflict FROM candidates""",
)
def version_conflict(spark, sf):
    rows = M.with_version_conflict(candidates(spark, sf).sortWithinPartitions("artist"), "title", "video_title", "artist")
    return rows.select("track", "candidate_number", "version_conflict")


@PLANS.add(
    "mat_15_duration_ratio",
    f"""WITH {CANDIDATES} SELECT track, candidate_number, CASE WHEN duration_ms > 0 AND floor(video_seconds * 1000) > 0 THEN
    round(abs(duration_ms - CAST(floor(video_seconds * 1000) AS BIGINT)) / duration_ms, 9) END AS ratio FROM candidates""",
)
def duration_ratio(spark, sf):
    rows = candidates(spark, sf)
    return rows.select("track", "candidate_number", F.round(M.duration_ratio(F.col("duration_ms"), F.col("video_seconds")), 9).alias("ratio"))


@PLANS.add(
    "mat_16_hard_invalid",
    f"""WITH {CANDIDATES} SELECT track, candidate_number, regexp_matches(lower(video_title), '\\b(cover|karaoke)\\b') AS hard_invalid FROM candidates""",
)
def hard_invalid(spark, sf):
    rows = candidates(spark, sf)
    return rows.select("track", "candidate_number", M.is_hard_invalid_source(F.col("video_title")).alias("hard_invalid"))


@PLANS.add(
    "mat_14_source_evidence",
    f"""WITH {CANDIDATES}, f AS (SELECT *, contains(channel, 'Topic') AS topic, contains(channel, 'fan') AS fan,
      contains(replace(replace(lower(channel), ' ', ''), '-', ''), replace(lower(artist), ' ', '')) AS exact FROM candidates),
    g AS (SELECT *, NOT fan AND (topic OR exact) AS verified FROM f)
    SELECT track, candidate_number, concat_ws(',', CASE WHEN topic THEN 'topic_channel' END,
      CASE WHEN contains(video_title, 'Official Music Video') THEN CASE WHEN verified THEN 'official_music_video' ELSE 'music_video' END
           WHEN contains(video_title, 'Official Audio') THEN CASE WHEN verified THEN 'official_audio' ELSE 'lyrics' END
           WHEN contains(video_title, '[MV]') THEN 'music_video' END) AS sources FROM g""",
)
def source_evidence(spark, sf):
    rows = evaluated(spark, sf)
    return rows.select("track", "candidate_number", F.array_join("source_evidence", ",").alias("sources"))


def evaluated(spark, sf):
    return matching.evaluate_candidates(candidates(spark, sf), "track")


@PLANS.add("mat_17_candidate_evidence")
def candidate_evidence(spark, sf):
    return evaluated(spark, sf).drop("title", "artist")


@PLANS.add("mat_11_title_similarity")
def title_similarity(spark, sf):
    return evaluated(spark, sf).select("track", "candidate_number", "title_similarity", "title_conflict", "version_conflict")


@PLANS.add("mat_12_artist_similarity")
def artist_similarity(spark, sf):
    pairs = candidates(spark, sf).select("artist", "channel").distinct()
    a, c = M.normalize_title(F.col("artist")), M.normalize_title(F.col("channel"))
    both = pairs.select("artist", "channel", a.alias("a"), c.alias("c"))
    use = lambda x: F.when((F.col("a") != "") & (F.col("c") != ""), F.array(x))
    return both.select(
        "artist", "channel", M.best_ratio(use("a"), use("c")).alias("similarity"), M.artist_in_text(F.col("a"), F.col("c")).alias("contained")
    )


@PLANS.add("mat_19_decision_on_titles")
def decision_on_titles(spark, sf):
    rows = evaluated(spark, sf)
    return matching.decide_matches(rows, "track", "candidate_number", ["candidate_number", "video_id"], items=S.songs(spark, sf))


# ---- decisions on given evidence -------------------------------------------------------------------

def evidence(spark, sf):
    """Line items as candidates of their order, with evidence columns taken from their numbers."""
    line = scale.pieces_of(S.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount"), "l_orderkey")
    none = F.array().cast("array<string>")
    # one row per (order, part): the table repeats line numbers
    return line.groupBy(F.col("l_orderkey").alias("song"), F.col("l_partkey").alias("number")).agg(
        F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount")
    ).select(
        "song", "number", (70 + (F.col("l_quantity") % 7) * 5).alias("title_similarity"),
        F.when(F.col("number") % 3 == 0, F.array(F.lit("exact_channel_artist")))
        .when(F.col("number") % 3 == 1, F.array(F.lit("artist_in_title"))).otherwise(none).alias("identity_evidence"),
        F.when(F.col("number") % 4 == 0, F.array(F.lit("official_audio")))
        .when(F.col("number") % 4 == 1, F.array(F.lit("lyrics"))).otherwise(none).alias("source_evidence"),
        F.when(F.col("number") % 10 != 0, F.round("l_discount", 2) * 5).alias("duration_difference_ratio"),
        (F.col("number") % 13 == 0).alias("title_conflict"), (F.col("number") % 17 == 0).alias("version_conflict"),
        (F.col("number") % 19 == 0).alias("hard_invalid"),
        F.when(F.col("number") % 5 != 0, F.concat(F.lit("c"), (F.col("number") % 2).cast("string"))).alias("channel"),
    )


EVIDENCE = """evidence AS (SELECT l_orderkey AS song, l_partkey AS number, 70 + (MAX(l_quantity) % 7) * 5 AS sim,
    CASE l_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS id, CASE l_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END AS src,
    CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS n_src,
    CASE WHEN l_partkey % 10 <> 0 THEN round(MAX(l_discount), 2) * 5 ELSE 'inf'::DOUBLE END AS dur,
    l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AS ok,
    CASE WHEN l_partkey % 5 <> 0 THEN 'c' || (l_partkey % 2) ELSE '' END AS channel, l_partkey % 4 = 0 OR l_partkey % 3 = 0 AS official
  FROM lineitem GROUP BY 1, 2)"""


@PLANS.add(
    "mat_18_confident_candidates",
    f"""WITH {EVIDENCE} SELECT song, number, ok AND dur <= 0.30 AND ((sim >= 90 AND (id >= 1 OR src >= 1 OR dur <= 0.15)) OR (id = 2 AND sim >= 80 AND dur <= 0.15)
      OR (sim >= 80 AND (src >= 2 OR (id >= 1 AND dur <= 0.10)))) AS sure_loose,
    ok AND official AND dur <= 0.28 AND ((sim >= 85 AND dur <= 0.15) OR (id = 2 AND sim >= 80 AND dur <= 0.15) OR (sim >= 90 AND src >= 2 AND dur <= 0.25)) AS sure
    FROM evidence""",
)
def confident_candidates(spark, sf):
    rated = matching.with_priorities(evidence(spark, sf))
    ok = ~matching.invalid_candidate()
    return rated.select(
        "song", "number", (ok & matching.confident_candidate(False)).alias("sure_loose"), (ok & matching.confident_candidate(True)).alias("sure")
    )


@PLANS.add(
    "mat_19_decision",
    f"""WITH {EVIDENCE}, r AS (SELECT *, ok AND official AND dur <= 0.28 AND ((sim >= 85 AND dur <= 0.15) OR (id = 2 AND sim >= 80 AND dur <= 0.15)
        OR (sim >= 90 AND src >= 2 AND dur <= 0.25)) AS sure,
      ok AND sim >= 85 AND (id >= 1 OR src >= 2) AND ((official AND dur <= 0.45) OR (NOT official AND dur <= 0.10)) AS edge FROM evidence),
    k AS (SELECT *, rank() OVER (PARTITION BY song, sure ORDER BY sim DESC, CAST(dur <= 0.15 AS INTEGER) DESC, id DESC, src DESC, dur ASC) AS place FROM r),
    t AS (SELECT song, COUNT(*) AS n, MIN(number) AS number, MIN(channel) AS c1, MAX(channel) AS c2, MIN(id) AS id, MIN(dur) AS dur FROM k WHERE sure AND place = 1 GROUP BY 1),
    s AS (SELECT r.song, bool_or(edge) AS edge FROM r GROUP BY 1),
    d AS (SELECT s.song, t.number, CASE WHEN t.song IS NOT NULL AND (t.n = 1 OR (t.id = 2 AND t.c1 <> '' AND t.c1 = t.c2 AND t.dur <= 0.01)) THEN 'automatic'
      WHEN t.song IS NOT NULL OR s.edge THEN 'ambiguous' ELSE 'no_confident_match' END AS status FROM s LEFT JOIN t ON t.song = s.song)
    SELECT song, status, CASE WHEN status = 'automatic' THEN number END AS selected_number FROM d""",
)
def decision(spark, sf):
    return matching.decide_matches(evidence(spark, sf), "song", "number", ["number"])


@PLANS.add(
    "mat_20_dominance_order",
    f"""WITH {EVIDENCE}, c AS (SELECT b.song, b.number, COUNT(a.number) AS dominated_by FROM evidence b LEFT JOIN evidence a ON a.song = b.song
      AND a.sim >= b.sim AND a.id >= b.id AND a.n_src >= b.n_src AND a.dur <= b.dur
      AND (a.sim > b.sim OR a.id > b.id OR a.n_src > b.n_src OR a.dur < b.dur) GROUP BY 1, 2)
    SELECT song, number, dominated_by, row_number() OVER (PARTITION BY song ORDER BY dominated_by, number) AS evidence_order FROM c""",
)
def dominance(spark, sf):
    rows = evidence(spark, sf)
    out = matching.dominance_order(rows, "song", "number")
    return out.select(
        "song", "number", F.col("dominated_by").cast("bigint").alias("dominated_by"), F.col("evidence_order").cast("bigint").alias("evidence_order")
    )


@PLANS.add(
    "mat_21_mapping_records",
    f"""WITH {CANDIDATES}, s AS (SELECT p_partkey AS track, CASE WHEN p_size % 4 = 0 THEN p_size % 5 + 1 END AS num,
      CASE WHEN p_size % 3 <> 0 THEN 'v' || (p_partkey + p_size % 2) END AS vid, CASE WHEN p_size % 2 = 0 THEN 'automatic' ELSE 'reviewed' END AS st FROM part),
    j AS (SELECT c.track, c.candidate_number, coalesce(CASE WHEN num IS NOT NULL THEN candidate_number = num ELSE vid IS NOT NULL AND video_id = vid END, FALSE) AS is_selected, vid, st
      FROM candidates c JOIN s ON s.track = c.track)
    SELECT track, candidate_number, is_selected, CASE WHEN is_selected THEN 'success' WHEN vid IS NULL THEN 'not_found' ELSE 'rejected' END AS status,
    CASE WHEN st = 'automatic' THEN 'automatic' WHEN vid IS NOT NULL THEN 'manual_selected' ELSE 'no_confident_match' END AS decision_status,
    CASE WHEN is_selected AND st <> 'automatic' AND vid IS NOT NULL THEN 'manual_review' ELSE 'youtube_search' END AS match_method FROM j""",
)
def mapping_records(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    selections = S.table(spark, sf, "part").select(
        key.alias("track"), F.when(size % 4 == 0, size % 5 + 1).alias("selected_candidate_number"),
        F.when(size % 3 != 0, F.concat(F.lit("v"), (key + size % 2).cast("string"))).alias("selected_video_id"),
        F.when(size % 2 == 0, "automatic").otherwise("reviewed").alias("match_status"),
    )
    rows = candidates(spark, sf).select("track", "candidate_number", "video_id")
    return matching.mapping_records(rows, selections, "track").drop("video_id")


@PLANS.add(
    "agg_27_keyword_cohorts",
    f"""WITH {CANDIDATES}, k AS (SELECT * FROM (VALUES ('karaoke'), ('live'), ('remix'), ('cover')) v(keyword))
    SELECT keyword, COUNT(c.track) AS total_candidates, COUNT(DISTINCT CASE WHEN c.track % 2 = 0 THEN video_id END) AS selected,
    COUNT(c.track) - COUNT(DISTINCT CASE WHEN c.track % 2 = 0 THEN video_id END) AS rejected,
    CASE WHEN COUNT(c.track) > 0 THEN round((COUNT(c.track) - COUNT(DISTINCT CASE WHEN c.track % 2 = 0 THEN video_id END)) * 100.0 / COUNT(c.track), 6) ELSE 100 END AS rejection_rate
    FROM k LEFT JOIN candidates c ON contains(lower(video_title), keyword) GROUP BY 1""",
)
def keyword_cohorts(spark, sf):
    rows = candidates(spark, sf).withColumn("chosen", F.col("track") % 2 == 0)
    return matching.keyword_cohorts(rows, "video_title", "video_id", "chosen", ["karaoke", "live", "remix", "cover"])


@PLANS.add(
    "agg_28_threshold_coverage",
    """SELECT COUNT(*) AS n, round(AVG(CAST(l_discount <= 0.015 AS INTEGER)), 9) AS share_le_0015, round(AVG(CAST(l_discount <= 0.05 AS INTEGER)), 9) AS share_le_005
    FROM lineitem""",
)
def threshold_coverage(spark, sf):
    out = matching.threshold_coverage(S.table(spark, sf, "lineitem"), "l_discount", [0.015, 0.05])
    return out.select(
        "n", F.round(F.col("`share_le_0.015`"), 9).alias("share_le_0015"), F.round(F.col("`share_le_0.05`"), 9).alias("share_le_005")
    )


@PLANS.add(
    "prj_19_candidate_rows",
    """SELECT l_orderkey AS song, l_partkey AS number, CASE l_partkey % 3 WHEN 0 THEN '["exact_channel_artist"]' WHEN 1 THEN '["artist_in_title"]' ELSE '[]' END AS identity_json
    FROM lineitem GROUP BY 1, 2, 3""",
)
def candidate_rows(spark, sf):
    return evidence(spark, sf).select("song", "number", F.to_json("identity_evidence").alias("identity_json"))


@PLANS.add(
    "top_02_best_per_group",
    f"""WITH {EVIDENCE} SELECT song, number, sim FROM (SELECT *, row_number() OVER (PARTITION BY song
      ORDER BY sim DESC, CAST(dur <= 0.15 AS INTEGER) DESC, id DESC, src DESC, dur ASC, number ASC) AS p FROM evidence) WHERE p = 1""",
)
def best_per_group(spark, sf):
    rated = matching.with_priorities(evidence(spark, sf))
    order = F.struct("_sim", (F.col("_dur") <= 0.15).cast("int"), "_id", "_src", -F.col("_dur"), -F.col("number"))
    best = rated.groupBy("song").agg(F.max_by(F.struct("number", "_sim"), order).alias("b"))
    return best.select("song", F.col("b.number").alias("number"), F.col("b._sim").alias("sim"))
