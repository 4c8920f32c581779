"""Candidate matching: evidence per candidate, decision per item, dominance order, mapping records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions import titles as M

ARTIST_PIECES = 16
FAR = float("inf")


def evaluate_candidates(
    df: DataFrame, key: str, title: str = "title", artist: str = "artist", duration_ms: str = "duration_ms",
    offered_title: str = "video_title", channel: str = "channel", offered_seconds: str = "video_seconds", aliases: bool = True,
) -> DataFrame:
    """Adds similarity, conflicts, identity and source evidence, duration ratio and hard-invalid flag.

    Similarity depends only on the texts, so it is computed once per distinct (title, artist, offered title) and joined
    back. Aliases are gathered over all candidates of an item.
    """
    t, a, v = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(artist), F.lit("")), F.coalesce(F.col(offered_title), F.lit(""))
    none = F.array().cast("array<string>")
    rows = df
    if aliases:
        named = alias_lists(df.select(key, t.alias("_t")), alias_table(df, key, v, a), key, "_t")
        rows = rows.join(named, key, "left").withColumn("_aliases", F.coalesce("_aliases", none))
    else:
        rows = rows.withColumn("_aliases", none)
    texts = rows.select(t.alias("_t"), a.alias("_a"), v.alias("_v"), "_aliases")
    # rows of one artist follow each other, so its patterns are compiled once; the salt spreads an artist with many rows
    texts = scale.salted_keys(texts.distinct(), "_salt", ARTIST_PIECES, "_v")
    texts = scale.spread_for_cpu(texts, "_a", "_salt").sortWithinPartitions("_a").drop("_salt")
    scored = title_scores(texts)
    joined = rows.withColumn("_t", t).withColumn("_a", a).withColumn("_v", v).join(scored, ["_t", "_a", "_v", "_aliases"], "left")
    normal = joined.withColumn("_an", M.normalize_title(F.col("_a"))).withColumn("_vn", M.normalize_title(F.col("_v")))
    c = F.coalesce(F.col(channel), F.lit(""))
    normal = normal.withColumn("_cn", M.normalize_title(c)).withColumn("_cc", M.channel_artist(c))
    identity = M.identity_evidence(F.col("_an"), F.col("_vn"), c, F.col("_cn"), F.col("_cc"))
    found = normal.withColumn("identity_evidence", identity)
    found = found.withColumn("source_evidence", M.source_evidence(F.col("_v"), c, F.col("_a") != "", F.col("identity_evidence")))
    return (
        found.withColumn("duration_difference_ratio", M.duration_ratio(F.col(duration_ms), F.col(offered_seconds)))
        .withColumn("hard_invalid", M.is_hard_invalid_source(F.col("_v")))
        .drop("_t", "_a", "_v", "_an", "_vn", "_cn", "_cc", "_aliases")
    )


def alias_table(df: DataFrame, key: str, offered: Column, artist: Column) -> DataFrame:
    """Two-sided table of the names written in two scripts in any candidate title of an item: (key, form, other), distinct.

    Every pair 'Hangul (Latin)' or 'Latin (Hangul)' stands in it twice, once per side, normalised; titles without both need
    no parsing. A NULL title or artist counts as empty.
    """
    offered, artist = F.coalesce(offered, F.lit("")), F.coalesce(artist, F.lit(""))
    paired = M.with_script_pairs(df.where(offered.rlike("[가-힣]") & offered.contains("(")), offered, artist, "_pairs")
    sides = paired.select(key, F.explode("_pairs").alias("_p")).select(key, F.explode(F.array(
        F.struct(F.col("_p.a").alias("form"), F.col("_p.b").alias("other")), F.struct(F.col("_p.b").alias("form"), F.col("_p.a").alias("other"))
    )).alias("_s"))
    return sides.select(key, "_s.form", "_s.other").distinct()


def alias_lists(items: DataFrame, table: DataFrame, key: str, title: str) -> DataFrame:
    """Sorted other names of each item's title, joined by the normalised title; items without an alias are left out.

    The list of an item holds distinct names only; it is as long as there are spellings of its title among its candidates.
    """
    wanted = items.select(key, title).distinct().select(key, M.normalize_title(F.col(title)).alias("form")).distinct()
    # as many rows as items and names: never a table for the driver, however few bytes the files have
    return wanted.join(table.hint("merge"), [key, "form"]).groupBy(key).agg(F.array_sort(F.collect_set("other")).alias("_aliases"))


def title_scores(texts: DataFrame) -> DataFrame:
    """Similarity, title conflict and version conflict of distinct (_t, _a, _v, _aliases) rows."""
    t, a, v = F.col("_t"), F.col("_a"), F.col("_v")
    base = M.with_version_conflict(texts, "_t", "_v", "_a")
    base = (
        base.withColumn("_wanted", M.normalize_title(t))
        .withColumn("_offered", M.normalize_title(v, a))
        .withColumn("_plain0", M.without_feature_credits(t))
        .withColumn("_plain", M.normalize_title(F.col("_plain0")))
        .withColumn("_mine", F.array_distinct(M.tokens(M.normalize_title(F.col("_plain0"), a))))
        .withColumn("_theirs", F.array_distinct(M.tokens(F.col("_offered"))))
        .withColumn("_alias_words", F.transform("_aliases", lambda x: M.tokens(M.normalize_title(x))))
    )
    base = base.withColumn("_clash", M.clash_words(F.col("_mine"), F.col("_theirs"), F.col("_alias_words")))
    base = M.with_title_variants(base, "_v", "_a", "_t", "version_conflict", "_variants")
    other = F.filter(F.transform("_aliases", lambda x: M.normalize_title(x)), lambda x: x != "")
    targets = F.array_distinct(F.concat(F.array("_wanted"), F.filter(F.array("_plain"), lambda x: x != ""), other))
    present = (F.col("_wanted") != "") & (F.col("_offered") != "")
    use_t = F.when(present, F.when(F.col("version_conflict"), F.array("_wanted")).otherwise(targets))
    use_v = F.when(present, F.when(F.col("version_conflict"), F.array("_offered")).otherwise(F.concat(F.array("_offered"), "_variants")))
    pairs = base.withColumn("_ts", use_t).withColumn("_vs", use_v).withColumn("_best", M.best_ratio("_ts", "_vs"))
    capped = F.when(F.col("version_conflict"), F.least("_best", F.lit(75.0))).otherwise(F.col("_best"))
    return pairs.select(
        "_t", "_a", "_v", "_aliases", capped.alias("title_similarity"), (F.size("_clash") > 0).alias("title_conflict"),
        F.col("version_conflict"),
    )


# ---- decision --------------------------------------------------------------------------------------

def with_priorities(df: DataFrame) -> DataFrame:
    """Numeric evidence used by the rules: missing similarity is -1, missing duration is infinite."""
    none = F.array().cast("array<string>")
    identity, source = F.coalesce("identity_evidence", none), F.coalesce("source_evidence", none)
    return df.select(
        "*",
        F.coalesce(F.col("title_similarity").cast("double"), F.lit(-1.0)).alias("_sim"),
        F.coalesce(F.col("duration_difference_ratio").cast("double"), F.lit(FAR)).alias("_dur"),
        M.identity_priority(identity).alias("_id"),
        M.source_priority(source).alias("_src"),
        M.has_official_source(source).alias("_off"),
    )


def invalid_candidate() -> Column:
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("hard_invalid", "title_conflict", "version_conflict")]
    return flags[0] | flags[1] | flags[2]


def confident_candidate(with_channel: bool) -> Column:
    """Automatic acceptance rules. Without channel information a looser rule set applies."""
    sim, dur, ident, src = F.col("_sim"), F.col("_dur"), F.col("_id"), F.col("_src")
    if with_channel:
        close = (sim >= 85) & (dur <= 0.15)
        exact = (ident == 2) & (sim >= 80) & (dur <= 0.15)
        strong = (sim >= 90) & (src >= 2) & (dur <= 0.25)
        return ((ident == 2) | F.col("_off")) & (dur <= 0.28) & (close | exact | strong)
    near = (sim >= 90) & ((ident >= 1) | (src >= 1) | (dur <= 0.15))
    exact = (ident == 2) & (sim >= 80) & (dur <= 0.15)
    backed = (sim >= 80) & ((src >= 2) | ((ident >= 1) & (dur <= 0.10)))
    return (dur <= 0.30) & (near | exact | backed)


def borderline_candidate() -> Column:
    official = (F.col("_id") == 2) | F.col("_off")
    backed = (F.col("_id") >= 1) | (F.col("_src") >= 2)
    return (F.col("_sim") >= 85) & backed & ((official & (F.col("_dur") <= 0.45)) | (~official & (F.col("_dur") <= 0.10)))


def decide_matches(
    candidates: DataFrame, key: str, position: str, keep: list[str], with_channel: bool = True, items: DataFrame | None = None
) -> DataFrame:
    """(key, status, selected fields): automatic, ambiguous or no_confident_match.

    Confident candidates are first reduced per (key, evidence tuple), then per key; both steps combine before the
    shuffle, so an item with very many candidates stays cheap. Equal best tuples are ambiguous unless all come from the
    same exact artist channel with nearly the same length.
    """
    rated = with_priorities(candidates).withColumn("_ok", ~invalid_candidate())
    rated = rated.withColumn("_sure", F.col("_ok") & confident_candidate(with_channel))
    rated = rated.withColumn("_edge", F.col("_ok") & borderline_candidate())
    channel = F.coalesce(F.col("channel"), F.lit("")) if with_channel else F.lit("")
    tuple_cols = ["_sim", "_near", "_id", "_src", "_mdur"]
    rated = rated.withColumn("_near", (F.col("_dur") <= 0.15).cast("int")).withColumn("_mdur", -F.col("_dur"))
    reach = rated.groupBy(key, "_sure", *tuple_cols).agg(
        F.min_by(F.struct(*keep), F.col(position)).alias("_pick"),
        F.count(F.lit(1)).alias("_n"),
        F.min(channel).alias("_c_low"),
        F.max(channel).alias("_c_high"),
        F.bool_or("_edge").alias("_edge"),
    )
    order = F.struct(F.col("_sure").cast("int"), *tuple_cols)
    best = reach.groupBy(key).agg(
        F.max_by(F.struct("_pick", "_n", "_c_low", "_c_high", "_sure", *tuple_cols), order).alias("b"), F.bool_or("_edge").alias("_edge")
    )
    same_channel = (F.col("b._id") == 2) & (F.col("b._c_low") != "") & (F.col("b._c_low") == F.col("b._c_high")) & (F.col("b._mdur") >= -0.01)
    alone = (F.col("b._n") == 1) | same_channel
    status = (
        F.when(F.col("b._sure") & alone, "automatic")
        .when(F.col("b._sure") | F.col("_edge"), "ambiguous")
        .otherwise("no_confident_match")
    )
    out = best.withColumn("status", status)
    picked = [F.when(F.col("status") == "automatic", F.col(f"b._pick.{c}")).alias(f"selected_{c}") for c in keep]
    decided = out.select(key, "status", *picked)
    if items is None:
        return decided
    return items.select(key).distinct().join(decided, key, "left").fillna({"status": "no_confident_match"})


def dominance_order(candidates: DataFrame, key: str, position: str) -> DataFrame:
    """Adds how many candidates of the item dominate each one, and the order by that count.

    A candidate dominates when it is no worse on similarity, identity, number of sources and duration, and better on one.
    Equal measures are counted first, so an item's candidates meet once per different set of measures.
    """
    none = F.array().cast("array<string>")
    parts = {
        "_sim": F.coalesce(F.col("title_similarity").cast("double"), F.lit(-1.0)), "_id": M.identity_priority(F.coalesce("identity_evidence", none)),
        "_src": F.size(F.coalesce("source_evidence", none)), "_near": -F.coalesce(F.col("duration_difference_ratio").cast("double"), F.lit(FAR)),
    }
    rated = candidates.withColumns(parts)
    kinds = rated.groupBy(key, *parts).agg(F.count(F.lit(1)).alias("_n"))
    others = kinds.select(F.col(key).alias("_key"), *[F.col(p).alias(f"_o{p}") for p in parts], F.col("_n").alias("_on"))
    no_worse, better = F.lit(True), F.lit(False)
    for p in parts:
        no_worse, better = no_worse & (F.col(f"_o{p}") >= F.col(p)), better | (F.col(f"_o{p}") > F.col(p))
    met = kinds.join(others, (F.col(key) == F.col("_key")) & no_worse & better).groupBy(key, *parts).agg(F.sum("_on").alias("_above"))
    counted = rated.join(met, [key, *parts], "left").withColumn("dominated_by", F.coalesce("_above", F.lit(0)).cast("int")).drop(*parts, "_above")
    place = F.row_number().over(W.partitionBy(key).orderBy("dominated_by", position))
    return counted.withColumn("evidence_order", place)


# ---- mapping records -------------------------------------------------------------------------------

def resolve_selection(selections: DataFrame) -> DataFrame:
    """Final choice per item: status text and chosen video to decision status and match method."""
    automatic = F.coalesce(F.col("match_status"), F.lit("")).contains("automatic")
    chosen = ~M.blank(F.col("selected_video_id"))
    return selections.select(
        "*",
        F.when(automatic, "automatic").when(chosen, "manual_selected").otherwise("no_confident_match").alias("decision_status"),
        F.when(~automatic & chosen, "manual_review").otherwise("youtube_search").alias("match_method"),
    )


def mapping_records(candidates: DataFrame, selections: DataFrame, key: str) -> DataFrame:
    """Candidate rows with their selection flag and row status; by candidate number, else by video id."""
    joined = candidates.join(resolve_selection(selections).drop("match_status"), key, "left")
    number, video = F.col("selected_candidate_number"), F.col("selected_video_id")
    by_number = number.isNotNull() & (F.col("candidate_number") == number)
    by_video = number.isNull() & ~M.blank(video) & (F.col("video_id") == video)
    selected = F.coalesce(by_number | by_video, F.lit(False))
    return joined.select(
        *candidates.columns,
        selected.alias("is_selected"),
        F.when(selected, "success").when(M.blank(video), "not_found").otherwise("rejected").alias("status"),
        F.coalesce("decision_status", F.lit("no_confident_match")).alias("decision_status"),
        F.when(selected, F.col("match_method")).otherwise("youtube_search").alias("match_method"),
    )


# Keywords whose candidates are followed through the selection.
COHORT_WORDS = ["dance practice", "karaoke", "cover", "live", "studio choom", "fancam", "nightcore"]


def keyword_cohorts(candidates: DataFrame, title: str, video: str, selected: str, words: list[str] = COHORT_WORDS) -> DataFrame:
    """Candidates, distinct selected videos, rejected and rejection rate per keyword, in one pass."""
    lower = F.lower(F.col(title))
    cells = []
    for i, w in enumerate(words):
        hit = lower.contains(w)
        cells += [F.count_if(hit).alias(f"n{i}"), F.count_distinct(F.when(hit & F.col(selected), F.col(video))).alias(f"s{i}")]
    wide = candidates.agg(*cells)
    rows = F.array(*[F.struct(F.lit(w).alias("keyword"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("s")) for i, w in enumerate(words)])
    n, s = F.col("r.n"), F.col("r.s")
    return wide.select(F.explode(rows).alias("r")).select(
        F.col("r.keyword").alias("keyword"), n.alias("total_candidates"), s.alias("selected"), (n - s).alias("rejected"),
        F.round(F.when(n > 0, (n - s) / n * 100).otherwise(100.0), 6).alias("rejection_rate"),
    )


def threshold_coverage(df: DataFrame, value: str, limits: list[float]) -> DataFrame:
    """Share of values at or below each limit."""
    x = F.col(value)
    return df.agg(F.count(value).alias("n"), *[(F.count_if(x <= t) / F.count(value)).alias(f"share_le_{t:g}") for t in limits])
