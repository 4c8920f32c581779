"""Title, artist and source evidence as column expressions.

Patterns run on the JVM with Unicode classes and case folding. Only the longest-common-subsequence ratio is Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.functions import title_rules as R
from chartspark.functions.text import strip

IU = "(?iU)"


def found(text: Column, patterns: list[str] | str) -> Column:
    body = R.quick(patterns) if isinstance(patterns, str) else R.any_of(patterns)
    return text.rlike(IU + body)


def drop(text: Column, pattern: str | Column, by: str = " ") -> Column:
    p = F.lit(IU + R.quick(pattern)) if isinstance(pattern, str) else F.concat(F.lit(IU), pattern)
    return F.regexp_replace(text, p, F.lit(by))


def quoted(c: Column) -> Column:
    """Literal pattern of a text."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


# ---- cleaning --------------------------------------------------------------------------------------

def without_presentation(title: Column) -> Column:
    text = title
    for pattern in R.PRESENTATION:
        text = drop(text, pattern)
    for pattern in R.EMPTY_BRACKETS:
        text = drop(text, pattern)
    return F.coalesce(text, F.lit(""))


def without_artist(title: Column, artist: Column) -> Column:
    """Title without the matching artist before or after it; the first prefix form that leaves text wins.

    One alternation keeps the title expression single, so nested use does not multiply the plan.
    """
    name = quoted(strip(artist))
    head = F.replace(F.lit(rf"^(?:\[[^\]]*\]\s*)*{R.any_of(R.ARTIST_PREFIX)}(?=[\s\S]*\S)"), F.lit("{artist}"), name)
    tail = F.replace(F.lit(R.ARTIST_SUFFIX), F.lit("{artist}"), name)
    never = F.lit("(?!)")
    no_artist = blank(artist)
    text = drop(strip(title), F.when(no_artist, never).otherwise(head), "")
    return drop(text, F.when(no_artist, never).otherwise(tail), "")


def without_feature_credits(title: Column, wanted: Column | None = None) -> Column:
    """Title without feature credits; kept when the wanted title has one, or when the bracket names a version."""
    text = title
    for opening, inner, closing in ((r"\(", r"[^()]*", r"\)"), (r"\[", r"[^\[\]]*", r"\]")):
        text = drop(text, f"{opening}(?={inner}{R.ANY_FEATURE})(?!{inner}{R.ANY_VERSION}){inner}{closing}")
    for p in R.FEATURE:
        text = drop(text, rf"\s+{p}\s+[^\(\[\)\]]*(?=\s*$|\s*[\(\[])")
    text = F.coalesce(text, F.lit(""))
    return text if wanted is None else F.when(~blank(title) & F.coalesce(found(wanted, R.ANY_FEATURE), F.lit(False)), title).otherwise(text)


def canonical_versions(title: Column) -> Column:
    text = title
    for pattern, form in R.CANONICAL:
        text = drop(text, pattern, form)
    return F.coalesce(text, F.lit(""))


def words_only(text: Column) -> Column:
    plain = F.regexp_replace(strip(F.lower(text)), r"(?U)[^\w\s]", " ")
    return strip(F.regexp_replace(plain, r"(?U)\s+", " "))


def normalize_title(title: Column, artist: Column | None = None) -> Column:
    text = without_presentation(canonical_versions(title))
    return words_only(text if artist is None else without_artist(text, artist))


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def without_bracket_metadata(title: Column) -> Column:
    text = drop(title, rf"\((?=[^()]*{R.ANY_METADATA})[^()]*\)")
    return drop(text, rf"\[(?=[^\[\]]*{R.ANY_METADATA})[^\[\]]*\]")


def without_trailing_metadata(title: Column) -> Column:
    text = title
    for p in R.METADATA:
        text = drop(text, p + r".*$")
    return text


def core_title(title: Column, artist: Column | None = None) -> Column:
    """Title without presentation, artist, bracketed and trailing metadata."""
    text = without_presentation(title)
    text = text if artist is None else without_artist(text, artist)
    return words_only(without_trailing_metadata(without_bracket_metadata(text)))


# ---- versions --------------------------------------------------------------------------------------

def version_tags(title: Column) -> Column:
    return F.array_compact(F.array(*[F.when(found(title, patterns), F.lit(tag)) for tag, patterns in R.VERSION.items()]))


def bracket_contents(text: Column) -> Column:
    return F.concat(
        F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))
    )


def remix_qualifiers(title: Column, artist: Column) -> Column:
    """Words of bracketed remix notes that are neither fixed words nor the artist."""
    cleaned = without_artist(without_presentation(title), artist)
    notes = F.filter(bracket_contents(cleaned), lambda b: found(b, r"\bremix\b"))
    words = F.flatten(F.transform(notes, lambda b: tokens(normalize_title(b))))
    stop = F.concat(F.array(*[F.lit(w) for w in R.REMIX_STOP]), tokens(normalize_title(F.coalesce(artist, F.lit("")))))
    return F.array_except(F.array_distinct(words), stop)


def tags_conflict(wanted_tags: Column, offered_tags: Column) -> Column:
    """Tag sets differ; when a live version is wanted the live family counts as one."""
    live = F.array_contains(wanted_tags, "live")
    family = F.array(*[F.lit(t) for t in R.LIVE_FAMILY])

    def merged(tags: Column) -> Column:
        one = F.transform(tags, lambda t: F.when(F.array_contains(family, t), F.lit("live")).otherwise(t))
        return F.array_sort(F.array_distinct(F.when(live, one).otherwise(tags)))

    return merged(wanted_tags) != merged(offered_tags)


def qualifiers_conflict(mine: Column, theirs: Column, wanted_words: Column) -> Column:
    """Both are remixes but of different remixers."""
    named = (F.size(mine) > 0) & (F.array_sort(mine) != F.array_sort(theirs))
    return named | ((F.size(mine) == 0) & (F.size(F.array_except(theirs, wanted_words)) > 0))


def with_version_conflict(df: DataFrame, wanted: str, offered: str, artist: str, out: str = "version_conflict") -> DataFrame:
    """Adds whether two titles name different versions; tags and remix words are made once per row."""
    w, o, a = F.col(wanted), F.col(offered), F.col(artist)
    tagged = df.withColumn("_tw", version_tags(w)).withColumn("_to", version_tags(o))
    remixes = F.array_contains("_tw", "remix") & F.array_contains("_to", "remix")
    named = tagged.withColumn("_qw", F.when(remixes, remix_qualifiers(w, a))).withColumn("_qo", F.when(remixes, remix_qualifiers(o, a)))
    words = named.withColumn("_ww", F.when(remixes, tokens(normalize_title(w))))
    by_name = F.coalesce(qualifiers_conflict(F.col("_qw"), F.col("_qo"), F.col("_ww")), F.lit(False))
    conflict = ~blank(w) & ~blank(o) & (tags_conflict(F.col("_tw"), F.col("_to")) | (remixes & by_name))
    return words.withColumn(out, conflict).drop("_tw", "_to", "_qw", "_qo", "_ww")


def without_plain_brackets(text: Column) -> Column:
    """Drop brackets that name no version."""
    out = drop(text, rf"\((?![^()]*{R.ANY_VERSION})[^()]*\)")
    return drop(out, rf"\[(?![^\[\]]*{R.ANY_VERSION})[^\[\]]*\]")


def version_suffix(text: Column) -> Column:
    """Distinct normalised bracket notes that name a version, joined by blanks."""
    notes = F.transform(F.filter(bracket_contents(text), lambda b: found(b, R.ANY_VERSION)), lambda b: normalize_title(b))
    return F.array_join(F.array_distinct(F.filter(notes, lambda n: n != "")), " ")


def with_suffix(variant: Column, suffix: Column) -> Column:
    """Variant followed by the suffix words it lacks."""
    have = tokens(variant)
    extra = F.array_except(F.array_distinct(tokens(suffix)), have)
    return F.when((variant == "") | (suffix == ""), variant).otherwise(F.array_join(F.concat(have, extra), " "))


def quoted_groups(cleaned: Column) -> Column:
    """All (whole, inner) quoted parts, pattern by pattern."""
    groups = []
    for pattern in R.QUOTES:
        whole = F.regexp_extract_all(cleaned, F.lit("(?U)" + pattern), F.lit(0))
        inner = F.regexp_extract_all(cleaned, F.lit("(?U)" + pattern), F.lit(1))
        groups.append(F.zip_with(whole, inner, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.concat(*groups)


def stands_alone(part: Column, cleaned: Column, artist: Column) -> Column:
    """At most two Latin letters remain outside of the quoted part."""
    before = F.call_function("substring_index", cleaned, part["w"], F.lit(1))
    after = F.substr(cleaned, F.length(before) + F.length(part["w"]) + 1)
    outside = without_artist(strip(F.concat(before, F.lit(" "), after)), artist)
    bare = drop(without_plain_brackets(outside), R.ANY_VERSION)
    latin = strip(F.regexp_replace(bare, r"(?U)[가-힣\W_]+", " "))
    named = F.when(blank(artist), F.lit("(?!)")).otherwise(F.concat(F.lit(r"\b"), quoted(artist), F.lit(r"\b")))
    return F.length(strip(drop(latin, named))) <= 2


def with_title_variants(df: DataFrame, offered: str, artist: str, wanted: str, conflict: str, out: str = "variants") -> DataFrame:
    """Adds the normalised readings of an offered title; bracket, quote and two-script readings only without a version conflict.

    Each step is its own column, so no step is computed twice.
    """
    o, a = F.col(offered), F.col(artist)
    cleaned, suffix, outer = F.col("_cleaned"), F.col("_suffix"), F.col("_outer")

    def normal(text: Column) -> Column:
        # most readings are empty; they skip the pattern chain
        return F.when(text != "", normalize_title(text, a)).otherwise("")

    def suffixed(names: Column) -> Column:
        # names are ready values here: a function with several uses of its argument would repeat the chain for each
        return F.transform(names, lambda n: with_suffix(n, suffix))

    rows = df.withColumn("_bare", without_artist(without_presentation(o), a))
    rows = rows.withColumn("_cleaned", without_feature_credits(F.col("_bare"), F.col(wanted)))
    rows = rows.withColumn("_suffix", version_suffix(cleaned)).withColumn("_outer", without_plain_brackets(cleaned))
    rows = rows.withColumn("_an1", normalize_title(a)).withColumn("_groups", quoted_groups(cleaned))
    rows = rows.withColumn("_parts", F.transform(F.filter("_groups", lambda p: stands_alone(p, cleaned, a)), lambda p: p["i"]))
    from_quotes = F.flatten(F.transform("_parts", lambda p: F.concat(
        F.array(p), F.regexp_extract_all(p, F.lit(r"\(([^()]+)\)"), F.lit(1)), F.array(without_plain_brackets(p)),
    )))
    notes = F.filter(F.regexp_extract_all(cleaned, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda b: ~found(b, R.ANY_VERSION))
    rows = rows.withColumn("_q", from_quotes).withColumn("_n", notes)
    rows = rows.withColumn("_q", F.transform(F.array_distinct("_q"), normal)).withColumn("_n", F.transform("_n", normal))
    rows = rows.withColumn("_q", suffixed(F.col("_q"))).withColumn("_n", F.filter(suffixed(F.col("_n")), lambda n: n != F.col("_an1")))
    rows = rows.withColumn("_s1", F.regexp_extract(outer, R.TWO_SCRIPTS, 1)).withColumn("_s2", F.regexp_extract(outer, R.TWO_SCRIPTS, 2))
    local = F.when(F.col("_s1") != "", normalize_title(F.col("_s1"))).otherwise("")
    rows = rows.withColumn("_o", F.array(normal(outer), local, normal(F.col("_s2"))))
    rows = rows.withColumn("_o", suffixed(F.col("_o")))
    rows = rows.withColumn("_p", F.array(normalize_title(o, a), normalize_title(cleaned, a)))
    every = F.when(F.col(conflict), F.col("_p")).otherwise(F.concat("_p", "_q", "_n", "_o"))
    made = rows.withColumn(out, F.array_distinct(F.filter(every, lambda v: v != "")))
    return made.drop("_bare", "_cleaned", "_suffix", "_outer", "_an1", "_groups", "_parts", "_q", "_n", "_o", "_p", "_s1", "_s2")


def with_script_pairs(df: DataFrame, offered: Column, artist: Column, out: str = "pairs") -> DataFrame:
    """Adds the normalised (a, b) names written as 'name (name)' in two scripts in an offered title."""
    rows = df.withColumn("_bare", without_artist(without_presentation(offered), artist))
    bare, pairs = F.col("_bare"), []
    for p in R.SCRIPT_PAIRS:
        x = F.transform(F.regexp_extract_all(bare, F.lit("(?U)" + p), F.lit(1)), lambda t: normalize_title(t, artist))
        y = F.transform(F.regexp_extract_all(bare, F.lit("(?U)" + p), F.lit(2)), lambda t: normalize_title(t, artist))
        pairs.append(F.zip_with(x, y, lambda u, v: F.struct(u.alias("a"), v.alias("b"))))
    return rows.withColumn(out, F.filter(F.concat(*pairs), lambda p: (p["a"] != "") & (p["b"] != ""))).drop("_bare")


def clash_words(mine: Column, theirs: Column, aliases: Column) -> Column:
    """Offered words that contradict the wanted words; none when all wanted words or an alias are there.

    mine and theirs are distinct word arrays, aliases an array of word arrays.
    """
    contained = F.size(F.array_except(mine, theirs)) == 0
    by_alias = F.exists(aliases, lambda a: (F.size(a) > 0) & (F.size(F.array_except(a, theirs)) == 0))
    empty = (F.size(mine) == 0) | (F.size(theirs) == 0)
    none = F.array().cast("array<string>")
    return F.when(empty | contained | F.coalesce(by_alias, F.lit(False)), none).otherwise(F.array_except(theirs, mine))


# ---- similarity ------------------------------------------------------------------------------------

def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one big-integer row per character."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        match = row & where.get(ch, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Similarity 0..100: twice the common subsequence over both lengths."""
    size = len(a) + len(b)
    return 100.0 if size == 0 else 100.0 - 100.0 * (size - 2 * common_length(a, b)) / size


@F.pandas_udf(T.DoubleType())
def best_ratio(targets: pd.Series, variants: pd.Series) -> pd.Series:
    """Largest ratio over all (target, variant) pairs of a row; repeated pairs are computed once per batch."""
    known: dict[tuple[str, str], float] = {}

    def ratio(a: str, b: str) -> float:
        if (a, b) not in known:
            known[a, b] = indel_ratio(a, b)
        return known[a, b]

    def best(ts, vs):
        if ts is None or vs is None:
            return None
        return max((ratio(t, v) for t in ts for v in vs), default=None)

    return pd.Series([best(t, v) for t, v in zip(targets, variants)], dtype="float64")


# ---- identity --------------------------------------------------------------------------------------

def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def channel_artist(channel: Column) -> Column:
    """Channel name reduced to the artist it belongs to."""
    text = drop(strip(channel), r"\s*[-–—]\s*topic\b", "")
    text = drop(drop(text, r"vevo$", ""), r"\bofficial\b")
    text = F.when(text.rlike("[A-Za-z]"), F.regexp_replace(text, "[가-힣]+", " ")).otherwise(text)
    return F.coalesce(normalize_title(text), F.lit(""))


def artist_in_text(artist_normal: Column, text_normal: Column) -> Column:
    """Whole phrase, or five and more characters regardless of blanks."""
    padded = F.concat(F.lit(" "), text_normal, F.lit(" ")).contains(F.concat(F.lit(" "), artist_normal, F.lit(" ")))
    tight = (F.length(compact(artist_normal)) >= 5) & compact(text_normal).contains(compact(artist_normal))
    return (artist_normal != "") & (text_normal != "") & (padded | tight)


def identity_evidence(artist: Column, title_normal: Column, channel: Column, channel_normal: Column, channel_clean: Column) -> Column:
    """Evidence that the channel or the title belongs to the artist; artist, *_normal and channel_clean are normalised."""
    named = channel_normal != ""
    exact = named & (
        (artist == channel_normal)
        | ((channel_clean != "") & (channel_clean == artist))
        | ((F.length(compact(artist)) >= 3) & (compact(artist) == compact(channel_clean)))
    )
    lower = F.lower(F.coalesce(channel, F.lit("")))
    table = F.create_map(*[x for name, cs in R.AGENCY_CHANNELS.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in cs]))])
    agency = F.coalesce(F.exists(table[artist], lambda c: lower.contains(c)), F.lit(False))
    within = named & ~exact & (artist_in_text(artist, channel_normal) | agency)
    topic = exact & found(F.coalesce(channel, F.lit("")), r"\btopic\b")
    evidence = F.array_compact(F.array(
        F.when(exact, "exact_channel_artist"), F.when(topic | within, "artist_in_channel"),
        F.when(artist_in_text(artist, title_normal), "artist_in_title"),
    ))
    return F.when(artist != "", evidence).otherwise(F.array().cast("array<string>"))


# ---- source ----------------------------------------------------------------------------------------

def source_evidence(title: Column, channel: Column, has_artist: Column, identity: Column) -> Column:
    """Topic and official channel marks plus the source the title claims, downgraded on an unverified channel."""
    def tidy(c: Column) -> Column:
        return F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")

    t, c = tidy(title), tidy(channel)
    fan = found(c, R.FAN_CHANNEL)
    topic = found(c, r"\btopic\b")
    official = ~fan & found(c, R.OFFICIAL_CHANNEL)
    by_name = F.array_contains(identity, "exact_channel_artist") | F.array_contains(identity, "artist_in_channel")
    verified = ~has_artist | (~fan & (topic | official | by_name))
    claim = None
    for pattern, name in R.TITLE_SOURCE:
        value = F.when(~verified, F.lit(R.DOWNGRADE[name])).otherwise(F.lit(name)) if name in R.DOWNGRADE else F.lit(name)
        claim = F.when(found(t, pattern), value) if claim is None else claim.when(found(t, pattern), value)
    return F.array_compact(F.array(F.when(topic, "topic_channel"), F.when(official, "official_channel"), claim))


def is_hard_invalid_source(title: Column) -> Column:
    """Cover and karaoke uploads."""
    return found(words_only(F.coalesce(title, F.lit(""))), r"\b(?:cover|karaoke)\b")


def duration_ratio(wanted_ms: Column, offered_seconds: Column) -> Column:
    """Relative difference of the lengths, NULL when one is missing or not positive."""
    offered = (offered_seconds * 1000).cast("bigint")
    return F.when((wanted_ms > 0) & (offered > 0), F.abs(wanted_ms - offered) / wanted_ms)


# ---- priorities ------------------------------------------------------------------------------------

def identity_priority(evidence: Column) -> Column:
    return (
        F.when(F.array_contains(evidence, "exact_channel_artist"), 2)
        .when(F.array_contains(evidence, "artist_in_channel") | F.array_contains(evidence, "artist_in_title"), 1)
        .otherwise(0)
    )


def source_priority(evidence: Column) -> Column:
    weights = [F.when(F.array_contains(evidence, name), n).otherwise(0) for name, n in R.SOURCE_PRIORITY.items()]
    return F.greatest(*weights)


def has_official_source(evidence: Column, with_live: bool = False) -> Column:
    names = R.OFFICIAL_SOURCES + (["official_live"] if with_live else [])
    return F.coalesce(F.arrays_overlap(evidence, F.array(*[F.lit(n) for n in names])), F.lit(False))


def is_official(source: Column, identity: Column) -> Column:
    """Mapping flag: an exact artist channel or any official source, official live included."""
    return F.array_contains(identity, "exact_channel_artist") | has_official_source(source, with_live=True)
