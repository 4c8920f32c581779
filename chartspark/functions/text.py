"""Lyric text as column expressions; Python only for Unicode NFC and near-repeat similarity."""

from __future__ import annotations

import re
import sys
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark import scale
from chartspark.functions.clean import col
from chartspark.functions.language_rules import (
    CHORUS_TAG, DEFAULT_RULES, EDGE_MARKS, SECTION_TAG, WORD_PATTERN, LyricRules,
)

JOINER = "\u001f"
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
# the same characters one by one
_BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_VISIBLE = r"[^\s\x1c-\x1f\x85\p{Z}]"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(c: str | Column) -> Column:
    """Composed form. Characters before U+0300 are composed already, so only texts with later ones go to Python."""
    text = col(c)
    return F.coalesce(_composed(F.when(text.rlike("[^\\x00-\\u02ff]"), text)), text)


def strip(c: str | Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.btrim(col(c), F.lit(_BLANKS))


def normalize_text(c: str | Column) -> Column:
    """Trimmed, runs of blanks collapsed, line breaks kept; expects NFC text."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"[\t\f\x0B ]+", " "), r" *\n *", "\n")


def _single_folds() -> tuple[str, str]:
    """Characters whose case fold is one character other than their lower case."""
    pairs = [
        (ch, ch.casefold()) for ch in map(chr, range(128, sys.maxunicode + 1))
        if ch.lower() == ch and ch.casefold() != ch and len(ch.casefold()) == 1
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD_FROM, _FOLD_TO = _single_folds()


def casefold(c: Column) -> Column:
    """Lower case plus the folds lower case misses (one-character folds and the sharp s)."""
    return F.replace(F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO), F.lit("ß"), F.lit("ss"))


def _plain(text: Column) -> Column:
    """Only characters up to U+02FF whose lower case is their whole fold (but for the sharp s) and, like them, one letter."""
    other = text.rlike("[^\\x00-\\u02ff]")
    for c in "µİſ":
        other = other | text.contains(c)
    return ~other


def clean_tokens(raw: Column) -> Column:
    """Folded tokens without edge marks; tokens without a letter or number drop out."""
    marks = re.escape(EDGE_MARKS).replace('"', '\\"')
    folded = F.transform(raw, lambda t: F.regexp_replace(casefold(t), f"^[{marks}]+|[{marks}]+$", ""))
    return F.filter(folded, lambda t: t.rlike(r"[\p{L}\p{N}]"))


def tokenize(text: str | Column, language: str | Column, rules: LyricRules = DEFAULT_RULES) -> Column:
    """Token array: blank-separated for some languages, Unicode words else; section tags are no words.

    A plain text is folded whole before its words are cut: its letters stay letters, and words begin and end with one, so that
    nothing is left to do for each word.
    """
    body = F.regexp_replace(col(text), SECTION_TAG, " ")
    word = F.lit(f"({WORD_PATTERN})")
    by_blank = F.filter(F.split(body, f"{_BLANK}+"), lambda t: t != "")
    by_word = F.regexp_extract_all(body, word, F.lit(1))
    blank = F.coalesce(col(language).isin(rules.blank_languages), F.lit(False))
    plain = F.regexp_extract_all(F.replace(F.lower(body), F.lit("ß"), F.lit("ss")), word, F.lit(1))
    return F.when(~blank & _plain(col(text)), plain).otherwise(clean_tokens(F.when(blank, by_blank).otherwise(by_word)))


def punctuation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{P}", ""))


def _choose(language: Column, lists: dict[str, list[str]], extra: dict[str, list[str]] | None = None) -> Column:
    """Array literal for the language of the row, NULL when it has none."""
    out = None
    for name, words in {**lists, **(extra or {})}.items():
        array = F.array(*[F.lit(w) for w in words])
        out = F.when(language == name, array) if out is None else out.when(language == name, array)
    return out


def title_content(title: str | Column, language: str | Column, rules: LyricRules = DEFAULT_RULES) -> Column:
    """Distinct title tokens with a letter that are no stopword; mixed text uses the stopwords of all languages."""
    union = sorted({w for words in rules.stopwords.values() for w in words})
    stop = _choose(col(language), rules.stopwords, {"mixed": union})
    tokens = F.array_distinct(tokenize(title, language, rules))
    letters = F.filter(tokens, lambda t: t.rlike(r"\p{L}"))
    return F.array_except(letters, F.coalesce(stop, F.array().cast("array<string>")))


def pronoun_tokens(tokens: Column, language: str | Column, rules: LyricRules = DEFAULT_RULES) -> Column:
    """Token positions covered by pronouns, NULL for other languages.

    Tokens are joined with a separator and matched by one alternation with longer phrases first, which scans left to
    right without overlaps.
    """
    line = F.concat(F.lit(JOINER), F.array_join(tokens, JOINER), F.lit(JOINER))
    out = None
    for name, entries in rules.pronouns.items():
        phrases = sorted({tuple(e.casefold().split()) for e in entries}, key=lambda p: (-len(p), p))
        body = "|".join(JOINER.join(re.escape(w) for w in p) for p in phrases)
        hits = F.regexp_extract_all(line, F.lit(f"(?<={JOINER})({body})(?={JOINER})"), F.lit(1))
        covered = F.aggregate(hits, F.lit(0), lambda acc, h: acc + F.size(F.split(h, JOINER)))
        cond = col(language) == name
        out = F.when(cond, covered) if out is None else out.when(cond, covered)
    return out


# ---- chorus ----------------------------------------------------------------------------------------

def chorus_lines(text: Column) -> Column:
    """Folded lines without tags and punctuation; empty lines drop out."""
    body = F.regexp_replace(text, SECTION_TAG, "")
    lines = F.split(body, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]")
    plain = F.transform(lines, lambda x: F.regexp_replace(casefold(x), r"(?U)[^\w\s]", " "))
    tidy = F.transform(plain, lambda x: strip(F.regexp_replace(x, f"{_BLANK}+", " ")))
    return F.filter(tidy, lambda x: x != "")


@F.pandas_udf(T.DoubleType())
def word_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two word sequences; NULL in gives NULL out."""
    return pd.Series([None if a is None else SequenceMatcher(None, a.split(), b.split()).ratio() for a, b in zip(left, right)], dtype="float64")


def line_blocks(texts: DataFrame, key: str, lines: str, rules: LyricRules = DEFAULT_RULES) -> DataFrame:
    """One row per line: key, at, line, n (lines of the text) and block, the lines from there on up to the longest block."""
    rows = texts.select(key, F.size(lines).alias("n"), F.posexplode(lines).alias("at", "line"))
    ahead = W.partitionBy(key).orderBy("at").rowsBetween(0, rules.max_block_lines - 1)
    return rows.withColumn("block", F.collect_list("line").over(ahead))


def repeated_blocks(texts: DataFrame, key: str, lines: str, rules: LyricRules = DEFAULT_RULES) -> DataFrame:
    """(key, repeats) of texts in which a block of lines comes again: further occurrences of the block that covers most lines.

    A block meets its copies by a join on its first line; copies that are not equal are compared word by word. Copies are
    taken from the front without overlap. Equal cover: the block that starts first, then the shorter one.
    """
    rows = line_blocks(texts, key, lines, rules).where(F.length("line") >= 3)
    words = lambda c: F.size(F.split(F.array_join(c, " "), " "))
    rich = (F.size(F.array_distinct("block")) >= rules.min_unique_lines) & (words(F.col("block")) >= rules.min_block_words)
    starts = rows.where(rich).select(key, "line", "n", "at", F.col("block").alias("own"))
    copies = rows.select(key, "line", F.col("at").alias("place"), F.col("block").alias("other"))
    met = starts.join(copies, [key, "line"]).where(F.col("place") >= F.col("at") + rules.min_block_lines)
    longest = F.least(F.lit(rules.max_block_lines), F.floor(F.col("n") / 2).cast("int"), F.col("n") - F.col("at"))
    met = met.where(longest >= rules.min_block_lines).withColumn("size", F.explode(F.sequence(F.lit(rules.min_block_lines), longest)))
    met = met.withColumn("length", F.least("size", F.col("n") - F.col("place")))
    met = met.where((F.col("length") >= rules.min_block_lines) & (F.col("size") - F.col("length") <= 1))
    met = met.withColumn("own", F.slice("own", 1, F.col("size"))).withColumn("other", F.slice("other", 1, F.col("length")))
    met = met.where((F.size(F.array_distinct("own")) >= rules.min_unique_lines) & (words(F.col("own")) >= rules.min_block_words))
    differ = F.col("own") != F.col("other")
    near = word_similarity(F.when(differ, F.array_join("own", " ")), F.when(differ, F.array_join("other", " ")))
    alike = met.withColumn("_near", near).where(~differ | (F.col("_near") >= rules.block_similarity))
    found = alike.groupBy(key, "at", "size").agg(F.sort_array(F.collect_list(F.struct("place", "length"))).alias("places"))
    first = F.struct((F.col("at") + F.col("size")).alias("end"), F.lit(0).alias("taken"))
    walk = F.aggregate("places", first, lambda acc, p: F.when(p["place"] >= acc["end"], F.struct((p["place"] + p["length"]).alias("end"), (acc["taken"] + 1).alias("taken"))).otherwise(acc))
    taken = found.select(key, "at", "size", walk["taken"].alias("taken")).where("taken > 0")
    cover = F.struct(F.col("size") * (F.col("taken") + 1), -F.col("at"), -F.col("size"))
    return taken.groupBy(key).agg(F.max_by("taken", cover).alias("repeats"))


def with_chorus_repetition(df: DataFrame, text: str, out: str, rules: LyricRules = DEFAULT_RULES) -> DataFrame:
    """Adds the extra chorus occurrences: from two or more tags, else from repeated line blocks; 0 only with one tag.

    Equal texts are searched once; texts without a repeated line of three or more characters are not searched.
    """
    tags, lines = F.regexp_count(F.col(text), F.lit(CHORUS_TAG)), chorus_lines(F.col(text))
    key = F.md5(F.col(text).cast("binary"))
    # an exploded value is made once; a plain column would be made again in each condition of the filter
    cut = df.select(key.alias("_text_key"), F.explode(F.array(F.when(tags < 2, lines))).alias("_lines"))
    anchors = F.filter("_lines", lambda x: F.length(x) >= 3)
    worth = (F.size("_lines") >= 2 * rules.min_block_lines) & (F.size(anchors) > F.size(F.array_distinct(anchors)))
    searched = cut.where(worth).dropDuplicates(["_text_key"])
    rows = df.withColumns({"_tags": tags, "_sung_lines": F.when(tags == 1, F.size(lines)), "_text_key": key})
    rows = rows.join(repeated_blocks(searched, "_text_key", "_lines", rules), "_text_key", "left")
    count = F.when(F.col("_tags") >= 2, F.col("_tags") - 1).when(F.col("repeats") >= 1, F.col("repeats")).when(F.col("_sung_lines") >= 2, F.lit(0))
    return rows.withColumn(out, count).drop("_tags", "_sung_lines", "_text_key", "repeats")


# ---- features --------------------------------------------------------------------------------------

FEATURES = [
    "word_count", "unique_word_count", "lexical_diversity", "repetition_ratio", "avg_word_length", "line_count",
    "chorus_repetition_count", "title_word_in_lyrics", "punctuation_ratio", "pronoun_ratio",
]
COUNT_FEATURES = ["word_count", "unique_word_count", "repetition_ratio", "avg_word_length", "line_count", "chorus_repetition_count"]


def lyric_features(
    df: DataFrame, text: str, title: str, language: str, rules: LyricRules = DEFAULT_RULES, chorus: bool = True
) -> DataFrame:
    """The ten text features per row; a blank text has none, a missing measure stays NULL."""
    base = scale.enough_partitions(df).withColumn("_raw", nfc(text))
    has_text = F.coalesce(F.col("_raw").rlike(_VISIBLE), F.lit(False))
    base = base.withColumn("_tokens", F.when(has_text, tokenize("_raw", language, rules)))  # blanks between words need no tidying
    tokens = F.col("_tokens")
    base = base.withColumn("_n", F.size(tokens)).withColumn("_u", F.size(F.array_distinct(tokens)))
    n, u = F.col("_n"), F.col("_u")
    some = has_text & (n > 0)
    trimmed = strip("_raw")
    lines = F.size(F.filter(F.split("_raw", r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"), lambda x: x.rlike(_VISIBLE)))
    letters = F.aggregate(tokens, F.lit(0), lambda acc, t: acc + F.length(t))
    title_set = title_content(nfc(F.coalesce(title, F.lit(""))), language, rules)
    pronouns = pronoun_tokens(tokens, language, rules)
    base = base.withColumn("_title", F.when(some & F.col(language).isin(rules.title_languages), title_set))
    out = base.select(
        *df.columns,
        F.when(has_text, n).alias("word_count"),
        F.when(has_text, u).alias("unique_word_count"),
        F.when(some, u / n).alias("lexical_diversity"),
        F.when(some, (n - u) / n).alias("repetition_ratio"),
        F.when(some, letters / n).alias("avg_word_length"),
        F.when(has_text & (lines > 0), lines).alias("line_count"),
        F.when(some, F.col("_raw")).alias("_chorus"),
        F.when(F.size("_title") > 0, F.arrays_overlap("_title", "_tokens")).alias("title_word_in_lyrics"),
        F.when(has_text, punctuation_count(trimmed) / F.length(trimmed)).alias("punctuation_ratio"),
        F.when(some, pronouns / n).alias("pronoun_ratio"),
    )
    # the search for repeated lines comes last, as rows then move without their words
    if chorus:
        out = with_chorus_repetition(out.withColumnRenamed("_chorus", "_sung"), "_sung", "_chorus", rules)
    else:
        out = out.withColumn("_chorus", F.lit(None))
    return out.select(*df.columns, *[F.col("_chorus").cast("int").alias(c) if c == "chorus_repetition_count" else F.col(c) for c in FEATURES])


def extraction_status(
    key: Column, duplicate: Column, lyrics_status: Column, file: Column, text: Column, words: Column, language: Column,
    rules: LyricRules = DEFAULT_RULES,
) -> tuple[Column, Column]:
    """Status and reason of one extraction, first matching rule wins."""
    state = F.coalesce(lyrics_status, F.lit(""))
    blank = F.coalesce(strip(text) == "", F.lit(True))
    rules_in_order = [
        (key.isNull() | (key.cast("string") == ""), "invalid_track_id", F.lit("missing_id")),
        (duplicate, "failed", F.lit("duplicate_id_in_input")),
        (state == "not_found", "not_found", F.lit("lyrics_status=not_found")),
        (state != "success", "not_attempted", F.concat(F.lit("lyrics_status="), F.when(state == "", "missing").otherwise(state))),
        (file.isNull() | (file == ""), "missing_file", F.lit("file_path_missing")),
        (text.isNull(), "missing_file", F.concat(F.lit("file_not_found:"), file)),
        (blank, "empty_file", F.lit("file_is_empty")),
        (F.coalesce(words, F.lit(0)) == 0, "failed", F.lit("no_tokens_recognized")),
        (~language.isin(rules.title_languages), "language_limited", F.lit("language_specific_features_limited")),
    ]
    status = reason = None
    for cond, name, why in rules_in_order:
        status = F.when(cond, name) if status is None else status.when(cond, name)
        reason = F.when(cond, why) if reason is None else reason.when(cond, why)
    return status.otherwise("success"), reason.otherwise("")


# ---- language --------------------------------------------------------------------------------------

# Limits of the language vote.
MIN_LETTERS = 15
MAIN_SHARE = 0.70
MIXED_SHARE = 0.30
SCRIPT_SHARE = 0.60
SCRIPTS = {
    "ko": "\\uac00-\\ud7af\\u1100-\\u11ff\\u3130-\\u318f",
    "ja": "\\u3040-\\u30ff\\u31f0-\\u31ff\\uff66-\\uff9d",
    "zh": "\\u4e00-\\u9fff",
}
SECTION_LINE = (
    r"(?i)^\s*\[(?:verse|pre-chorus|chorus|post-chorus|bridge|intro|outro|hook|refrain|instrumental|interlude|break|part|spoken)"
    r"[^\]]*\]\s*$"
)


def clean_line(line: Column) -> Column:
    """Line without section label, links, addresses and brackets around words."""
    text = F.when(line.rlike(SECTION_LINE), F.lit("")).otherwise(strip(line))
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"(?iU)https?://\S+|www\.\S+", "")
    return strip(F.regexp_replace(text, r"\[([^\]]+)\]", "$1"))


def clean_lines(text: str | Column) -> Column:
    lines = F.split(col(text), r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]")
    return F.filter(F.transform(lines, clean_line), lambda x: x != "")


def class_count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


def latin_count(text: Column) -> Column:
    return class_count(text, "A-Za-zÀ-ÖØ-öø-ÿ")


def line_scripts(df: DataFrame, line: str) -> DataFrame:
    """Adds letter counts, the dominant script's language and whether a line has letters enough for a detector."""
    counts = df.select(
        "*", latin_count(F.col(line)).alias("latin"), *[class_count(F.col(line), chars).alias(n) for n, chars in SCRIPTS.items()]
    )
    counts = counts.withColumn("script_total", sum((F.col(n) for n in SCRIPTS), F.lit(0)))
    ranked = F.array(*[F.struct(F.col(n).alias("n"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(SCRIPTS)])
    top = F.array_max(ranked)
    by_script = (F.col("script_total") > 0) & (top["n"] / F.col("script_total") >= SCRIPT_SHARE)
    readable = (F.col("latin") >= MIN_LETTERS) | (F.col("script_total") >= MIN_LETTERS)
    return counts.withColumns({"script_language": F.when(by_script, top["name"]), "readable": readable})


def line_language(df: DataFrame, line: str, detector) -> DataFrame:
    """Adds letter counts and the language of each line: a dominant script wins, short lines have none, else the detector.

    detector maps a line column to a language column.
    """
    facts = line_scripts(df, line)
    language = F.coalesce("script_language", F.when(F.col("readable"), detector(F.col(line))))
    return facts.withColumn("line_language", language).drop("script_language", "readable")


def detect_language(df: DataFrame, key: str, text: str, detector, languages: list[str]) -> DataFrame:
    """(key, language, shares) by letter-weighted line votes with a detector column; languages lists what it may return."""
    lines = scale.enough_partitions(df.select(key, text), key).select(key, F.explode_outer(clean_lines(text)).alias("line"))
    return vote_language(line_language(lines, "line", detector), key, languages)


def four_places(share: Column) -> Column:
    """Rounded on the binary number, halves to even; rounding the decimal digits instead gives other results at halves."""
    return F.rint(share * 1e4) / 1e4


def vote_language(facts: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """(key, language, shares) from the letter counts and languages of lines.

    Lines are summed before the shuffle, so only a few counters per text move. languages lists what the detector may
    return; the three scripts are added. Texts without readable lines are unknown.
    """
    names = [*SCRIPTS, *[x for x in languages if x not in SCRIPTS]]
    weight = F.col("latin") + F.col("script_total")
    counted = weight >= MIN_LETTERS
    none = F.lit(0).cast("bigint")
    sums = facts.groupBy(key).agg(
        *[F.coalesce(F.sum(F.when(counted & (F.col("line_language") == n), weight)), none).alias(f"v_{n}") for n in names],
        *[F.coalesce(F.sum(n), none).alias(f"s_{n}") for n in SCRIPTS],
        F.coalesce(F.sum("latin"), none).alias("latin"),
    )

    def ranked(prefix: str, wanted) -> Column:
        return F.array(*[F.struct(F.col(f"{prefix}_{n}").alias("n"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(wanted)])

    def shares(array: str, whole: Column) -> Column:
        some = F.filter(array, lambda x: x["n"] > 0)
        return F.map_from_entries(F.transform(some, lambda x: F.struct(x["name"], four_places(x["n"] / whole))))

    total, letters = F.col("total"), F.col("letters")
    base = (
        sums.select(
            key, "latin", ranked("v", names).alias("votes"), ranked("s", SCRIPTS).alias("scripts"),
            sum((F.col(f"v_{n}") for n in names), none).alias("total"),
            (sum((F.col(f"s_{n}") for n in SCRIPTS), none) + F.col("latin")).alias("letters"),
        )
        .withColumn("top", F.array_max("votes"))
        .withColumn("top_script", F.array_max("scripts"))
    )
    strong = F.size(F.filter("votes", lambda x: x["n"] / total >= MIXED_SHARE))
    by_script = (letters >= MIN_LETTERS) & (F.col("top_script.n") > 0) & (F.col("top_script.n") / letters >= MAIN_SHARE)
    label = (
        F.when((total > 0) & (F.col("top.n") / total >= MAIN_SHARE), F.col("top.name"))
        .when((total > 0) & (strong >= 2), "mixed")
        .when(total > 0, F.col("top.name"))
        .when(by_script, F.col("top_script.name"))
        .otherwise("unknown")
    )
    other = F.create_map(F.lit("latin_other"), four_places(F.col("latin") / letters))
    by_letters = F.when(F.col("latin") > 0, F.map_concat(shares("scripts", letters), other)).otherwise(shares("scripts", letters))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    distribution = F.when(total > 0, shares("votes", total)).when(by_script, by_letters).otherwise(empty)
    return base.select(key, label.alias("language"), distribution.alias("shares"))


def language_changes(old: DataFrame, new: DataFrame, key: str, language: str = "language") -> DataFrame:
    """Rows whose label changes, with the old and the new one."""
    before = old.select(key, F.col(language).alias("old"))
    after = new.select(key, F.col(language).alias("new"))
    return before.join(after, key).where(~F.col("old").eqNullSafe(F.col("new")))


# ---- search results --------------------------------------------------------------------------------

# Words that mark a result as another recording or a translation; the second list adds foreign words.
RESULT_BAD_WORDS = [
    "translation", "translated", "romanized", "karaoke", "instrumental", "remix", "live", "acoustic", "sped up", "slowed",
    "tribute", "parody", "cover",
]
RESULT_BAD_WORDS_WIDE = RESULT_BAD_WORDS[:3] + [
    "romanization", "traducción", "traduction", "перевод", "übersetzung", "中文翻譯", "中文翻译", "çeviri", "ترجمة",
] + RESULT_BAD_WORDS[3:]


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{_BLANK}+", " "))


def is_original_song(
    result_title: Column, result_artist: Column, title: Column, artist: Column, bad_words: list[str] = RESULT_BAD_WORDS,
    need_both: bool = True,
) -> Column:
    """No bad word in the result, and title and artist contain each other one way or the other."""
    rt, ra, t, a = squeeze(result_title), squeeze(result_artist), squeeze(title), squeeze(artist)
    bad = F.concat_ws("\n", rt, ra).rlike("|".join(re.escape(w) for w in bad_words))
    present = (t != "") & (a != "") if need_both else F.lit(True)
    return ~bad & present & (rt.contains(t) | t.contains(rt)) & (ra.contains(a) | a.contains(ra))
