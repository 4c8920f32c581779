"""Title queries on candidates dressed with credits, language notes, remix notes, quotes and Hangul names.

The twins state what each dress must come to, so they hold no pattern of the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions import titles as M
from chartspark.functions.text import strip
from chartspark.operators import matching
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook
from chartspark.plans.matching import CANDIDATES, _sql_norm, candidates

PLANS = PlanBook()

# a Hangul name of each part, digit by digit
DIGITS, SYLLABLES = "0123456789", "가나다라마바사아자차"
PARTS = f"""dressed AS (SELECT p_partkey AS track, p_name AS name, replace(p_brand, '#', ' No ') AS artist, 'Guest' || p_size AS guest,
  'guest' || p_size AS g, translate(CAST(p_partkey AS VARCHAR), '{DIGITS}', '{SYLLABLES}') AS hangul FROM part)"""


def parts(spark, sf):
    part, size = S.table(spark, sf, "part"), F.col("p_size").cast("string")
    named = part.select(
        F.col("p_partkey").alias("track"), F.col("p_name").alias("name"), F.replace("p_brand", F.lit("#"), F.lit(" No ")).alias("artist"),
        F.concat(F.lit("Guest"), size).alias("guest"), F.translate(F.col("p_partkey").cast("string"), DIGITS, SYLLABLES).alias("hangul"),
    )
    # few bytes, heavy work a row; rows of one artist follow each other, so its patterns are compiled once
    return scale.spread_for_cpu(named, "track").sortWithinPartitions("artist")


def dressed(spark, sf, forms: list[str]):
    """One row per part and form; {name} and the other columns in a form stand for their values."""
    def written(form: str):
        text = F.lit(form)
        for c in ("name", "artist", "guest", "hangul"):
            text = F.replace(text, F.lit("{" + c + "}"), F.col(c))
        return text

    titles = F.posexplode(F.array(*[written(f) for f in forms])).alias("form", "offered")
    return parts(spark, sf).select("*", titles)


def _twin(answers: list[tuple[str, ...]], columns: list[str]) -> str:
    """The answers of every part, one row per form."""
    rows = [f"SELECT track, {i} AS form, " + ", ".join(f"{v} AS {c}" for v, c in zip(row, columns)) + " FROM dressed" for i, row in enumerate(answers)]
    return f"WITH {PARTS} " + " UNION ALL ".join(rows)


def _tidy(c):
    return strip(F.regexp_replace(c, r"\s+", " "))


@PLANS.add(
    "mat_03_feature_credits",
    _twin([
        ("name", "name || ' (feat. ' || guest || ')'"), ("name", "name || ' [ft. ' || guest || ']'"),
        ("name || ' (Remix feat. ' || guest || ')'", "name || ' (Remix feat. ' || guest || ')'"), ("name", "name || ' featuring ' || guest"),
        ("name", "name || ' (prod. ' || guest || ')'"), ("name || ' (Live)'", "name || ' with ' || guest || ' (Live)'"), ("name || ' [Live]'", "name || ' [Live]'"),
    ], ["bare", "wanted_with_credit"]),
)
def feature_credits(spark, sf):
    """Credits go, unless their bracket names a version; a wanted title with a credit keeps them."""
    rows = dressed(spark, sf, [
        "{name} (feat. {guest})", "{name} [ft. {guest}]", "{name} (Remix feat. {guest})", "{name} featuring {guest}", "{name} (prod. {guest})",
        "{name} with {guest} (Live)", "{name} [Live]",
    ])
    o, wanted = F.col("offered"), F.concat("name", F.lit(" (feat. "), "guest", F.lit(")"))
    return rows.select(
        "track", "form", _tidy(M.without_feature_credits(o, F.col("name"))).alias("bare"), _tidy(M.without_feature_credits(o, wanted)).alias("wanted_with_credit")
    )


@PLANS.add(
    "mat_04_language_versions",
    _twin([
        ("name || ' (japanese ver)'", "name || ' japanese ver'"), ("name || ' (english ver.)'", "name || ' english ver'"),
        ("name || ' korean ver'", "name || ' korean ver'"), ("name", "name"), ("name", "name"), ("name", "name"), ("name || ' ' || hangul", "name || ' ' || hangul"),
    ], ["canonical", "normalized"]),
)
def language_versions(spark, sf):
    """Language versions in one spelling, soundtrack notes gone."""
    rows = dressed(spark, sf, [
        "{name} (Japanese Version)", "{name} (Eng Ver.)", "{name} KR Ver", "{name} | {guest} OST Part 2", "{name} (Original Soundtrack)", "{name}", "{name} {hangul}",
    ])
    o = F.col("offered")
    return rows.select("track", "form", _tidy(M.canonical_versions(o)).alias("canonical"), M.normalize_title(o).alias("normalized"))


@PLANS.add(
    "mat_07_remix_notes",
    _twin([
        ("g", "g || ' remix'", "name || ' (' || guest || ' Remix)'"), ("''", "'remix'", "name || ' [Remix]'"),
        ("''", "'live'", "artist || ' - ' || name || ' (Live)'"), ("g", "g || ' remix acoustic'", "name || ' (' || guest || ' Remix) [Acoustic]'"),
        ("''", "lower(artist) || ' remix'", "name || ' (' || artist || ' Remix)'"), ("''", "''", "name"),
    ], ["remixers", "suffix", "plain"]),
)
def remix_notes(spark, sf):
    """Remixers named in brackets, the words that name a version, and the title without other brackets."""
    rows = dressed(spark, sf, [
        "{name} ({guest} Remix)", "{name} [Remix]", "{artist} - {name} ({hangul}) (Live)", "{name} ({guest} Remix) [Acoustic]", "{name} ({artist} Remix)",
        "{name} ({hangul}) [{guest}]",
    ])
    o = F.col("offered")
    return rows.select(
        "track", "form", F.array_join(F.array_sort(M.remix_qualifiers(o, F.col("artist"))), " ").alias("remixers"), M.version_suffix(o).alias("suffix"),
        _tidy(M.without_plain_brackets(o)).alias("plain"),
    )


@PLANS.add(
    "mat_09_title_variants",
    "SELECT track, form, array_to_string(list_sort(list_distinct(string_split(v, '|'))), '|') AS variants FROM (" + _twin([
        ("name || '|' || name || ' ' || hangul || '|' || hangul",), ("name",), ("hangul || '|' || hangul || ' ' || name || '|' || name",),
        ("name || ' live|' || name || ' ' || hangul || ' live|' || hangul || ' live'",), ("name",),
    ], ["v"]) + ")",
)
def title_variants(spark, sf):
    """Readings of titles with a bracketed Hangul name, with quotes, and in two scripts."""
    rows = dressed(spark, sf, [
        "{artist} - {name} ({hangul}) MV", "{artist} '{name}' Official Audio", "{hangul} {name}", "{name} ({hangul}) (Live)", '{artist} "{name}" MV',
    ])
    wanted = F.when(F.col("form") == 3, F.concat("name", F.lit(" (Live)"))).otherwise(F.col("name"))
    rows = M.with_version_conflict(rows.withColumn("wanted", wanted), "wanted", "offered", "artist")
    rows = M.with_title_variants(rows, "offered", "artist", "wanted", "version_conflict")
    return rows.select("track", "form", F.array_join(F.array_sort("variants"), "|").alias("variants"))


@PLANS.add(
    "mat_09_bilingual_aliases",
    f"""WITH {PARTS}, b AS (SELECT a.track, a.hangul, n.hangul AS next, a.name = n.name AS same FROM dressed a LEFT JOIN dressed n ON n.track = a.track + 1)
    SELECT track, array_to_string(list_sort([hangul, hangul || '요'] || CASE WHEN same THEN [next] ELSE [] END), ',') AS aliases FROM b""",
)
def bilingual_aliases(spark, sf):
    """Hangul names of each part over all its candidates; one of them is the next part's title."""
    own = dressed(spark, sf, ["{artist} - {name} ({hangul}) MV", "{hangul}요 ({name})", "'{name}' Official Audio", "{guest} Documentary ({hangul})", "{name} ({guest})"])
    after = parts(spark, sf).select((F.col("track") - 1).alias("track"), F.concat("name", F.lit(" ("), "hangul", F.lit(") [HD]")).alias("offered"))
    rows = own.select("track", "name", "artist", "offered")
    # sizes guessed from the file's bytes would send the whole table to the driver
    after = scale.spread_for_cpu(after, "track").hint("merge")
    rows = rows.unionByName(rows.select("track", "name", "artist").distinct().join(after, "track"))
    found = matching.alias_lists(rows, matching.alias_table(rows, "track", F.col("offered"), F.col("artist")), "track", "name")
    return found.select("track", F.array_join("_aliases", ",").alias("aliases"))


@PLANS.add(
    "mat_13_identity_evidence",
    f"""WITH {CANDIDATES}, c AS (SELECT * REPLACE (CASE WHEN track % 10 = 0 THEN 'Jungkook' WHEN track % 10 = 1 THEN '' ELSE artist END AS artist,
      CASE WHEN track % 20 = 0 THEN 'HYBE LABELS' ELSE channel END AS channel) FROM candidates),
    n AS (SELECT *, lower(artist) AS a, {_sql_norm('video_title')} AS v, {_sql_norm('channel')} AS cn, replace({_sql_norm('channel')}, ' topic', '') AS cc FROM c),
    e AS (SELECT *, a = cn OR a = cc AS exact, contains(' ' || cn || ' ', ' ' || a || ' ') OR (length(replace(a, ' ', '')) >= 5 AND contains(replace(cn, ' ', ''), replace(a, ' ', ''))) AS within,
      contains(' ' || v || ' ', ' ' || a || ' ') OR (length(replace(a, ' ', '')) >= 5 AND contains(replace(v, ' ', ''), replace(a, ' ', ''))) AS titled FROM n)
    SELECT track, candidate_number, CASE WHEN a = '' THEN '' ELSE concat_ws(',', CASE WHEN exact THEN 'exact_channel_artist' END,
      CASE WHEN (exact AND contains(channel, 'Topic')) OR (NOT exact AND (within OR (a = 'jungkook' AND channel = 'HYBE LABELS'))) THEN 'artist_in_channel' END,
      CASE WHEN titled THEN 'artist_in_title' END) END AS evidence FROM e""",
)
def identity_evidence(spark, sf):
    """Channel and title evidence; some artists are known by their agency's channel, some are unknown."""
    rows = candidates(spark, sf)
    digit = F.col("track") % 10
    rows = rows.withColumn("artist", F.when(digit == 0, "Jungkook").when(digit == 1, "").otherwise(F.col("artist")))
    rows = rows.withColumn("channel", F.when(F.col("track") % 20 == 0, "HYBE LABELS").otherwise(F.col("channel")))
    c = F.col("channel")
    normal = rows.select(
        "track", "candidate_number", "channel", M.normalize_title(F.col("artist")).alias("a"), M.normalize_title(F.col("video_title")).alias("v"),
        M.normalize_title(c).alias("cn"), M.channel_artist(c).alias("cc"),
    )
    evidence = M.identity_evidence(F.col("a"), F.col("v"), c, F.col("cn"), F.col("cc"))
    return normal.select("track", "candidate_number", F.array_join(evidence, ",").alias("evidence"))
