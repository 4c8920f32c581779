"""Lyric text queries on the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions import text as X
from chartspark.functions.language_rules import EDGE_MARKS, PRONOUNS, TITLE_STOPWORDS
from chartspark.operators import detector, sections
from chartspark.operators.chart import top_positions
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook
from chartspark.sources import readers

PLANS = PlanBook()


def documents(spark, sf):
    """Documents with a title made of their words two to four, one of them tagged and cased differently."""
    docs = S.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    title = F.concat(F.lit("[Remix] "), F.upper(F.array_join(F.slice(F.split("text", " "), 2, 3), " ")))
    return docs.withColumn("title", title)


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_MARKS = "".join("\\" + m if m in "[]-^" else m for m in EDGE_MARKS).replace("'", "''")
_WORD = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"


def _tokens(body: str) -> str:
    return (
        rf"list_filter(list_transform(regexp_extract_all(regexp_replace({body}, '\[[^\]]*\]', ' ', 'g'), '{_WORD}'), "
        rf"lambda t: replace(regexp_replace(lower(t), '^[{_MARKS}]+|[{_MARKS}]+$', '', 'g'), 'ß', 'ss')), "
        rf"lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))"
    )


_STOP = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in TITLE_STOPWORDS.items() if k in ("en", "es")) + " END"
_PRON = "CASE lang " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in PRONOUNS.items() if k in ("en", "es")) + " END"

TOKENS = rf"""docs AS (SELECT doc_id, lang, nfc_normalize(text) AS text,
  '[Remix] ' || upper(array_to_string(list_slice(string_split(text, ' '), 2, 4), ' ')) AS title FROM documents),
tok AS (SELECT doc_id, lang, text, {_tokens("text")} AS tokens, {_tokens("title")} AS title_tokens,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS trimmed, {_STOP} AS stop, {_PRON} AS pron FROM docs)"""


@PLANS.add(
    "txt_03_tokenize",
    f"""WITH {TOKENS} SELECT doc_id, len(tokens) AS n_tokens, array_to_string(list_slice(tokens, 1, 5), ' ') AS head,
    md5(array_to_string(tokens, ' ')) AS digest FROM tok""",
)
def tokenize(spark, sf):
    docs = documents(spark, sf).withColumn("t", X.tokenize(X.normalize_text(X.nfc("text")), "language"))
    return docs.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("head"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


@PLANS.add(
    "txt_04_punctuation_ratio",
    rf"""SELECT doc_id, CAST(len(regexp_extract_all(t, '\p{{P}}')) AS BIGINT) AS marks, round(len(regexp_extract_all(t, '\p{{P}}')) / length(t), 6) AS ratio
    FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""",
)
def punctuation(spark, sf):
    """A blank text has no characters to divide by: its ratio is NaN, as in SQL; a NULL text has none."""
    docs = S.table(spark, sf, "documents").select("doc_id", X.strip("text").alias("t"))
    marks, chars = X.punctuation_count(F.col("t")), F.length("t")
    # the choice is made in the divisor: inside a branch the marks would be counted a second time
    chars = F.when(chars == 0, F.lit(float("nan"))).otherwise(chars)
    return docs.select("doc_id", marks.cast("bigint").alias("marks"), F.round(marks / chars, 6).alias("ratio"))


@PLANS.add(
    "txt_05_title_words",
    f"""WITH {TOKENS} SELECT doc_id, CASE WHEN lang IN ('en', 'es') AND len(tokens) > 0 AND len(content) > 0 THEN list_has_any(content, tokens) END AS title_in_text
    FROM (SELECT *, list_filter(title_tokens, lambda t: NOT list_contains(coalesce(stop, ['']), t) AND regexp_matches(t, '\\p{{L}}')) AS content FROM tok)""".replace("\\\\p", "\\p"),
)
def title_words(spark, sf):
    docs = documents(spark, sf)
    base = docs.select(
        "doc_id", "language", X.tokenize(X.normalize_text(X.nfc("text")), "language").alias("t"),
        X.title_content("title", "language").alias("c"),
    )
    ok = F.col("language").isin("en", "es") & (F.size("t") > 0) & (F.size("c") > 0)
    return base.select("doc_id", F.when(ok, F.arrays_overlap("c", "t")).alias("title_in_text"))


@PLANS.add(
    "txt_06_pronoun_ratio",
    f"""WITH {TOKENS} SELECT doc_id, CASE WHEN pron IS NOT NULL AND len(tokens) > 0 THEN round(len(list_filter(tokens, lambda t: list_contains(pron, t))) / len(tokens), 6) END AS pronoun_ratio FROM tok""",
)
def pronoun_ratio(spark, sf):
    base = documents(spark, sf).select("doc_id", "language", X.tokenize(X.normalize_text(X.nfc("text")), "language").alias("t"))
    n = F.size("t")
    return base.select("doc_id", F.when(n > 0, F.round(X.pronoun_tokens(F.col("t"), "language") / n, 6)).alias("pronoun_ratio"))


@PLANS.add(
    "src_11_rules_from_file",
    f"""WITH {TOKENS}, words AS (SELECT lang, word, COUNT(*) AS n FROM (SELECT lang, unnest(tokens) AS word FROM tok) WHERE regexp_matches(word, '^[a-z]+$') GROUP BY 1, 2),
    listed AS (SELECT lang, list(word) AS pron FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM words) WHERE place <= 20 GROUP BY 1)
    SELECT doc_id, len(list_filter(tokens, lambda t: list_contains(l.pron, t))) AS listed_words, CASE WHEN len(tokens) > 0 THEN round(len(list_filter(tokens, lambda t: list_contains(l.pron, t))) / len(tokens), 6) END AS listed_ratio
    FROM tok JOIN listed l ON l.lang = tok.lang""",
)
def rules_from_file(spark, sf):
    """A rule file with the twenty commonest words of each language as its pronouns is written, read and applied."""
    base = scale.enough_partitions(documents(spark, sf).select("doc_id", "language", "text")).select("doc_id", "language", X.tokenize(X.nfc("text"), "language").alias("t"))
    words = base.select("language", F.explode("t").alias("word")).where(F.col("word").rlike("^[a-z]+$") & F.col("language").isNotNull())
    counts = words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    best = top_positions(counts, ["language"], [F.desc("n"), F.asc("word")], 20, out="place").groupBy("language").agg(F.array_sort(F.collect_list("word")).alias("words"))
    path = f"{scale.shared_folder(spark)}/rules-{uuid.uuid4().hex}"
    best.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "words")))).alias("pronouns")).coalesce(1).write.json(path)
    rules = readers.read_lyric_rules(spark, path)
    n, hits = F.size("t"), X.pronoun_tokens(F.col("t"), "language", rules)
    return base.where("language is not null").select("doc_id", hits.cast("bigint").alias("listed_words"), F.when(n > 0, F.round(hits / n, 6)).alias("listed_ratio"))


_BASIC = f"""WITH {TOKENS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS word_count, CAST(len(list_distinct(tokens)) AS BIGINT) AS unique_word_count,
    round(len(list_distinct(tokens)) / len(tokens), 6) AS lexical_diversity, round((len(tokens) - len(list_distinct(tokens))) / len(tokens), 6) AS repetition_ratio,
    round(list_sum(list_transform(tokens, lambda t: length(t))) / len(tokens), 6) AS avg_word_length,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS line_count FROM tok"""


@PLANS.add("txt_07_word_features", _BASIC)
def word_features(spark, sf):
    out = X.lyric_features(documents(spark, sf), "text", "title", "language", chorus=False)
    return out.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("word_count", "unique_word_count", "line_count")],
        *[F.round(c, 6).alias(c) for c in ("lexical_diversity", "repetition_ratio", "avg_word_length")],
    )


@PLANS.add("txt_08_chorus_repetition")
def chorus(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", X.nfc("text").alias("text"))
    return X.with_chorus_repetition(docs, "text", "chorus_repetition_count").drop("text")


def _section_words(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", sections.section_tokens("text").alias("tokens"))


@PLANS.add(
    "txt_09_section_runs",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '\[[^\]]*\]', ' ', 'g'), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM documents),
    g AS (SELECT doc_id, i - 1 AS pos, array_to_string(t[i : i + 2], ' ') AS seed FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= 16)),
    linked AS (SELECT doc_id, pos, MIN(pos) OVER (PARTITION BY doc_id, seed ORDER BY pos RANGE BETWEEN 8 FOLLOWING AND UNBOUNDED FOLLOWING) - pos AS d FROM g),
    islands AS (SELECT doc_id, d, pos, pos - row_number() OVER (PARTITION BY doc_id, d ORDER BY pos) AS island FROM linked WHERE d IS NOT NULL)
    SELECT doc_id, CAST(d AS INTEGER) AS "offset", CAST(MIN(pos) AS INTEGER) AS start, CAST(COUNT(*) + 2 AS INTEGER) AS words FROM islands GROUP BY doc_id, d, island""",
)
def section_runs(spark, sf):
    return sections.section_runs(_section_words(spark, sf), "doc_id", "tokens").drop("n")


@PLANS.add("txt_09_repeated_sections")
def repeated_sections(spark, sf):
    return sections.section_repetition(_section_words(spark, sf), "doc_id", "tokens")


@PLANS.add("txt_07_all_features")
def all_features(spark, sf):
    out = X.lyric_features(documents(spark, sf), "text", "title", "language")
    return out.drop("text", "title")


@PLANS.add(
    "txt_10_clean_lines",
    r"""WITH l AS (SELECT page_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM (SELECT page_id, unnest(string_split(replace(html, '<p>', chr(10)), chr(10))) AS x FROM pages)),
    m AS (SELECT page_id, CASE WHEN regexp_matches(x, '(?i)^\s*\[(?:verse|pre-chorus|chorus|post-chorus|bridge|intro|outro|hook|refrain|instrumental|interlude|break|part|spoken)[^\]]*\]\s*$') THEN '' ELSE x END AS x FROM l),
    n AS (SELECT page_id, regexp_replace(x, '\[([^\]]+)\]\([^)]*\)', '\1', 'g') AS x FROM m),
    o AS (SELECT page_id, regexp_replace(x, '(?i)https?://\S+|www\.\S+', '', 'g') AS x FROM n),
    p AS (SELECT page_id, regexp_replace(regexp_replace(x, '\[([^\]]+)\]', '\1', 'g'), '^\s+|\s+$', '', 'g') AS x FROM o)
    SELECT page_id, COUNT(*) AS n_lines, CAST(SUM(length(x)) AS BIGINT) AS n_chars FROM p WHERE x <> '' GROUP BY 1""",
)
def clean_lines(spark, sf):
    pages = S.table(spark, sf, "pages").select("page_id", X.clean_lines(F.replace("html", F.lit("<p>"), F.lit("\n"))).alias("lines"))
    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x))
    return pages.where(F.size("lines") > 0).select("page_id", F.size("lines").cast("bigint").alias("n_lines"), chars.alias("n_chars"))


@PLANS.add(
    "txt_11_script_counts",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]')) AS BIGINT) AS latin,
    CAST(len(regexp_extract_all(text, '[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}]')) AS BIGINT) AS ko,
    CAST(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) AS BIGINT) AS zh FROM documents""",
)
def script_counts(spark, sf):
    t = F.col("text")
    return S.table(spark, sf, "documents").select(
        "doc_id", X.latin_count(t).cast("bigint").alias("latin"),
        *[X.class_count(t, X.SCRIPTS[n]).cast("bigint").alias(n) for n in ("ko", "zh")],
    )


def _script_sql(chars: str) -> str:
    return f"CAST(len(regexp_extract_all(line, '[{chars}]')) AS BIGINT)"


def _lines_sql() -> str:
    """Clean lines of documents, word weights and the language of every line."""
    langs = ["de", "en", "es", "fr"]
    sums = ", ".join(f"round(SUM(k * ln((coalesce(c.{n}, 0) + 1) / (t.{n} + t.size))), 9) AS {n}" for n in langs)
    best = " ".join(f"WHEN {n} = greatest({', '.join(langs)}) THEN '{n}'" for n in langs)
    tag = r"(?i)^\s*\[(?:verse|pre-chorus|chorus|post-chorus|bridge|intro|outro|hook|refrain|instrumental|interlude|break|part|spoken)[^\]]*\]\s*$"
    return rf"""raw AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(CASE WHEN regexp_matches(x, '{tag}') THEN '' ELSE regexp_replace(x, '^\s+|\s+$', '', 'g') END,
        '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?i)https?://\S+|www\.\S+', '', 'g'), '\[([^\]]+)\]', '\1', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM documents),
    lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_no FROM raw),
    scripts AS (SELECT *, {_script_sql("A-Za-zÀ-ÖØ-öø-ÿ")} AS latin, {_script_sql(r"\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}")} AS ko,
      {_script_sql(r"\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9d}")} AS ja, {_script_sql(r"\x{4e00}-\x{9fff}")} AS zh FROM lines),
    facts AS (SELECT *, ko + ja + zh AS total, CASE WHEN ko + ja + zh = 0 OR greatest(ko, ja, zh) < 0.6 * (ko + ja + zh) THEN NULL
      WHEN ko = greatest(ko, ja, zh) THEN 'ko' WHEN ja = greatest(ja, zh) THEN 'ja' ELSE 'zh' END AS script FROM scripts),
    vocabulary AS (SELECT word, {", ".join(f"COUNT(*) FILTER (WHERE lang = '{n}') AS {n}" for n in langs)} FROM
      (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS word FROM documents WHERE lang IS NOT NULL) WHERE word <> '' GROUP BY 1),
    t AS (SELECT {", ".join(f"SUM({n}) AS {n}" for n in langs)}, COUNT(*) AS size FROM vocabulary),
    words AS (SELECT doc_id, line_no, word, COUNT(*) AS k FROM (SELECT doc_id, line_no, unnest(regexp_split_to_array(lower(line), '[^\p{{L}}]+')) AS word
      FROM facts WHERE script IS NULL AND (latin >= 15 OR total >= 15)) GROUP BY 1, 2, 3),
    scored AS (SELECT doc_id, line_no, CASE {best} END AS guess FROM (SELECT doc_id, line_no, {sums} FROM words JOIN vocabulary c USING (word), t GROUP BY 1, 2)),
    told AS (SELECT f.doc_id, f.line_no, latin, ko, ja, zh, total, coalesce(script, guess) AS lang FROM facts f LEFT JOIN scored s ON s.doc_id = f.doc_id AND s.line_no = f.line_no)"""


def _document_sql() -> str:
    """Language and shares of every document from the languages of its lines."""
    names = ["ko", "ja", "zh", "de", "en", "es", "fr"]
    share = lambda n, of: f"CASE WHEN {n} > 0 THEN '\"{n[2:]}\":\"' || printf('%.4f', round_even({n} / {of}, 4)) || '\"' END"
    top = "greatest(" + ", ".join(f"v_{n}" for n in names) + ")"
    first = "CASE " + " ".join(f"WHEN v_{n} = {top} THEN '{n}'" for n in names) + " END"
    strong = " + ".join(f"CAST(v_{n} >= 0.3 * total AS INTEGER)" for n in names)
    votes = ", ".join(f"coalesce(SUM(latin + total) FILTER (WHERE l.lang = '{n}' AND latin + total >= 15), 0) AS v_{n}" for n in names)
    return f"""{_lines_sql()},
    votes AS (SELECT d.doc_id, {votes}, {", ".join(f"coalesce(SUM({n}), 0) AS s_{n}" for n in names[:3])}, coalesce(SUM(latin), 0) AS s_latin_other
      FROM documents d LEFT JOIN told l ON l.doc_id = d.doc_id GROUP BY 1),
    whole AS (SELECT *, {" + ".join(f"v_{n}" for n in names)} AS total, s_ko + s_ja + s_zh + s_latin_other AS letters, greatest(s_ko, s_ja, s_zh) AS top_script FROM votes),
    ruled AS (SELECT *, letters >= 15 AND top_script > 0 AND top_script >= 0.7 * letters AS by_script FROM whole),
    labelled AS (SELECT doc_id, CASE WHEN total > 0 AND {top} >= 0.7 * total THEN {first} WHEN total > 0 AND {strong} >= 2 THEN 'mixed' WHEN total > 0 THEN {first}
      WHEN by_script THEN CASE WHEN s_ko = top_script THEN 'ko' WHEN s_ja = top_script THEN 'ja' ELSE 'zh' END ELSE 'unknown' END AS language,
      '{{' || CASE WHEN total > 0 THEN concat_ws(',', {", ".join(share(f"v_{n}", "total") for n in names)})
      WHEN by_script THEN concat_ws(',', {", ".join(share(n, "letters") for n in ("s_ko", "s_ja", "s_zh", "s_latin_other"))}) ELSE '' END || '}}' AS shares FROM ruled)"""


def _model(spark, sf):
    docs = S.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return docs, detector.word_weights(docs, "text", "lang"), detector.languages_of(docs, "lang")


def _detected(spark, sf):
    docs, weights, names = _model(spark, sf)
    return detector.document_languages(docs, "doc_id", "text", weights, names)


@PLANS.add("txt_12_line_language", f"WITH {_lines_sql()} SELECT doc_id, line_no, lang AS line_language FROM told")
def line_language(spark, sf):
    docs, weights, names = _model(spark, sf)
    out = detector.line_languages(docs, "doc_id", "text", weights, names)
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line_language")


@PLANS.add("txt_13_document_language", f"WITH {_document_sql()} SELECT doc_id, language, shares FROM labelled")
def document_language(spark, sf):
    shown = F.transform_values("shares", lambda _, share: F.format_string("%.4f", share))
    return _detected(spark, sf).select("doc_id", "language", F.to_json(shown).alias("shares"))


@PLANS.add(
    "txt_14_language_changes",
    f"""WITH {_document_sql()} SELECT d.doc_id, d.lang AS old, l.language AS new FROM documents d JOIN labelled l ON l.doc_id = d.doc_id
    WHERE d.lang IS DISTINCT FROM l.language""",
)
def language_changes(spark, sf):
    old = S.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    return X.language_changes(old, _detected(spark, sf), "doc_id")


@PLANS.add(
    "txt_15_search_result_filter",
    """WITH r AS (SELECT a.p_partkey, lower(a.p_name) AS t, lower(a.p_brand) AS ar,
      lower(CASE a.p_partkey % 4 WHEN 0 THEN b.p_name || ' Remix' WHEN 1 THEN a.p_name || ' deluxe' ELSE b.p_name END) AS rt,
      lower(CASE WHEN a.p_partkey % 3 = 0 THEN b.p_brand ELSE a.p_brand || ' official' END) AS ra
      FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size)
    SELECT p_partkey, NOT contains(rt, 'remix') AND (contains(rt, t) OR contains(t, rt)) AND (contains(ra, ar) OR contains(ar, ra)) AS original FROM r""",
)
def search_result_filter(spark, sf):
    part = S.table(spark, sf, "part")
    a = part.select("p_partkey", "p_name", "p_brand", (F.col("p_partkey") + F.col("p_size")).alias("other"))
    b = part.select(F.col("p_partkey").alias("other"), F.col("p_name").alias("b_name"), F.col("p_brand").alias("b_brand"))
    key = F.col("p_partkey")
    rt = F.when(key % 4 == 0, F.concat("b_name", F.lit(" Remix"))).when(key % 4 == 1, F.concat("p_name", F.lit(" deluxe"))).otherwise(F.col("b_name"))
    ra = F.when(key % 3 == 0, F.col("b_brand")).otherwise(F.concat("p_brand", F.lit(" official")))
    return a.join(b, "other").select("p_partkey", X.is_original_song(rt, ra, F.col("p_name"), F.col("p_brand")).alias("original"))


@PLANS.add(
    "txt_16_count_features_with_status",
    f"""SELECT b.doc_id, CASE WHEN l.quality IS NULL THEN 'not_found' WHEN l.quality = 0 THEN 'not_attempted' WHEN b.word_count = 0 THEN 'failed'
      WHEN d.lang IN ('de', 'fr') THEN 'language_limited' ELSE 'success' END AS status, b.word_count, b.repetition_ratio, b.avg_word_length, b.line_count
    FROM ({_BASIC}) b JOIN documents d ON d.doc_id = b.doc_id LEFT JOIN labels l ON l.doc_id = b.doc_id""",
)
def count_features_with_status(spark, sf):
    docs = documents(spark, sf)
    labels = S.table(spark, sf, "labels").select("doc_id", "quality")
    state = F.when(F.col("quality").isNull(), "not_found").when(F.col("quality") == 1, "success").otherwise("collected")
    out = X.lyric_features(docs, "text", "title", "language", chorus=False).join(labels, "doc_id", "left")
    status, _ = X.extraction_status(
        F.col("doc_id"), F.lit(False), state, F.lit("x.txt"), F.col("text"), F.col("word_count"), F.col("language")
    )
    return out.select(
        "doc_id", status.alias("status"), F.col("word_count").cast("bigint").alias("word_count"),
        F.round("repetition_ratio", 6).alias("repetition_ratio"), F.round("avg_word_length", 6).alias("avg_word_length"),
        F.col("line_count").cast("bigint").alias("line_count"),
    )
