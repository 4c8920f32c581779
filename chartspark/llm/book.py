"""Queries of the subpackage on the driver's tables, with SQL twins where SQL can express the operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.llm import chat, decontaminate, exact_dedup, fill_middle, language, licenses, mixing, near_dedup, pii, prefix_trie, quality, secrets, token_files
from chartspark.plans.book import PlanBook

PLANS = PlanBook()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@PLANS.add("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"))


def _held_out() -> Column:
    """Documents whose crc32 leaves 2 are kept out of training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def language_model(docs: DataFrame) -> language.Model:
    return language.train(docs.where(~_held_out()))


@PLANS.add("op5_language_spans")
def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language_model(docs))
    return found.select("doc_id", _held_out().alias("held_out"), F.col("lang").alias("lang_pred"), "score", F.size("spans").cast("long").alias("n_spans"))


def joined(parts: Column) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(parts, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@PLANS.add("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_ASCII}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@PLANS.add("op8_benchmark_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS run FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT k FROM sized),
doc_windows AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS run FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, k, i FROM doc_windows JOIN item_windows USING (k, run)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit_words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hit_items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hit_items.ids, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
""")
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@PLANS.add("op10_token_planes")
def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_files.read_documents(spark, folder)


@PLANS.add("op3_streaming_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op3_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("digest", "text_sha256")


@PLANS.add("op9_curriculum_mix", """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h FROM documents),
s AS (SELECT source, size, place, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * size AS stop
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source)),
-- sources reach their stop in the order of stop per weight; the level is that of the first set that stays as it is
r AS (SELECT *, coalesce(sum(stop) OVER lower_ones, 0) AS used, sum(weight) OVER all_ones - coalesce(sum(weight) OVER lower_ones, 0) AS open_weight, sum(size) OVER all_ones AS total, row_number() OVER (ORDER BY stop / weight, place) AS k
      FROM s WINDOW lower_ones AS (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), all_ones AS ()),
l AS (SELECT arg_min((1.5::DOUBLE * total - used) / open_weight, k) AS level FROM r WHERE (1.5::DOUBLE * total - used) / open_weight < stop / weight),
g AS (SELECT source, size AS source_size, least(stop, coalesce(level, 0) * weight) AS target FROM s, l),
c AS (SELECT doc_id, d.source, d.size, source_size, target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * CASE WHEN source_size > 0 THEN greatest(0, least(2, ceil((target - (before + size / 2)) / source_size))) ELSE 0 END AS BIGINT) AS taken
FROM c
""")
def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    names = {"_mix_size": "size", "_mix_source_size": "source_size", "_mix_target": "target", "_mix_taken": "taken"}
    return mixing.dealt(docs).select("doc_id", *[F.col(c).alias(n) for c, n in names.items()])


@PLANS.add("op2_bootstrapped_pii")
def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@PLANS.add("op1_license_sentences", licenses.scan_sql())
def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.array_join(c, ",").alias(n) for c, n in (("sentences", "sentences"), ("licenses", "licenses"), ("open", "open_sentences"))])


_OWN_CONVERSATION = """
    SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
    UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]'"""


@PLANS.add("op6_chat_tokens")
def op6_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(_OWN_CONVERSATION))
    formatted = scale.cut_lineage(chat.format_turns(turns, tokenizer_path()))
    return chat.read_back(formatted, tokenizer_path())


def _kept_from_training() -> Column:
    """Documents whose crc32 leaves 0 by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_field(docs: DataFrame, labels: DataFrame) -> quality.Field:
    return quality.train(docs.where(~_kept_from_training()), labels)


@PLANS.add("op11_line_field_quality")
def op11_line_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_field(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _kept_from_training().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@PLANS.add("op12_piece_table_fim", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT doc_id, text, w, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def op12_piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.samples(table(spark, sf_dir, "documents"))
    back = fill_middle.restored_sha256(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


# crc32 of the decimal digits, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


@PLANS.add("op13_radix_prefix_trie", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), length(text)) AS turns FROM t GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
      FROM (SELECT conv_id, turns, {_CRC} % 6 AS h FROM own) o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
m AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS ended FROM m),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM k GROUP BY path, depth),
below AS (SELECT p.path, count(c.path) AS n_children FROM node p LEFT JOIN node c ON c.depth = p.depth + 1 AND c.path[1:p.depth] = p.path GROUP BY p.path),
own_sum AS (SELECT node.*, n_children, (n_children = 0)::INT AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS save FROM node JOIN below USING (path)),
up AS (SELECT path[1:d] AS path, sum(leaf) AS n_leaves, sum(save) AS saved_tokens FROM (SELECT path, leaf, save, unnest(range(0, depth + 1)) AS d FROM own_sum) GROUP BY 1)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(s.n_convs AS BIGINT) AS n_convs, CAST(s.n_children AS BIGINT) AS n_children,
       CAST(up.n_leaves AS BIGINT) AS n_leaves, CAST(up.saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
FROM own_sum s JOIN up USING (path) LEFT JOIN node p ON p.depth = s.depth - 1 AND p.path = s.path[1:s.depth - 1]
""")
def op13_radix_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))
