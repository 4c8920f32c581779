"""Chart-shaped tables derived from the driver tables, as DataFrames and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspark.functions.clean import chart_thursday, quarter_label
from chartspark.operators import chart

MARKETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_market(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("market"))
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "market")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    # nations and regions are a fixed number of rows; suppliers grow and are never the broadcast side
    return supplier.join(F.broadcast(places), supplier.s_nationkey == places.n_nationkey).select("s_suppkey", "market")


def line_market(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Line items with their market; they are dealt by supplier but not ordered, and meet a table of the task's suppliers."""
    line = table(spark, sf, "lineitem").select("l_suppkey", *columns)
    where = supplier_market(spark, sf).hint("shuffle_hash")
    return line.join(where, line.l_suppkey == where.s_suppkey).drop("l_suppkey", "s_suppkey")


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    sales = line_market(spark, sf, "l_partkey", "l_shipdate", "l_extendedprice").select(
        F.col("l_partkey").alias("track"),
        "market",
        chart_thursday("l_shipdate").alias("chart_date"),
        F.floor("l_extendedprice").alias("amount"),
    )
    return chart.weekly_ranking(sales, "track", "market", "chart_date", "amount")


WEEKLY = """line_market AS (
  SELECT l.*, r_name AS market FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
week_sales AS (
  SELECT l_partkey AS track, market, CAST(date_trunc('week', l_shipdate) AS DATE) + 3 AS chart_date,
         CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS streams
  FROM line_market GROUP BY 1, 2, 3),
weekly AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, chart_date ORDER BY streams DESC, track) AS rank
                 FROM week_sales) WHERE rank <= 200)"""


def perf(spark: SparkSession, sf: str, weeks: DataFrame | None = None) -> DataFrame:
    return chart.chart_performance(weekly(spark, sf) if weeks is None else weeks, "track")


PERF = WEEKLY + """,
perf AS (
  SELECT track, market, AVG(rank) AS lifetime_average_rank, MIN(rank) AS peak_rank, COUNT(*) AS weeks_on_chart,
         COUNT(*) FILTER (WHERE rank BETWEEN 1 AND 10) AS weeks_in_top10, 101 - AVG(rank) AS chart_score
  FROM weekly GROUP BY 1, 2)"""


def songs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    day = F.date_add(F.lit("2000-01-01").cast("date"), ((key * 37) % 7300).cast("int"))
    return table(spark, sf, "part").select(
        key.alias("track"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.when(key % 11 != 0, day).alias("release_date"),
    )


SONGS = """songs AS (
  SELECT p_partkey AS track, p_name AS title, p_brand AS artist, p_type AS album,
         CASE WHEN p_partkey % 11 <> 0 THEN DATE '2000-01-01' + CAST((p_partkey * 37) % 7300 AS INTEGER) END AS release_date
  FROM part)"""


def audio(spark: SparkSession, sf: str) -> DataFrame:
    """One row of numeric features per track; some tracks have none."""
    line = table(spark, sf, "lineitem")
    key = F.col("track")
    return (
        line.where(F.col("l_partkey") % 9 != 0)
        .groupBy(F.col("l_partkey").alias("track"))
        .agg(
            F.avg("l_quantity").alias("tempo_bpm"),
            F.stddev_pop("l_quantity").alias("beat_interval_variability"),
            F.avg("l_discount").alias("rms_energy"),
            F.stddev_pop("l_discount").alias("rms_variability"),
            (F.avg("l_extendedprice") / 100).alias("spectral_centroid"),
            (F.avg("l_tax") * 100).alias("chord_change_rate"),
        )
        .withColumn("audio_mode", F.when(key % 7 != 0, F.when(key % 2 == 0, "major").otherwise("minor")))
        .withColumn("mapping_id", key * 10 + 1)
    )


AUDIO = """audio AS (
  SELECT l_partkey AS track, AVG(l_quantity) AS tempo_bpm, stddev_pop(l_quantity) AS beat_interval_variability,
         AVG(l_discount) AS rms_energy, stddev_pop(l_discount) AS rms_variability,
         AVG(l_extendedprice) / 100 AS spectral_centroid, AVG(l_tax) * 100 AS chord_change_rate,
         CASE WHEN l_partkey % 7 <> 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'major' ELSE 'minor' END END AS audio_mode,
         l_partkey * 10 + 1 AS mapping_id
  FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY l_partkey)"""


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate rows of a track: the second part key digit says which one was chosen."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("track"),
        (F.col("p_partkey") * 10 + 1).alias("mapping_id"),
        (F.col("p_size") % 3 != 0).alias("is_selected"),
        F.concat(F.lit("v"), (F.col("p_partkey") * 3).cast("string")).alias("video_id"),
    )


MAPPING = """mapping AS (
  SELECT p_partkey AS track, p_partkey * 10 + 1 AS mapping_id, p_size % 3 <> 0 AS is_selected,
         'v' || CAST(p_partkey * 3 AS VARCHAR) AS video_id FROM part)"""


def lyric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row of text counts per document; quality labels stand for the partly missing counts."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    labels = table(spark, sf, "labels")
    words = F.col("words")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    n, u = F.col("word_count"), F.col("unique_word_count")
    return (
        # an exploded value is made once; a plain column would be cut again for each count and filter
        docs.select("*", F.explode(F.array(F.split(F.trim("text"), r"\s+"))).alias("words")).select(
            F.col("doc_id").alias("track"),
            F.size(words).alias("word_count"),
            F.size(F.array_distinct(words)).alias("unique_word_count"),
            lines.alias("line_count"),
            F.col("lang").alias("language"),
            F.col("n_chars"),
        )
        .join(labels.withColumnRenamed("doc_id", "track").hint("merge"), "track", "left")
        .select(
            "track",
            "word_count",
            "unique_word_count",
            (u / n).alias("lexical_diversity"),
            ((n - u) / n).alias("repetition_ratio"),
            (F.col("n_chars") / n).alias("avg_word_length"),
            "line_count",
            F.col("quality").alias("chorus_repetition_count"),
            (F.col("toxic") == 1).alias("title_word_in_lyrics"),
            "language",
            F.when(F.col("track") % 13 == 0, "not_found").otherwise("success").alias("lyrics_status"),
        )
    )


LYRICS = r"""lyric_words AS (
  SELECT doc_id, lang, n_chars, regexp_split_to_array(trim(text), '\s+') AS words,
         len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS line_count FROM documents),
lyric_rows AS (
  SELECT d.doc_id AS track, CAST(len(words) AS INTEGER) AS word_count,
         CAST(len(list_distinct(words)) AS INTEGER) AS unique_word_count,
         len(list_distinct(words)) / len(words) AS lexical_diversity,
         (len(words) - len(list_distinct(words))) / len(words) AS repetition_ratio,
         n_chars / len(words) AS avg_word_length, CAST(line_count AS INTEGER) AS line_count,
         quality AS chorus_repetition_count, toxic = 1 AS title_word_in_lyrics, lang AS language,
         CASE WHEN d.doc_id % 13 = 0 THEN 'not_found' ELSE 'success' END AS lyrics_status
  FROM lyric_words d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def quarter_rank(spark: SparkSession, sf: str, weeks: DataFrame | None = None) -> DataFrame:
    dated = (weekly(spark, sf) if weeks is None else weeks).withColumn("quarter", quarter_label("chart_date"))
    return chart.best_rank(dated.where("quarter is not null"), ["market", "quarter", "track"])


QUARTER = WEEKLY + """,
quarter_rank AS (
  SELECT market, CAST(year(chart_date) AS VARCHAR) || '-Q' || CAST(quarter(chart_date) AS VARCHAR) AS quarter, track,
         MIN(rank) AS rank FROM weekly GROUP BY 1, 2, 3)"""


def sample(spark: SparkSession, sf: str, weeks: DataFrame | None = None) -> DataFrame:
    picked = chart.stratified_sample(quarter_rank(spark, sf, weeks), "track", ["market", "quarter"], seed=SEED)
    return picked.select(
        "track", "market", F.substring("quarter", 1, 4).cast("int").alias("year"), "quarter", "rank_stratum", "sampled"
    )


SAMPLE = QUARTER + f""",
strata AS (
  SELECT *, CASE WHEN rank BETWEEN 1 AND 10 THEN '1-10' WHEN rank BETWEEN 11 AND 20 THEN '11-20'
                 WHEN rank BETWEEN 21 AND 50 THEN '21-50' WHEN rank >= 51 THEN '51+' END AS rank_stratum
  FROM quarter_rank),
sample AS (
  SELECT track, market, CAST(substr(quarter, 1, 4) AS INTEGER) AS year, quarter, rank_stratum, TRUE AS sampled
  FROM (SELECT *, row_number() OVER (PARTITION BY market, quarter, rank_stratum
                                     ORDER BY md5(CAST(track AS VARCHAR) || '|{SEED}'), track) AS place
        FROM strata WHERE rank_stratum IS NOT NULL) WHERE place <= 10)"""
