"""Source and sink queries: pages, shards, keyed JSON, incremental ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chartspark import scale
from chartspark.operators import chart
from chartspark.plans import shapes as S
from chartspark.plans.book import PlanBook
from chartspark.sources import pages, readers, sinks
from chartspark.streaming import ingest

PLANS = PlanBook()


def _folder(spark) -> str:
    return f"{scale.shared_folder(spark)}/run-{uuid.uuid4().hex}"


@PLANS.add(
    "src_08_page_links",
    """SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS position, unnest(h) AS href, unnest(t) AS text FROM
    (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages)""",
)
def page_links(spark, sf):
    return pages.page_links(S.table(spark, sf, "pages"), "page_id", "html")


@PLANS.add(
    "src_08_totals_pages",
    f"""WITH {S.PERF}, {S.SONGS} SELECT CAST(p.track AS VARCHAR) AS item, p.market, s.title, s.artist, p.weeks_on_chart AS weeks, p.weeks_in_top10 AS top10, p.peak_rank
    FROM perf p JOIN songs s ON s.track = p.track""",
)
def totals_pages(spark, sf):
    """Totals pages rendered for blocks of fifty tracks, then read back."""
    rows = S.perf(spark, sf).join(S.songs(spark, sf).select("track", "title", "artist"), "track")
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    link = F.concat(
        F.lit('<td><a href="/artist/1">'), "artist", F.lit('</a> - <a href="/track/'), F.col("track").cast("string"), F.lit('">'), "title", F.lit("</a></td>")
    )
    tr = F.concat(
        F.lit("<tr>"), link, cell(F.col("weeks_on_chart")), cell(F.col("weeks_in_top10")), cell(F.col("peak_rank")), F.lit("<td></td>"),
        cell(F.format_number("weeks_on_chart", 0)), cell(F.lit("1,234")), F.lit("</tr>"),
    )
    page = F.concat_ws("-", "market", F.floor(F.col("track") / 50).cast("string"))
    html = rows.select(page.alias("page"), tr.alias("tr")).groupBy("page").agg(
        F.concat(F.lit("<table><tr><th>Artist and Title</th></tr>"), F.array_join(F.array_sort(F.collect_list("tr")), ""), F.lit("</table>")).alias("html")
    )
    found = pages.totals_rows(pages.table_cells(html, "page", "html"), "page")
    return found.select(
        "item", F.regexp_extract("page", r"^(.*)-\d+$", 1).alias("market"), "title", "artist", "weeks", "top10", "peak_rank"
    )


@PLANS.add(
    "src_09_weekly_pages",
    f"""WITH {S.WEEKLY}, n AS (SELECT track FROM weekly GROUP BY 1 HAVING COUNT(DISTINCT chart_date) >= 2)
    SELECT track, market, chart_date, rank, streams FROM weekly WHERE track IN (SELECT track FROM n) AND chart_date >= DATE '1996-01-01'""",
)
def weekly_pages(spark, sf):
    """History pages rendered per track from the weekly chart, then read back."""
    w = S.weekly(spark, sf).withColumn("cell", F.concat(F.col("rank").cast("string"), F.lit(" ("), F.format_number("streams", 0), F.lit(")")))
    wide = w.groupBy("track", "chart_date").pivot("market", S.MARKETS).agg(F.first("cell"))
    tds = [F.concat(F.lit("<td>"), F.coalesce(F.col(f"`{m}`"), F.lit("--")), F.lit("</td>")) for m in S.MARKETS]
    tr = F.concat(F.lit("<tr><td>"), F.date_format("chart_date", "yyyy/MM/dd"), F.lit("</td>"), *tds, F.lit("</tr>"))
    head = "<table><tr><th>Date</th>" + "".join(f"<th>{m}</th>" for m in S.MARKETS) + "</tr>"
    # a track has at most one row per week
    html = wide.select("track", tr.alias("tr")).groupBy("track").agg(
        F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("tr")), ""), F.lit("</table>")).alias("html")
    )
    cells = scale.cut_lineage(pages.table_cells(html, "track", "html"))
    return pages.weekly_rows(cells, "track", S.MARKETS, min_date="1996/01/01")


@PLANS.add(
    "src_10_script_values",
    r"""SELECT page_id, CAST(regexp_extract(html, '<script>.*?track\((\d+)\)', 1) AS BIGINT) AS tracked FROM pages""",
)
def script_values(spark, sf):
    p = S.table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", r"<script>.*?track\((\d+)\)", 1).cast("bigint").alias("tracked"))


@PLANS.add(
    "src_10_embedded_entity",
    f"""WITH {S.SONGS} SELECT track, CAST(release_date AS VARCHAR) AS release_date, CASE WHEN track % 4 <> 0 THEN album END AS album FROM songs""",
)
def embedded_entity(spark, sf):
    """Entity pages rendered from the song table with the date as struct or text, then read back."""
    songs = S.songs(spark, sf)
    day = F.date_format("release_date", "yyyy-MM-dd")
    as_struct = F.concat(F.lit('{"isoString":"'), day, F.lit('T00:00:00Z"}'))
    date = F.when(day.isNull(), "null").when(F.col("track") % 2 == 0, as_struct).otherwise(F.concat(F.lit('"'), day, F.lit('"')))
    album = F.when(F.col("track") % 4 != 0, F.concat(F.lit('{"name":"'), "album", F.lit('"}'))).otherwise("null")
    body = F.concat(F.lit('{"props":{"pageProps":{"state":{"data":{"entity":{"releaseDate":'), date, F.lit(',"album":'), album, F.lit("}}}}}}"))
    html = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></html>"))
    return pages.embedded_entity(songs.select("track", html.alias("html")), "track", "html")


@PLANS.add(
    "src_05_keyed_json",
    f"""WITH {S.SAMPLE} SELECT CAST(track AS VARCHAR) AS key, string_agg(DISTINCT market, ';' ORDER BY market) AS markets FROM sample GROUP BY 1""",
)
def keyed_json(spark, sf):
    """Keyed JSON documents of fifty tracks with nested provenance, then read back."""
    place = F.struct("market", "year", "quarter", "rank_stratum")
    items = S.sample(spark, sf).groupBy("track").agg(F.collect_list(place).alias("sampling_provenance"))
    entry = F.struct(F.col("track").cast("string").alias("k"), F.struct(F.lit("success").alias("lyrics_status"), "sampling_provenance").alias("v"))
    documents = items.groupBy(F.floor(F.col("track") / 50)).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return readers.provenance_markets(readers.keyed_json_rows(documents))


@PLANS.add(
    "src_01_csv_shards",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""",
)
def csv_shards(spark, sf):
    """Two overlapping CSV shards written, read with a schema and deduplicated."""
    from pyspark.sql import types as T

    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    folder = _folder(spark)
    sinks.write_report(orders.where("o_orderkey % 3 <> 0"), f"{folder}/a", "csv")
    sinks.write_report(orders.where("o_orderkey % 3 <> 1"), f"{folder}/b", "csv")
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ])
    return readers.read_shards(spark, f"{folder}/*", schema, ["o_orderkey"])


@PLANS.add(
    "src_03_embedded_parent",
    "SELECT l_orderkey, l_linenumber, l_partkey, p_name AS title, p_brand AS artist FROM lineitem LEFT JOIN part ON p_partkey = l_partkey",
)
def embedded_parent(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return readers.flatten_parent(line, part, "l_partkey", "song").select("l_orderkey", "l_linenumber", "l_partkey", "song.title", "song.artist")


@PLANS.add("src_04_id_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def id_lookup(spark, sf):
    ids = S.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return S.table(spark, sf, "part").select("p_partkey", "p_name").join(ids, "p_partkey", "left_semi")


@PLANS.add("src_12_load_table", "SELECT c_custkey, c_mktsegment FROM customer")
def load_table(spark, sf):
    return readers.load_table(spark, "no_such_table", [f"{sf}/no_such.parquet", f"{sf}/customer.parquet"], ["c_custkey", "c_mktsegment", "absent"])


@PLANS.add("snk_05_published_view", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1")
def published_view(spark, sf):
    sinks.publish_view(S.table(spark, sf, "customer"), "chartspark_customers")
    return spark.sql("SELECT c_mktsegment, COUNT(*) AS n FROM chartspark_customers GROUP BY c_mktsegment")


@PLANS.add("snk_04_append_log", "SELECT event_id, event_type FROM events")
def append_log(spark, sf):
    events, path = S.table(spark, sf, "events").select("event_id", "event_type"), _folder(spark)
    sinks.append_log(events.where("event_id % 2 = 0"), path)
    sinks.append_log(events.where("event_id % 2 = 1"), path)
    return spark.read.parquet(path)


@PLANS.add(
    "snk_07_handoff_exports",
    "SELECT event_type, COUNT(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
)
def handoff_exports(spark, sf):
    events, folder = S.table(spark, sf, "events").select("event_id", "event_type", "value"), _folder(spark)
    kinds = {name: F.col("event_type") == name for name in ("view", "click")}
    sinks.handoff(events, kinds, ["event_id", "event_type"], ["event_id"], folder, "parquet")
    return spark.read.parquet(f"{folder}/view", f"{folder}/click").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@PLANS.add(
    "snk_03_report_export",
    "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1",
)
def report_export(spark, sf):
    counts, path = S.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), _folder(spark)
    sinks.write_report(counts, path, "json", ["l_returnflag"])
    return spark.read.schema("l_returnflag string, n bigint").json(path)


@PLANS.add(
    "inc_02_streamed_performance",
    f"""WITH {S.PERF} SELECT track, market, round(lifetime_average_rank, 6) AS lifetime_average_rank, peak_rank, weeks_on_chart, weeks_in_top10 FROM perf""",
)
def streamed_performance(spark, sf):
    """Overlapping yearly shards streamed in, with repeated keys and a second run over the same files."""
    folder = _folder(spark)
    weekly = scale.cut_lineage(S.weekly(spark, sf).select(*ingest.WEEKLY_SCHEMA.names))
    for shard, when in (("a", "chart_date < date '1999-01-01'"), ("b", "chart_date >= date '1998-07-01'"), ("again", "chart_date >= date '2001-01-01'")):
        weekly.where(when).write.parquet(f"{folder}/in/{shard}")
        ingest.ingest_available(spark, f"{folder}/in/*", f"{folder}/facts", f"{folder}/state")
    out = ingest.refreshed_performance(spark, f"{folder}/facts")
    return out.select(
        "track", "market", F.round("lifetime_average_rank", 6).alias("lifetime_average_rank"), F.col("peak_rank").cast("bigint").alias("peak_rank"),
        "weeks_on_chart", "weeks_in_top10",
    )


@PLANS.add(
    "inc_02_refresh_changed_pairs",
    f"""WITH {S.PERF} SELECT track, market, weeks_on_chart, peak_rank FROM perf""",
)
def refresh_changed_pairs(spark, sf):
    weekly = scale.cut_lineage(S.weekly(spark, sf))
    old = weekly.where("chart_date < date '2001-01-01'")
    base = chart.chart_performance(old, "track")
    out = ingest.refresh_changed(weekly, base, weekly.where("chart_date >= date '2001-01-01'"))
    return out.select("track", "market", "weeks_on_chart", F.col("peak_rank").cast("bigint").alias("peak_rank"))
