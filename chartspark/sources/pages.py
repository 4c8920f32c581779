"""Stored web pages to rows: table cells by a small parser, everything after that on the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions.text import strip

CELL_FIELDS = "table_no int, row_no int, cell_no int, is_header boolean, text string, hrefs array<string>, link_texts array<string>"


class CellReader(HTMLParser):
    """Cells of all tables of a page with their links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.table = self.row = self.cell = -1
        self.open: dict | None = None
        self.in_link = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self.row, self.cell = self.row + 1, -1
        elif tag in ("td", "th") and self.table >= 0:
            self.cell += 1
            self.open = {
                "table_no": self.table, "row_no": self.row, "cell_no": self.cell, "is_header": tag == "th", "text": "", "hrefs": [],
                "link_texts": [],
            }
            self.cells.append(self.open)
        elif tag == "a" and self.open is not None:
            self.open["hrefs"].append(dict(attrs).get("href") or "")
            self.open["link_texts"].append("")
            self.in_link = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.open, self.in_link = None, False
        elif tag == "a":
            self.in_link = False

    def handle_data(self, data):
        if self.open is not None:
            self.open["text"] += data
            if self.in_link:
                self.open["link_texts"][-1] += data


def table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cell, text, links) of stored pages; a page is read by itself."""
    key_type = dict(pages.dtypes)[key]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch[key], batch[html]):
                reader = CellReader()
                reader.feed(text or "")
                reader.close()
                if reader.cells:
                    yield pd.DataFrame(reader.cells).assign(**{key: k})[[key, *COLUMNS]]

    return pages.select(key, html).mapInPandas(read, f"{key} {key_type}, {CELL_FIELDS}")


COLUMNS = [field.split()[0] for field in CELL_FIELDS.split(", ")]


def _number(c: Column) -> Column:
    return F.replace(strip(c), F.lit(","), F.lit("")).try_cast("bigint")


def totals_rows(cells: DataFrame, key: str, id_pattern: str = r"/track/([A-Za-z0-9]+)") -> DataFrame:
    """Rows of the first table of a totals page: the last link of the first cell is the item, at least six cells.

    Rows are keyed by (page, row), so a page of any length is spread by its rows.
    """
    body = cells.where("table_no = 0 and row_no > 0 and not is_header")
    at = lambda i, c: F.max(F.when(F.col("cell_no") == i, F.col(c)))
    rows = body.groupBy(key, "row_no").agg(
        F.count(F.lit(1)).alias("n_cells"), at(0, "hrefs").alias("hrefs"), at(0, "link_texts").alias("names"),
        *[at(i, "text").alias(f"t{i}") for i in (1, 2, 3, 5, 6)],
    )
    linked = rows.where("n_cells >= 6 and size(hrefs) > 0").withColumn("item", F.regexp_extract(F.element_at("hrefs", -1), id_pattern, 1))
    return linked.where("item <> ''").select(
        key, "item", strip(F.element_at("names", -1)).alias("title"),
        F.when(F.size("names") > 1, strip(F.element_at("names", 1))).otherwise("").alias("artist"),
        _number(F.col("t1")).alias("weeks"), _number(F.col("t2")).alias("top10"), _number(F.col("t3")).alias("peak_rank"),
        _number(F.col("t5")).alias("peak_streams"), _number(F.col("t6")).alias("total_streams"),
    )


def weekly_rows(cells: DataFrame, key: str, markets: list[str], min_date: str = "2021/01/01") -> DataFrame:
    """(key, market, chart_date, rank, streams) of the first weekly table of a page.

    Weekly means a Date header and first two dates at least six days apart. A cell reads 'rank (streams)', '--' is no chart.
    """
    tidy = cells.withColumn("text", strip("text"))
    dates = tidy.where(F.col("cell_no") == 0).where(F.col("row_no") > 0).where(F.col("text").rlike(r"^\d{4}/\d{2}/\d{2}$"))
    firsts = dates.groupBy(key, "table_no").agg(F.slice(F.array_sort(F.collect_list(F.struct("row_no", "text"))), 1, 2).alias("d"))
    day = lambda i: F.try_to_date(F.col("d")[i]["text"], "yyyy/MM/dd")
    spaced = firsts.where((F.size("d") == 2) & (F.abs(F.date_diff(day(0), day(1))) >= 6)).select(key, "table_no")
    headers = tidy.where("row_no = 0")
    dated = headers.where("text = 'Date'").select(key, "table_no").distinct()
    chosen = spaced.join(dated, [key, "table_no"]).groupBy(key).agg(F.min("table_no").alias("table_no"))
    # the first header with the name of a market is its column
    columns = headers.where(F.col("text").isin(markets)).groupBy(key, "table_no", F.col("text").alias("market")).agg(F.min("cell_no").alias("cell_no"))
    columns = columns.join(chosen, [key, "table_no"])
    days = dates.join(chosen, [key, "table_no"]).where(F.col("text") >= min_date).select(key, "table_no", "row_no", F.col("text").alias("day"))
    values = tidy.where("row_no > 0").join(columns, [key, "table_no", "cell_no"]).join(days, [key, "table_no", "row_no"])
    parts = r"^(\d+)\s*\(([\d,]+)\)$"
    charted = values.where(F.col("text").rlike(parts))
    return charted.select(
        key, "market", F.to_date("day", "yyyy/MM/dd").alias("chart_date"), F.regexp_extract("text", parts, 1).cast("bigint").alias("rank"),
        F.replace(F.regexp_extract("text", parts, 2), F.lit(","), F.lit("")).cast("bigint").alias("streams"),
    )


def embedded_entity(pages: DataFrame, key: str, html: str, script_id: str = "__NEXT_DATA__") -> DataFrame:
    """Release date (struct or text, cut to ten characters) and album of the JSON in a script tag."""
    pattern = rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>'
    root = "$.props.pageProps.state.data.entity"
    found = pages.select(key, F.regexp_extract(html, pattern, 1).alias("json"))
    iso = F.get_json_object("json", f"{root}.releaseDate.isoString")
    plain = F.get_json_object("json", f"{root}.releaseDate")
    date = F.when(F.length(iso) >= 10, F.substring(iso, 1, 10)).when(iso.isNull() & ~plain.startswith("{"), F.substring(plain, 1, 10))
    return found.select(key, date.alias("release_date"), F.get_json_object("json", f"{root}.album.name").alias("album"))


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, position, href, text) of the links of a page."""
    pattern = r'<a href="([^"]*)">([^<]*)</a>'
    hrefs, names = F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return pages.select(key, F.posexplode(F.arrays_zip(hrefs.alias("href"), names.alias("text"))).alias("position", "link")).select(
        key, "position", "link.href", "link.text"
    )

