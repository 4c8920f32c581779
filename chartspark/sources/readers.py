"""Readers for tables, shards, text corpora, keyed JSON and file listings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.functions.language_rules import DEFAULT_RULES, LyricRules
from chartspark.operators import order

BOM = "﻿"


def read_shards(
    spark: SparkSession, path: str, schema: T.StructType, key: list[str] | None = None, order_by: list | None = None
) -> DataFrame:
    """All CSV shards of a path or glob with a given schema; a byte-order mark before the first header is harmless.

    With a key, its first row by order_by stays, without order_by the first by all other columns.

    The header is matched by position, so the mark, which only touches the first header name, never reaches a value.
    """
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    if not key:
        return rows
    return order.first_per_key(rows, key, order_by or [c for c in rows.columns if c not in key]).select(*rows.columns)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, columns: list[str] | None = None,
    where: str | None = None, properties: dict[str, str] | None = None,
) -> DataFrame:
    """Partitioned table read; projection and filter go to the server."""
    df = spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties or {}
    )
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def load_table(
    spark: SparkSession, name: str, paths: list[str] = (), columns: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Catalog table when it exists, else the first readable parquet path."""
    df = spark.table(name) if spark.catalog.tableExists(name) else None
    for path in paths:
        if df is not None:
            break
        try:
            df = spark.read.parquet(path)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if df is None:
        raise ValueError(f"no source for {name}: neither a table nor any of {list(paths)}")
    if columns:
        df = df.select(*[c for c in columns if c in df.columns])
    return df.limit(limit) if limit else df


def read_corpus(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """One row per file: key from the file name, whole text without a leading byte-order mark."""
    rows = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.col("_metadata.file_name")
    text = F.when(F.col("value").startswith(BOM), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("key"), text.alias("text"))


def list_media(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp3", "wav", "flac", "ogg", "m4a", "opus", "aac")) -> DataFrame:
    """Files with a media extension; only metadata columns are read."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime", F.element_at(F.split("path", "/"), -1).alias("file_name"))


PROVENANCE = T.StructType([
    T.StructField("market", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("quarter", T.StringType()),
    T.StructField("rank_stratum", T.StringType()),
])
COLLECTION_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("artist", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("lyrics_status", T.StringType()),
    T.StructField("sampling_provenance", T.ArrayType(PROVENANCE)),
])


def keyed_json_rows(documents: DataFrame, text: str = "value", item: T.StructType = COLLECTION_ITEM) -> DataFrame:
    """JSON objects keyed by id to one row per id."""
    parsed = documents.select(F.from_json(F.col(text), T.MapType(T.StringType(), item)).alias("items"))
    return parsed.select(F.explode("items").alias("key", "item")).select("key", "item.*")


def provenance_markets(items: DataFrame, key: str = "key", provenance: str = "sampling_provenance") -> DataFrame:
    """Distinct markets of each item, sorted and joined by ';'."""
    names = F.filter(F.transform(provenance, lambda p: p["market"]), lambda m: m.isNotNull() & (m != ""))
    return items.select(key, F.array_join(F.array_sort(F.array_distinct(names)), ";").alias("markets"))


def explode_provenance(items: DataFrame, key: str = "key", provenance: str = "sampling_provenance") -> DataFrame:
    """One row per (key, market)."""
    names = F.array_distinct(F.transform(provenance, lambda p: p["market"]))
    return items.select(key, F.explode(names).alias("market")).where("market is not null")


def split_membership(df: DataFrame, packed: str, out: str, separator: str = ";") -> DataFrame:
    """';'-joined membership text to one row per member."""
    parts = F.array_distinct(F.filter(F.transform(F.split(packed, separator), F.trim), lambda x: x != ""))
    return df.select(*[c for c in df.columns if c != packed], F.explode(parts).alias(out))


def flatten_parent(child: DataFrame, parent: DataFrame, on: str, embed: str = "parent") -> DataFrame:
    """Child rows with their parent as a struct column, the shape an embedded read returns."""
    fields = [c for c in parent.columns if c != on]
    packed = parent.select(on, F.struct(*fields).alias(embed))
    return child.join(packed, on, "left")


# ---- rules -----------------------------------------------------------------------------------------

WORD_LISTS = "map<string, array<string>>"
LIMITS = ("min_block_lines", "max_block_lines", "min_unique_lines", "min_block_words")
RULE_SCHEMA = (
    f"title_stopwords {WORD_LISTS}, pronouns {WORD_LISTS}, blank_languages array<string>, title_languages array<string>, "
    f"limits struct<{', '.join(f'{n}: int' for n in LIMITS)}, block_similarity: double>"
)


def read_lyric_rules(spark: SparkSession, path: str, base: LyricRules = DEFAULT_RULES) -> LyricRules:
    """Lyric rules of a JSON file, or of several files with different parts, checked; each file holds one object.

    Parts that the files lack come from base; a language in a file replaces that language's list only. Words are trimmed and
    folded, empty ones and repeats go. Wrong JSON, unknown parts, no part at all, two values of one part, and limits that
    exclude every block are errors.
    """
    known = {"title_stopwords", "pronouns", "blank_languages", "title_languages", "limits"}
    texts = spark.read.text(path, wholetext=True)
    for row in texts.select(F.json_object_keys("value").alias("keys")).collect():
        strange = sorted(set(row["keys"] or []) - known)
        if row["keys"] is None or strange:
            raise ValueError(f"{path} is no rule file: {', '.join(strange) or 'no object'}")
    found: dict[str, object] = {}
    for row in texts.select(F.from_json("value", RULE_SCHEMA, {"mode": "FAILFAST"}).alias("rules")).collect():  # a few word lists
        for part, value in row["rules"].asDict(recursive=True).items():
            if value is not None and part in found:
                raise ValueError(f"{path} gives {part} twice")
            found.update({part: value} if value is not None else {})
    if not found:
        raise ValueError(f"{path} holds none of {', '.join(sorted(known))}")

    def folded(words: list[str]) -> list[str]:
        return list(dict.fromkeys(w.strip().casefold() for w in words or [] if w and w.strip()))

    lists = {"stopwords": "title_stopwords", "pronouns": "pronouns"}
    changed = {own: {**getattr(base, own), **{k: folded(v) for k, v in found.get(part, {}).items()}} for own, part in lists.items()}
    changed.update({part: folded(found[part]) for part in ("blank_languages", "title_languages") if part in found})
    changed.update({k: v for k, v in found.get("limits", {}).items() if v is not None})
    rules = replace(base, **changed)
    if not 1 <= rules.min_block_lines <= rules.max_block_lines or not 0 < rules.block_similarity <= 1:
        raise ValueError(f"{path}: limits that no block can meet")
    return rules
