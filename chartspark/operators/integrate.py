"""Joins that put performance, metadata, audio and text features at one grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartspark.functions.clean import reason_list
from chartspark.operators import order, quality


def exists_flag(df: DataFrame, other: DataFrame, keys: list[str], out: str) -> DataFrame:
    """EXISTS as a boolean column."""
    known = other.select(*keys).distinct().withColumn(out, F.lit(True))
    return df.join(known, keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def modeling_dataset(
    perf: DataFrame, songs: DataFrame, audio: DataFrame, mapping: DataFrame, lyrics: DataFrame, sampled: DataFrame, key: str
) -> DataFrame:
    """(item, market) grain: performance, metadata, audio, chosen mapping, text features and completeness flags.

    Items grow with the catalogue, and a small file holds many of them: the joins are merges, so that no side passes the driver.
    """
    chosen = mapping.where("is_selected").select("mapping_id", F.col("is_selected").alias("mapping_is_selected"))
    mapped = audio.join(chosen.hint("merge"), "mapping_id", "left").withColumn("_has_audio", F.lit(True))
    texts = lyrics.withColumn("_has_lyrics", F.lit(True))
    joined = (
        perf.join(songs.withColumn("release_year", F.year("release_date")).hint("merge"), key)
        .join(mapped.hint("merge"), key, "left")
        .join(texts.hint("merge"), key, "left")
        .withColumn("has_audio", F.col("_has_audio").isNotNull())
        .withColumn("has_lyrics_row", F.col("_has_lyrics").isNotNull())
        .withColumn("has_both_rows", F.col("has_audio") & F.col("has_lyrics_row"))
        .drop("_has_audio", "_has_lyrics")
    )
    return exists_flag(joined, sampled, [key], "is_sampled")


def completeness_by_status(df: DataFrame, audio_value: str, status: str = "lyrics_status") -> DataFrame:
    """Second definition of the flags: audio measured, and text extraction successful."""
    measured = F.col(audio_value).isNotNull()
    return (
        df.withColumn("has_audio", measured)
        .withColumn("has_lyrics_row", F.col(status).isNotNull())
        .withColumn("has_both_rows", measured & F.coalesce(F.col(status) == "success", F.lit(False)))
    )


def integrate_sampled(
    perf: DataFrame, sample: DataFrame, songs: DataFrame, audio: DataFrame, lyrics: DataFrame, key: str, grain: list[str]
) -> DataFrame:
    """Performance of sampled items with side tables reduced to one row per key first."""
    kept = perf.join(sample.select(key).distinct(), key, "left_semi")
    meta = order.first_per_key(songs, [key], ["title"]).withColumn("release_year", F.year("release_date"))
    texts = order.first_per_key(lyrics, [key], ["lyrics_status"])
    sounds = order.first_per_key(audio, [key], ["mapping_id"])
    return kept.join(meta, key, "left").join(sounds, key, "left").join(texts, key, "left")


def spread_over_rows(rows: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Item-level features on every longitudinal row of the item."""
    return rows.join(features, key, "left")


def join_feature_tables(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner join of tables with one row per key."""
    return reduce(lambda a, b: a.join(b, key), tables)


def complete_case(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Rows of items none of whose rows misses a required value."""
    bad = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])).select(key).distinct()
    return df.join(bad, key, "left_anti")


def exclusions(df: DataFrame, rules: list[tuple[Column, str | Column]], keep: list[str]) -> DataFrame:
    """Excluded rows with their reasons joined by '; '."""
    return (
        df.withColumn("_reasons", reason_list(*rules))
        .where(F.size("_reasons") > 0)
        .select(*keep, F.array_join("_reasons", "; ").alias("exclusion_reasons"))
    )


def require_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; raises when a NULL is left."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    left = {c: counts[c] for c in columns if counts[c]}
    if left:
        raise ValueError(f"NULLs left after cleaning: {left}")
    return df


def layered_fill(c: Column, layers: list[tuple[Column, str]], own_label: str, default: float, default_label: str) -> tuple[Column, Column]:
    """First non-NULL of the value and its fallbacks, with the name of the layer it came from."""
    value = F.coalesce(c, *[layer for layer, _ in layers], F.lit(default))
    source = F.when(c.isNotNull(), own_label)
    for layer, label in layers:
        source = source.when(layer.isNotNull(), label)
    return value, source.otherwise(default_label)


def check_column_contract(columns: list[str], allowed: list[str], forbidden: list[str]) -> None:
    """Raise when a design column does not come from an allowed one or comes from a forbidden one."""
    for name in columns:
        base = name.split("__x__")[0].removesuffix("_std")
        if base.startswith("Market_"):
            continue
        if base in forbidden or name in forbidden:
            raise ValueError(f"forbidden column {name}")
        if base not in allowed:
            raise ValueError(f"unknown column {name}")


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows without an update, plus all updates; updates must be unique per key."""
    return existing.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def upsert_counts(existing: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many updates would insert, change or leave a row."""
    sides = quality.reconcile(existing, updates, keys, columns)
    return sides.agg(
        F.count_if(F.col("side") == "only_second").alias("inserted"),
        F.count_if((F.col("side") == "both") & (F.size("different") > 0)).alias("updated"),
        F.count_if((F.col("side") == "both") & (F.size("different") == 0)).alias("unchanged"),
        F.count_if(F.col("side") == "only_first").alias("untouched"),
    )


def replace_keys(existing: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Drop all rows of the patched keys and add the patch, which may hold several rows per key."""
    return existing.join(patch.select(*keys).distinct(), keys, "left_anti").unionByName(patch)
