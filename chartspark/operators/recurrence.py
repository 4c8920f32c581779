"""Recurring seconds of a track from the products of blocks of its vectors.

The pair matrix of a track is cut into blocks; a task multiplies two blocks of vectors at a time and lets out counts of
similarity cells, and at the end runs of recurring pairs. No pair is a row. The exact percentile is found by refining the
cell it lies in, again over the blocks, until the cell's edges are the values themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartspark import scale

# Recurrence limits.
MIN_SEPARATION = 10
MIN_RUN = 3
SIMILARITY_PERCENTILE = 95.0

BLOCK = 128
CELLS = 1024
# similarities are rounded, so that equal vectors are equal in every task and a cell cannot be split for ever
DIGITS = 12


def vector_blocks(df: DataFrame, track: str, position: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(track, _b, _n, _m): up to block vectors of consecutive places, one after the other in one array."""
    places = df.select(track, F.col(vector).alias("_v"), (F.row_number().over(W.partitionBy(track).orderBy(position)) - 1).alias("_i"))
    parts = places.groupBy(track, F.floor(F.col("_i") / block).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_r"))
    return parts.select(track, "_b", F.size("_r").alias("_n"), F.flatten(F.transform("_r", lambda r: r["_v"])).alias("_m"))


def block_pairs(blocks: DataFrame, track: str) -> DataFrame:
    """Each block with itself and each later one of its track; a long track is many rows."""
    last = blocks.groupBy(track).agg(F.max("_b").alias("_last"))
    left = blocks.join(last, track).select(
        track, F.col("_b").alias("_bi"), F.col("_n").alias("_ni"), F.col("_m").alias("_mi"), F.explode(F.sequence("_b", "_last")).alias("_bj")
    )
    return left.join(blocks.select(track, F.col("_b").alias("_bj"), F.col("_n").alias("_nj"), F.col("_m").alias("_mj")), [track, "_bj"])


def _products(row: dict, separation: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarity, first place and gap of the pairs of two blocks that lie far enough apart."""
    a, b = (np.asarray(row[m], dtype=float).reshape(row[n], -1) for m, n in (("_mi", "_ni"), ("_mj", "_nj")))
    i, j = row["_bi"] * block + np.arange(row["_ni"]), row["_bj"] * block + np.arange(row["_nj"])
    gap = j[None, :] - i[:, None]
    far = gap >= separation
    s = np.clip(np.round(a @ b.T, DIGITS), -1.0, 1.0)
    return s[far], np.broadcast_to(i[:, None], gap.shape)[far], gap[far]


def cell_counts(pairs: DataFrame, track: str, separation: int, block: int) -> DataFrame:
    """(track, cell, n, low, high) of the similarities within the track's bounds _from and _to."""
    kind = pairs.select(track).schema.toDDL()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                s, _, _ = _products(row, separation, block)
                v = np.sort(s[(s >= row["_from"]) & (s <= row["_to"])])
                if len(v):
                    cell = np.minimum(((v - row["_from"]) / (row["_to"] - row["_from"]) * CELLS).astype(int), CELLS - 1)
                    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                    end = np.r_[at[1:], len(v)]
                    out.append((row[track], cell[at], end - at, v[at], v[end - 1]))
            yield pd.DataFrame(out, columns=[track, "c", "n", "low", "high"])

    arrays = pairs.mapInPandas(count, f"{kind}, c array<long>, n array<long>, low array<double>, high array<double>")
    cells = arrays.select(track, F.explode(F.arrays_zip("c", "n", "low", "high")).alias("_z")).select(track, "_z.*")
    return cells.groupBy(track, F.col("c").alias("cell")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def similarity_limits(blocks: DataFrame, track: str, separation: int, percentile: float, block: int = BLOCK) -> DataFrame:
    """(track, _limit): exact percentile, linearly interpolated, of the similarities of all far pairs of a track.

    The two values around it lie in two cells, whose edges they then are, or in one, which is cut into cells again. A round
    makes the cell a thousand times narrower, so rounded values are reached after five at most. Tracks without pairs are left out.
    """
    n = F.sum("_n")
    m = (n - separation) * (n - separation + 1) / 2
    sizes = blocks.groupBy(track).agg(n.alias("_size"), m.alias("_pairs")).where(F.col("_size") > separation)
    place = F.col("_pairs").cast("double") * (percentile / 100) - percentile / 100
    state = sizes.select(
        track, F.floor(place).alias("_rank"), (place - F.floor(place)).alias("_part"), (F.col("_pairs").cast("bigint") - 1).alias("_top"),
        F.lit(-1.0).alias("_from"), F.lit(1.0).alias("_to"), F.lit(0).cast("bigint").alias("_below"), F.lit(None).cast("double").alias("_limit"),
    )
    pairs, state = block_pairs(blocks, track), scale.cut_lineage(state)
    while True:
        todo = state.where("_limit is null")
        if todo.isEmpty():
            return state.select(track, "_limit")
        cells = cell_counts(pairs.join(todo.select(track, "_from", "_to"), track), track, separation, block)
        upto = F.sum("n").over(W.partitionBy(track).orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
        placed = cells.withColumn("_upto", upto).join(todo.drop("_from", "_to", "_limit"), track)
        before, upper = F.col("_below") + F.col("_upto") - F.col("n"), F.least(F.col("_rank") + 1, F.col("_top"))
        here = F.struct("cell", "low", "high", before.alias("before"))

        def holds(rank):
            return (before <= rank) & (rank < F.col("_below") + F.col("_upto"))

        found = placed.groupBy(track).agg(
            *[F.first(c).alias(c) for c in ("_rank", "_part", "_top")],
            F.max(F.when(holds(F.col("_rank")), here)).alias("_a"), F.max(F.when(holds(upper), here)).alias("_z"),
        )
        apart, single = F.col("_a.cell") != F.col("_z.cell"), F.col("_a.low") == F.col("_a.high")
        between = F.col("_a.high") + (F.col("_z.low") - F.col("_a.high")) * F.col("_part")
        moved = found.select(
            track, "_rank", "_part", "_top", F.col("_a.low").alias("_from"), F.col("_a.high").alias("_to"), F.col("_a.before").alias("_below"),
            F.when(apart, between).when(single, F.col("_a.low")).alias("_limit"),
        )
        state = scale.cut_lineage(state.where("_limit is not null").unionByName(moved))


def recurring_runs(pairs: DataFrame, limits: DataFrame, track: str, separation: int, block: int) -> DataFrame:
    """(track, gap, island, n): runs of pairs of equal gap at consecutive places with a similarity of the limit or more.

    A block gives its own runs; those that touch across blocks are put together.
    """
    kind = pairs.select(track).schema.toDDL()

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                s, i, gap = _products(row, separation, block)
                hit = s >= row["_limit"]
                i, gap = i[hit], gap[hit]
                if len(i):
                    order = np.lexsort((i, gap))
                    i, gap = i[order], gap[order]
                    at = np.flatnonzero(np.r_[True, (gap[1:] != gap[:-1]) | (i[1:] != i[:-1] + 1)])
                    out.append((row[track], gap[at], i[at], np.diff(np.r_[at, len(i)])))
            yield pd.DataFrame(out, columns=[track, "gap", "start", "n"])

    arrays = pairs.join(limits, track).mapInPandas(runs, f"{kind}, gap array<long>, start array<long>, n array<long>")
    pieces = arrays.select(track, F.explode(F.arrays_zip("gap", "start", "n")).alias("_z")).select(track, "_z.*")
    by = W.partitionBy(track, "gap").orderBy("start")
    fresh = F.coalesce((F.col("start") != F.lag(F.col("start") + F.col("n")).over(by)).cast("int"), F.lit(1))
    numbered = pieces.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(by))
    return numbered.groupBy(track, "gap", "island").agg(F.sum("n").alias("_n"))


def recurrence(
    df: DataFrame, track: str, position: str, vector: str, separation: int = MIN_SEPARATION, min_run: int = MIN_RUN,
    percentile: float = SIMILARITY_PERCENTILE, block: int = BLOCK,
) -> DataFrame:
    """Determinism, mean and longest run of recurring seconds of a track, from its unit vectors.

    Pairs at or above the track's percentile recur. Recurring pairs of equal gap whose places follow each other form runs;
    runs of min_run pairs or more count. A track too short for such a run has zeros. Similarities have twelve decimals.
    """
    blocks = scale.cut_lineage(vector_blocks(df, track, position, vector, block))
    sizes = blocks.groupBy(track).agg(F.sum("_n").alias("n_seconds"))
    limits = similarity_limits(blocks, track, separation, percentile, block)
    runs = recurring_runs(block_pairs(blocks, track), limits, track, separation, block)
    long_run = F.when(F.col("_n") >= min_run, F.col("_n"))
    facts = runs.groupBy(track).agg(
        (F.coalesce(F.sum(long_run), F.lit(0)) / F.sum("_n")).alias("_det"), F.avg(long_run).alias("_mean"), F.max(long_run).cast("double").alias("_longest")
    )
    enough = F.col("n_seconds") >= separation + min_run
    measured = sizes.join(facts, track, "left")
    zero = lambda c: F.when(enough, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return measured.select(
        track, "n_seconds", zero("_det").alias("determinism"), zero("_mean").alias("mean_run"), zero("_longest").alias("longest_run"), F.lit("success").alias("status")
    )
