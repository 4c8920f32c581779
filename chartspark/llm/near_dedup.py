"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union of links.

A document's set holds its distinct runs of five words. Each shingle draws one permutation rank per signature place, so
the places are correlated and vary less than independent minima; ranks are drawn place by place for all shingles of a
piece of texts at once and stop when no later rank can lower any place. Forty bands of five places propose candidates: a
pair with similarity 0.75 meets in none of them with probability 2e-5, one with 0.8 with 1e-7.

Groups are never expanded into all pairs. Equal sets share one representative. Among candidates, a shingle that one set
alone holds can't be in any intersection, which bounds a pair's similarity from counts alone. In each bucket the member
with the fewest such shingles is compared with all others first, and what two members have in common with it bounds their
similarity further. Later rounds compare only members of different components whose bound still allows a link, at first
with sixteen centres a bucket, at last with all that remain. No possible link between two components that meet in a bucket
is left untested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark import scale
from chartspark.llm import arrays

SHINGLE_WORDS = 5
PERCENT = 75
BANDS = 40
ROWS = 5
CENTRES = 16
BROADCAST_IDS = 1_000_000  # 8 MB of ids

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """For each piece of the column, the sorted distinct 64-bit shingles of its texts."""
    for piece in arrays.pieces(texts):
        data, offsets = arrays.text_view(piece)
        _, _, hashes, first = arrays.words(data, offsets, _IS_WORD)
        runs = arrays.windows(hashes, SHINGLE_WORDS)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE_WORDS:
                sets.append(np.unique(runs[a : b - SHINGLE_WORDS + 1]))
            elif b > a:
                sets.append(arrays.windows(hashes[a:b], b - a))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield sets


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash of each set: one row of unsigned numbers, rank in the top byte, fraction below.

    Rank j of a shingle goes to the place that its permutation holds at j. A set is done as soon as every place holds a
    rank of at most j, because later draws only bring higher ranks. Empty sets keep the largest number everywhere.
    """
    if places > 256:
        raise ValueError("ranks are kept in one byte")
    best = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    flat = best.reshape(-1)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    for j in range(places):
        if not len(items):
            break
        draw = arrays.mix(items + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        pick = (j + (draw >> np.uint64(32)) % np.uint64(places - j)).astype(np.int64)
        if j == 0:
            place = pick
        else:
            if order is None:  # the first swap, made again for the shingles that go on
                order = np.tile(np.arange(places, dtype=np.uint16), (len(items), 1))
                rows = np.arange(len(items))
                order[:, 0] = first
                order[rows, first] = 0
            rows = np.arange(len(items))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
            order[:, j] = place
        value = (np.uint64(j) << np.uint64(56)) | (arrays.mix(draw) >> np.uint64(8))
        np.minimum.at(flat, owner * places + place, value)
        open_sets = (best.max(axis=1) >> np.uint64(56)) > np.uint64(j)
        on = open_sets[owner]
        if j == 0:
            first = pick[on]
        if not on.all():
            items, owner = items[on], owner[on]
            order = None if order is None else order[on]
    return best


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band for each signature; the band's number is part of the key."""
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for i in range(rows):
        keys = arrays.mix(keys * np.uint64(0xA0761D6478BD642F) + signature[:, i::rows][:, :bands])
    return keys.view(np.int64)


_SIGNED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
])


@F.arrow_udf(_SIGNED)
def _signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
    arrays.worker_cache("near dedup")
    for texts in batches:
        n, digests, bands = [], [], []
        for sets in shingle_sets(texts):
            keys = band_keys(signatures(sets, BANDS * ROWS))
            n += [len(s) for s in sets]
            digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands += [k if len(s) else None for k, s in zip(keys, sets)]
        columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), arrays.lists(bands, pa.int64())]
        yield pa.StructArray.from_arrays(columns, fields=list(kind))
    arrays.give_back()


@F.arrow_udf(T.BinaryType())
def _digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for sets in shingle_sets(texts) for s in sets], pa.binary())
    arrays.give_back()


@F.arrow_udf(T.ArrayType(T.LongType()))
def _shingled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield arrays.lists([s.view(np.int64) for sets in shingle_sets(texts) for s in sets], pa.int64())
    arrays.give_back()


def _reaches(common: Column | str, a_n: str, b_n: str) -> Column:
    """Whether sets of these sizes with so many common shingles are similar enough."""
    common = F.col(common) if isinstance(common, str) else common
    return common * 100 >= PERCENT * (F.col(a_n) + F.col(b_n) - common)


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the number of common shingles of the full sets, and whether they are linked."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("a_set").alias("a_n"), F.size("b_set").alias("b_n"), F.size(F.array_intersect("a_set", "b_set")).alias("common"))
    return both.select("a", "b", "common", _reaches("common", "a_n", "b_n").alias("linked"))


def connected(links: DataFrame) -> DataFrame:
    """(id, label) of every id in the links (a, b): the smallest id that can be reached.

    Each pass takes the smallest label among the neighbours and the label of the label, and is written to the shared
    folder; passes grow with the logarithm of the longest path, not with its length.
    """
    both = scale.cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scale.cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        named = labels.select(F.col("id").alias("b"), F.col("label").alias("near"))
        near = both.join(named, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "id").join(up, "label").select("id", F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        new = scale.cut_lineage(new)
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links (a, b), which may join whole components."""
    names = labels.select(F.col("id").alias("a"), F.col("label").alias("x"))
    others = labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    between = links.join(names, "a").join(others, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    between = scale.cut_lineage(between.distinct())
    if between.isEmpty():
        return labels
    merged = connected(between).select(F.col("id").alias("label"), F.col("label").alias("root"))
    return scale.cut_lineage(labels.join(merged, "label", "left").select("id", F.coalesce("root", "label").alias("label")))


def _nodes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """doc_id, n_shingles, digest, component_id and kept of each row, and whether any id repeats.

    The nodes of the link graph are the ids, or id and set digest where a table repeats ids; either orders by id first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body"))
    signed = scale.cut_lineage(rows.select("doc", _signed("body").alias("s")).select("doc", "s.*"))
    repeats = not signed.where("doc IS NOT NULL").groupBy("doc").agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty()
    node = F.struct("doc", "digest") if repeats else F.col("doc")
    signed = signed.withColumn("id", node)
    known = signed.where("doc IS NOT NULL AND n > 0")
    if repeats:  # rows of a node have the same set
        known = scale.cut_lineage(known.dropDuplicates(["id"]))
    # sums that are joined back are written first: both sides of the join are then plain shuffles, which Spark can split
    first = scale.cut_lineage(known.groupBy("digest").agg(F.min("id").alias("rep")))
    member = signed.select("doc", "id", "n", "digest").join(first, "digest", "left")
    member = member.withColumn("rep", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "id")))
    member = scale.cut_lineage(member)
    keys = known.join(first, "digest").where("id = rep").select("id", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    met = scale.cut_lineage(keys.join(scale.cut_lineage(full), "key"))
    if repeats:
        rows = rows.select("body", F.struct("doc", _digest("body").alias("digest")).alias("id")).dropDuplicates(["id"])
    else:
        rows = rows.withColumnRenamed("doc", "id")
    labels = _joined(rows, met)
    done = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    component = F.col("component.doc") if repeats else F.col("component")
    kept = F.coalesce(F.col("component") == F.col("id"), F.lit(True))
    return done.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "digest", component.alias("component_id"), kept.alias("kept")), repeats


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked id), kept (the first of its component by id, then set digest).

    Null or wordless text: empty set, linked with nothing. Null id: linked with nothing, component_id null, kept. Rows that
    repeat an id are compared each; those with equal sets are kept or not together. Other columns are ignored.
    """
    return _nodes(docs, doc_id, text)[0].drop("digest")


def _joined(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(id, label) of the representatives that share a band with another one."""
    ids = scale.cut_lineage(met.select("id").distinct())
    count = ids.count()
    labels = ids.select("id", F.col("id").alias("label"))
    if not count:
        return labels
    # the ids decide which texts are read again; beyond the bound the join shuffles instead
    wanted = F.broadcast(ids) if count <= BROADCAST_IDS else ids
    sets = scale.cut_lineage(rows.join(wanted, "id", "left_semi").select("id", _shingled("body").alias("shingles")))
    spread = sets.select("id", F.explode("shingles").alias("shingle"))
    shared = spread.groupBy("shingle").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("shingle")
    counted = spread.join(shared, "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    sizes = sets.select("id", F.size("shingles").cast("long").alias("n"))
    # a set of which less than three quarters are shared with anyone has no link
    facts = scale.cut_lineage(sizes.join(counted, "id").where(F.col("shared") * 100 >= PERCENT * F.col("n")))
    met = met.join(facts, "id")
    alone = F.struct(((F.col("n") - F.col("shared")) / F.col("n")).alias("part"), "id", "n", "shared")
    top = met.groupBy("key").agg(F.min(alone).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1")
    top = scale.cut_lineage(top.select("key", "size", F.col("c.id").alias("a")))
    met = scale.cut_lineage(met.join(top, "key"))
    stars = scale.cut_lineage(_common(met.where("a <> id").select("a", F.col("id").alias("b")).distinct(), sets))
    labels = _relabel(labels, stars.where("linked").select("a", "b"))
    met = met.join(stars.select("a", F.col("b").alias("id"), "common"), ["a", "id"], "left")
    met = scale.cut_lineage(met.select("key", "size", "id", "n", "shared", F.coalesce("common", "n").alias("inner")))
    for centres in (CENTRES, None):
        pairs = scale.cut_lineage(_crossing(met, labels, centres))
        if not pairs.isEmpty():
            labels = _relabel(labels, _common(pairs, sets).where("linked").select("a", "b"))
    return labels


def _crossing(met: DataFrame, labels: DataFrame, centres: int | None) -> DataFrame:
    """Pairs of different components that share a bucket: members against about so many centres of it, or all against all.

    inner counts a member's shingles in the bucket's first centre. Two members have at most the smaller inner number in
    common within that centre, and outside of it at most the smaller number of their other shared shingles.
    """
    named = met.join(labels, "id")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    named = scale.cut_lineage(named.join(scale.cut_lineage(mixed), "key"))
    own = named.groupBy("id").agg(F.collect_list("key").alias("keys"))  # one key a band at most
    named = named.join(own, "id")
    side = {x: named.select("key", "size", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "inner", "label", "keys")], (F.col("shared") - F.least("inner", "shared")).alias(f"{x}_outer")) for x in "ab"}
    left = side["a"]
    if centres is not None:  # by a hash of the id, so that all buckets of a group agree on their centres
        left = left.where(F.pmod(F.xxhash64("a_id"), F.col("size")) < centres)
    order = F.lit(True) if centres is not None else F.col("a_id") < F.col("b_id")
    most = F.least("a_inner", "b_inner") + F.least("a_outer", "b_outer")
    # a pair counts in one of its buckets only
    once = F.col("key") == F.array_min(F.array_intersect("a_keys", "b_keys"))
    pairs = left.drop("size").join(side["b"].drop("size"), "key").where((F.col("a_label") != F.col("b_label")) & order & _reaches(most, "a_n", "b_n") & once)
    return pairs.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each group: that with the smallest id. Rows without id stay.

    Of rows with one id and equal sets the first by the text's md5, then by a hash of all columns, stays.
    """
    found, repeats = _nodes(docs, doc_id, text)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest"))
    known, same = docs.where(F.col(doc_id).isNotNull()), F.col(doc_id).cast("long") == F.col("_kept_id")
    if not repeats:
        chosen = known.join(kept, same, "left_semi")
    else:
        known = known.withColumn("_digest", _digest(F.col(text).cast("string")))
        known = known.join(kept.distinct(), same & F.col("_digest").eqNullSafe(F.col("_kept_digest")), "left_semi")
        order = F.struct(F.md5(F.col(text).cast("binary")), F.xxhash64(*docs.columns))
        row = F.min_by(F.struct(*docs.columns), order).alias("_row")
        chosen = known.groupBy(F.col(doc_id).cast("long").alias("_id"), "_digest").agg(row).select("_row.*")
    return chosen.unionByName(docs.where(F.col(doc_id).isNull()))
