"""Benchmark decontamination: a broadcast set of hashed test windows, a scan of all document windows, verified hits.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. An item with ten words or
more gives all its runs of ten words, a shorter one is a single window. Tasks look each document window up by its hash and
compare the words themselves before a hit counts.

The broadcast holds the words of distinct test items, in blocks of at most ``block_bytes``. A benchmark beyond that is scanned
block by block, in one pass over the documents each, and the hits of a document are put together by its key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark import scale
from chartspark.llm import arrays

WINDOW_WORDS = 10
BLOCK_BYTES = 16 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("words", T.ArrayType(_SPAN)), T.StructField("spans", T.ArrayType(_SPAN)),
])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("words", _ARROW_SPANS), ("spans", _ARROW_SPANS)])


@dataclass
class _Windows:
    """Windows of one length, ordered by hash."""

    size: int
    keys: np.ndarray
    low: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    shift: np.uint64


class WindowIndex:
    """Lookup of hashed windows of the items (id, text); built once in each Python worker."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        self.names = [name for name, _ in items]
        data, offsets = arrays.text_view(pa.array([text for _, text in items], pa.large_string()))
        low = arrays.LOWER[data]
        starts, ends, hashes, first = arrays.words(data, offsets, _IS_WORD)
        self.words = [low[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
        counts = np.diff(first)
        self.by_size = []
        for length in sorted(set(np.minimum(counts[counts > 0], size).tolist())):
            runs = arrays.windows(hashes, length)
            owners = np.flatnonzero(counts >= size if length == size else counts == length)
            places = np.concatenate([np.arange(first[i], first[i + 1] - length + 1) for i in owners])
            item = np.repeat(owners, counts[owners] - length + 1)
            order = np.argsort(runs[places], kind="stable")
            ordered = runs[places][order]
            keys, low_ends = np.unique(ordered, return_index=True)
            bits = min(max(int(math.ceil(math.log2(len(keys) + 1))) + 5, 12), 26)
            seen = np.zeros(1 << bits, bool)
            shift = np.uint64(64 - bits)
            seen[keys >> shift] = True
            self.by_size.append(_Windows(length, keys, np.append(low_ends, len(ordered)), item[order], places[order], seen, shift))

    def scan(self, piece: pa.Array) -> list[tuple[int, list[str], list, list]]:
        """For each text: number of words, ids of items found, merged runs of hit words, the same as code point spans."""
        data, offsets = arrays.text_view(piece)
        starts, ends, hashes, first = arrays.words(data, offsets, _IS_WORD)
        found: dict[int, tuple[set, list]] = {}
        for group in self.by_size:
            runs = arrays.windows(hashes, group.size)
            at = np.flatnonzero(group.seen[runs >> group.shift])
            if not len(at):
                continue
            key = np.minimum(np.searchsorted(group.keys, runs[at]), len(group.keys) - 1)
            doc = np.searchsorted(first, at, side="right") - 1
            right = (group.keys[key] == runs[at]) & (at + group.size <= first[doc + 1])
            for w, k, d in zip(at[right].tolist(), key[right].tolist(), doc[right].tolist()):
                text = [arrays.LOWER[data[s:e]].tobytes() for s, e in zip(starts[w : w + group.size].tolist(), ends[w : w + group.size].tolist())]
                for i in range(group.low[k], group.low[k + 1]):
                    place = group.place[i]
                    if self.words[place : place + group.size] == text:
                        names, runs_hit = found.setdefault(d, (set(), []))
                        names.add(self.names[group.item[i]])
                        runs_hit.append((w, w + group.size))
        out = []
        for d, n in enumerate(np.diff(first).tolist()):
            if d not in found:
                out.append((n, [], [], []))
                continue
            names, hit = found[d]
            merged = merge(hit)
            here = data[offsets[d] : offsets[d + 1]]
            chars = np.concatenate([[0], np.cumsum((here & 0xC0) != 0x80)])  # code points before each byte
            spans = [(int(chars[starts[a] - offsets[d]]), int(chars[ends[b - 1] - offsets[d]])) for a, b in merged]
            base = int(first[d])
            out.append((n, sorted(names), [(a - base, b - base) for a, b in merged], spans))
        return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap put together, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _struct_rows(rows: list[tuple]) -> pa.Array:
    spans = lambda part: [{"start": a, "end": b} for a, b in part]
    return pa.array([{"n_words": n, "items": items, "words": spans(w), "spans": spans(s)} for n, items, w, s in rows], _ARROW_FOUND)


def _scanner(items: list[tuple[str, str]], size: int, spark: SparkSession) -> Callable[[Column], Column]:
    """A column function of text that looks up one block of items."""
    block, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = arrays.worker_cache("decontamination")
        if cache.get("windows", (None,))[0] != name:
            cache["windows"] = (name, WindowIndex(block.value, size))
        index = cache["windows"][1]
        for texts in batches:
            yield _struct_rows([row for piece in arrays.pieces(texts) for row in index.scan(piece)])
        arrays.give_back()

    return F.arrow_udf(found, _FOUND).asNondeterministic()  # so that no rule evaluates it twice


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Lists of distinct (id, text) with at most block_bytes of text each; only one list is on the driver at a time.

    Items go to cells by hash. There are so many cells that the fullest one, counted, stays within the bound; a single item beyond it is
    a block of its own. Neighbouring cells share a block while they fit.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("body")).where("length(body) > 0").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    if total <= block_bytes:
        yield [(r["id"], r["body"]) for r in items.collect()]
        return
    items = scale.cut_lineage(items)
    cells = 4 * -(-total // block_bytes)
    while True:
        cell = F.pmod(F.xxhash64("id", "body"), F.lit(cells))
        counted = items.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("body")).alias("size"), F.count(F.lit(1)).alias("n"))
        sizes = {r["cell"]: (r["size"], r["n"]) for r in counted.collect()}  # a few rows a block
        if all(size <= block_bytes or n == 1 for size, n in sizes.values()):
            break
        cells *= 2
    first, held = 0, 0
    for i in [*sorted(sizes), None]:
        if i is None or (held and held + sizes[i][0] > block_bytes):
            last = cells if i is None else i
            yield [(r["id"], r["body"]) for r in items.where((cell >= first) & (cell < last)).collect()]
            first, held = last, 0
        held += 0 if i is None else sizes[i][0]


def _merged_union(docs: DataFrame, benchmark: DataFrame, ids: tuple[str, str], texts: tuple[str, str], size: int, block_bytes: int) -> tuple[DataFrame, str]:
    """All columns of docs and one with what is found (n_words, items, words, spans) over all blocks, and the name of that one."""
    spark = docs.sparkSession
    scanners = (_scanner(block, size, spark) for block in _blocks(benchmark, ids[1], texts[1], block_bytes))
    body = F.col(texts[0]).cast("string")
    first, own = next(scanners), arrays.fresh_name(docs, "found")
    marked = docs.withColumn(own, first(body))
    key = F.xxhash64(F.coalesce(body, F.lit("")))
    more = None
    for scan in scanners:
        part = docs.select(F.col(ids[0]).alias("_id"), key.alias("_key"), scan(body).alias("_more")).where(F.size("_more.items") > 0)
        part = scale.cut_lineage(part)
        more = part if more is None else more.union(part)
    if more is None:
        return marked, own
    more = more.groupBy("_id", "_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_more.items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("_more.words"))).alias("words"), F.array_distinct(F.flatten(F.collect_list("_more.spans"))).alias("spans"),
    )
    # the table's own columns travel in one struct, so their names meet no others
    packed = marked.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(ids[0]).alias("id"), key.alias("key"), F.col(own).alias("found"))
    joined = packed.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    both = lambda name: _merged(F.concat(F.col(f"found.{name}"), F.coalesce(F.col(name), F.array().cast(T.ArrayType(_SPAN)))))
    items = F.array_sort(F.array_distinct(F.concat("found.items", F.coalesce("items", F.array().cast("array<string>")))))
    found = F.struct(F.col("found.n_words").alias("n_words"), items.alias("items"), both("words").alias("words"), both("spans").alias("spans"))
    return joined.select("row.*", found.alias(own)), own


@F.arrow_udf(T.ArrayType(_SPAN))
def _merged(spans: pa.Array) -> pa.Array:
    rows = [[{"start": a, "end": b} for a, b in merge([(s["start"], s["end"]) for s in row])] for row in spans.to_pylist()]
    return pa.array(rows, _ARROW_SPANS)


def find(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit (words inside any window found), items (sorted ids), spans (code points).

    Null or wordless texts have no words and no hits; items without words have no window. A null item id counts as the
    empty string, rows that repeat an item id are one item. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("body"))
    found, own = _merged_union(rows, benchmark, ("doc_id", item_id), ("body", item_text), size, block_bytes)
    found = found.select("doc_id", f"{own}.*")
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + w["end"] - w["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans")


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and cuts:
            edges = [0, *[x for s in cuts for x in (s["start"], s["end"])], len(text)]
            text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
        out.append(text)
    return pa.array(out, pa.string())


def remove(
    docs: DataFrame, benchmark: DataFrame, what: str = "documents", doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with the same columns, without contaminated documents, or (what="spans") with the hit words cut out of the texts."""
    if what not in ("documents", "spans"):
        raise ValueError("what is documents or spans")
    found, own = _merged_union(docs, benchmark, (doc_id, item_id), (text, item_text), size, block_bytes)
    if what == "documents":
        return found.where(F.size(f"{own}.items") == 0).drop(own)
    return found.withColumn(text, _without(F.col(text).cast("string"), F.col(f"{own}.spans"))).drop(own)
