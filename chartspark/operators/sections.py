"""Repeated word sections of long texts by seed and extend.

Every run of three words is linked to its next occurrence at least one block further on, so a text of n words has at most n links,
however often a run occurs. Links of one offset whose places follow each other are exact repeats; repeats that follow each
other closely at nearly the same offset are chained into one section with changed words. Only chains are compared word by
word. A block then stretches over its neighbouring words as far as the similarity allows. Sections are chosen greedily, the longest and most alike first, so that no word counts twice.

Links and runs are sought inside a text's row; what is shuffled are runs, and the words of texts that may have a chain.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark import scale
from chartspark.functions.text import JOINER, nfc

_PAIR = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("a", "a_end", "b", "b_end")], T.StructField("similarity", T.DoubleType())])
_RUN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("offset", "start", "words")])

#: Bytes of texts that are looked at together; a longer text is looked at alone.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class SectionRules:
    """Fixed values of the sections: words of a block, difference of lengths, similarity; and how close chained repeats lie."""

    min_words: int = 8
    max_words: int = 100
    length_difference: float = 0.20
    similarity: float = 0.80
    seed_words: int = 3
    chain_gap: int = 8
    offset_band: int = 16


DEFAULT_RULES = SectionRules()


def section_tokens(text: str | Column) -> Column:
    """Lower-case words without section tags and punctuation."""
    body = F.regexp_replace(F.lower(nfc(text)), r"\[[^\]]*\]", " ")
    return F.array_remove(F.split(F.regexp_replace(body, r"[^\p{L}\p{N}_]+", " "), " "), "")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before, and for the first row."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _links(words: np.ndarray, text: np.ndarray, rules: SectionRules) -> tuple[np.ndarray, np.ndarray]:
    """Places of seeds and how much later they stand again, at least a block; words are numbers, text is the text of each."""
    k = rules.seed_words
    at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :])
    mixed = text[at].astype(np.uint64)
    for i in range(k):
        mixed = (mixed ^ words[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    new = np.append(_changes(mixed[order]), True)
    at = at[order[~(new[:-1] & new[1:])]]  # the few that may stand again are told apart by their words
    seed = [text[at], *(words[at + i] for i in range(k))]
    order = np.lexsort((at, *seed[::-1]))
    at = at[order]
    group = np.cumsum(_changes(*(c[order] for c in seed)))
    place = group * (len(words) + rules.min_words) + at
    later = np.searchsorted(place, place + rules.min_words)
    known = np.flatnonzero(later < len(at))
    known = known[group[later[known]] == group[known]]
    return at[known], at[later[known]] - at[known]


def _runs_of(texts: pa.Array, rules: SectionRules) -> pa.ListArray:
    """The runs of each text, given as joined words: links of one offset whose places follow each other."""
    lists = pc.split_pattern(texts, JOINER)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    words = lists.flatten().dictionary_encode().indices.to_numpy()
    at, offset = _links(words, text, rules) if len(words) >= rules.seed_words else (first[:0], first[:0])
    order = np.lexsort((at, offset, text[at]))
    at, offset = at[order], offset[order]
    starts = np.flatnonzero(_changes(text[at], offset, at - np.arange(len(at))))
    length = np.diff(starts, append=len(at)) + (rules.seed_words - 1)
    owner = text[at[starts]]
    values = [offset[starts], at[starts] - first[owner], length]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in values], _RUN.names))


def _with_runs(df: DataFrame, key: str, tokens: str, rules: SectionRules) -> DataFrame:
    """(key, n, _joined, _runs) of every text, n being the number of its words; made in one pass over the words, without a shuffle.

    Words are joined on their way to Python, so none may hold the joiner; texts shorter than two blocks have neither words nor runs.
    """

    def listed(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        parts, at = [_runs_of(texts[:0], rules)], 0
        while at < len(texts):
            stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, side="right")), at + 1)
            parts.append(_runs_of(texts[at:stop], rules))
            at = stop
        return pa.concat_arrays(parts)

    runs = F.arrow_udf(listed, T.ArrayType(_RUN)).asNondeterministic()  # so that no rule evaluates it twice
    joined = F.when(F.size(tokens) >= 2 * rules.min_words, F.array_join(tokens, JOINER, ""))
    return df.select(key, F.size(tokens).alias("n"), joined.alias("_joined")).select("*", runs("_joined").alias("_runs"))


def section_runs(df: DataFrame, key: str, tokens: str, rules: SectionRules = DEFAULT_RULES) -> DataFrame:
    """(key, n, offset, start, words): maximal runs of words that stand again offset words later, from links to the next occurrence.

    n is the number of the text's words. Texts shorter than two blocks have no runs; key is one row a text.
    """
    return _with_runs(df, key, tokens, rules).select(key, "n", F.inline("_runs"))


def _stored(df: DataFrame, key: str, tokens: str, rules: SectionRules) -> DataFrame:
    """Texts with their runs, written once. Only texts that may have a chain, two runs whose offsets could share a band, keep their words."""
    offsets = F.sort_array("_runs.offset")
    nearest = F.array_min(F.zip_with(offsets, F.slice(offsets, 2, F.size(offsets)), lambda low, high: high - low))
    words = F.when(nearest < rules.offset_band, F.split("_joined", JOINER))
    return scale.cut_lineage(_with_runs(df, key, tokens, rules).select(key, "n", "_runs", words.alias("_words")))


def _chains(runs: DataFrame, key: str, rules: SectionRules) -> DataFrame:
    """Runs that follow each other within a band of offsets, as blocks: key, n, a, a_end, b, b_end, exact.

    Bands overlap by half, so that neighbours meet in one of them.
    """
    width, half = rules.offset_band, rules.offset_band // 2
    bands = F.array(F.floor(F.col("offset") / width) * 2, F.floor((F.col("offset") + half) / width) * 2 + 1)
    rows = runs.withColumn("band", F.explode(bands)).withColumn("end", F.col("start") + F.col("words"))
    order = W.partitionBy(key, "band").orderBy("start", "offset")
    apart = F.col("start") - F.lag("end").over(order) > rules.chain_gap
    linked = rows.withColumn("chain", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    shifted = F.col("start") + F.col("offset")
    found = linked.groupBy(key, "n", "band", "chain").agg(
        F.min("start").alias("a"), F.max("end").alias("a_end"), F.min(shifted).alias("b"), F.max(shifted + F.col("words")).alias("b_end"), F.count(F.lit(1)).alias("runs"),
    )
    chained = found.where("runs > 1").select(key, "n", "a", "a_end", "b", "b_end", F.lit(False).alias("exact"))
    single = runs.select(key, "n", F.col("start").alias("a"), (F.col("start") + F.col("words")).alias("a_end"), shifted.alias("b"), (shifted + F.col("words")).alias("b_end"), F.lit(True).alias("exact"))
    return chained.unionByName(single).distinct()


def _candidates(texts: DataFrame, key: str, rules: SectionRules) -> DataFrame:
    """(key, n, a, a_end, b, b_end, similarity, period): pairs of blocks, b after a, that match as they are.

    A block beyond the longest is cut into such blocks. A run that reaches into its own copy is a period; its longest multiple that
    fits gives blocks beside each other. What matches may be shorter than a block, if stretching makes it one.
    """
    low, high = math.ceil(rules.min_words * rules.similarity), rules.max_words
    shift, length = F.col("b") - F.col("a"), F.col("a_end") - F.col("a")
    periodic = (length > shift) & (shift <= high // 2)
    reach = length + shift
    stride = shift * F.greatest(F.lit(1), F.least(F.floor(reach / (shift * 2)), F.floor(F.lit(high) / shift)))
    move, size, step = F.when(periodic, stride).otherwise(shift), F.when(periodic, stride).otherwise(high), F.when(periodic, stride * 2).otherwise(high)
    rows = _chains(texts.select(key, "n", F.inline("_runs")), key, rules).where((length >= low) & (F.col("b_end") - F.col("b") >= low))
    rows = rows.withColumns({"period": periodic, "move": move, "size": size, "step": step.cast("int"), "stop": F.when(periodic, F.col("a_end") + shift - stride).otherwise(F.col("a_end")).cast("int")})
    parts = rows.withColumn("p", F.explode(F.sequence(F.col("a"), F.col("stop") - 1, F.col("step"))))
    whole = (F.col("step") == high) & (F.col("a_end") - F.col("a") <= high)
    parts = parts.select(
        key, "n", F.col("p").alias("a"), F.least(F.col("p") + F.col("size"), F.col("stop")).alias("a_end"), (F.col("p") + F.col("move")).alias("b"),
        F.when(whole & ~F.col("exact"), F.least(F.col("b_end"), F.col("b") + high)).otherwise(F.least(F.col("p") + F.col("size"), F.col("stop")) + F.col("move")).alias("b_end"), "exact", "period",
    )
    la, lb = F.col("a_end") - F.col("a"), F.col("b_end") - F.col("b")
    near = F.floor(la * (1 - rules.length_difference)).cast("int"), F.floor(la * (1 + rules.length_difference)).cast("int")
    parts = parts.where((la >= low) & (F.col("a_end") <= F.col("b")) & (lb >= low) & (lb <= high) & (lb >= near[0]) & (lb <= near[1]))
    compared = parts.where(~F.col("exact")).join(texts.where("_words IS NOT NULL").select(key, "_words"), key)
    cut = lambda a, b: F.array_join(F.slice("_words", F.col(a) + 1, F.col(b) - F.col(a)), " ")
    compared = compared.withColumn("similarity", sequence_similarity(cut("a", "a_end"), cut("b", "b_end"))).where(F.col("similarity") >= rules.similarity)
    columns = [key, "n", "a", "a_end", "b", "b_end", "similarity", "period"]
    return parts.where("exact").withColumn("similarity", F.lit(1.0)).select(columns).unionByName(compared.select(columns)).distinct()


@F.pandas_udf(T.DoubleType())
def sequence_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two word sequences, every word counted."""
    return pd.Series([SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio() for a, b in zip(left, right)], dtype="float64")


sequence_similarity = sequence_similarity.asNondeterministic()  # so that a filter does not evaluate it a second time


def stretched(n: int, pair: tuple, rules: SectionRules) -> tuple:
    """Both blocks of a pair longer by equally many words, to the left first, as far as text, the other block and similarity allow."""
    a, a_end, b, b_end, similarity, period = pair
    if period:  # its neighbours are blocks of their own
        return pair[:5]
    both, gap, tail = a_end - a + b_end - b, b - a_end, n - b_end
    alike = math.floor((similarity * both / rules.similarity - both) / 2 + 1e-9)
    more = max(min(alike, (a + gap + tail) // 2, a + gap, gap + tail, rules.max_words - max(a_end - a, b_end - b)), 0)
    left = min(more, a)
    a, a_end = a - left, a_end + more - left
    left = min(more, b - a_end)
    return a, a_end, b - left, b_end + more - left, similarity * both / (both + 2 * more)


def chosen(n: int, pairs: list[tuple], rules: SectionRules) -> list[tuple]:
    """Stretched pairs, longer ones first, then more similar ones, then those that start first, without any that touch words already taken."""
    full = {stretched(n, p, rules) for p in pairs}
    full = [p for p in full if min(p[1] - p[0], p[3] - p[2]) >= rules.min_words]
    starts, ends, kept = [], [], []
    for pair in sorted(full, key=lambda p: (-min(p[1] - p[0], p[3] - p[2]), -p[4], p)):
        blocks = (pair[0:2], pair[2:4])
        places = [bisect_right(starts, low) for low, _ in blocks]
        if all((i == 0 or ends[i - 1] <= low) and (i == len(starts) or starts[i] >= high) for i, (low, high) in zip(places, blocks)):
            kept.append(pair)
            for low, high in blocks:
                i = bisect_right(starts, low)
                starts.insert(i, low)
                ends.insert(i, high)
    return kept


def repeated_sections(df: DataFrame, key: str, tokens: str, rules: SectionRules = DEFAULT_RULES) -> DataFrame:
    """(key, a, a_end, b, b_end, similarity) of the chosen sections, in words from 0, ends exclusive.

    A text is one row; its candidates, at most a few for eight words, are chosen together.
    """
    return _sections(_stored(df, key, tokens, rules), key, rules)


def _sections(texts: DataFrame, key: str, rules: SectionRules) -> DataFrame:
    names = _PAIR.names

    @F.pandas_udf(T.ArrayType(_PAIR))
    def choice(sizes: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, p)) for p in chosen(n, [tuple(row[c] for c in (*names, "period")) for row in rows], rules)] for n, rows in zip(sizes, lists)])

    lists = _candidates(texts, key, rules).groupBy(key, "n").agg(F.collect_list(F.struct(*names, "period")).alias("all"))
    return lists.select(key, F.explode(choice("n", "all")).alias("one")).select(key, "one.*")


def section_repetition(df: DataFrame, key: str, tokens: str, rules: SectionRules = DEFAULT_RULES) -> DataFrame:
    """(key, sections, section_words, status) of every text: NULL for empty texts and those shorter than two blocks, else a count.

    Repeated keys are not allowed; NULL tokens count as none.
    """
    texts = _stored(df, key, tokens, rules)
    size = F.coalesce("n", F.lit(0))
    counts = _sections(texts, key, rules).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("a_end") - F.col("a") + F.col("b_end") - F.col("b")).alias("_w")
    )
    status = F.when(size <= 0, "empty_lyrics").when(size < 2 * rules.min_words, "insufficient_lyrics").otherwise("success")
    known = lambda c: F.when(F.col("status") == "success", F.coalesce(F.col(c), F.lit(0)))
    return texts.select(key, status.alias("status")).join(counts, key, "left").select(key, known("_n").alias("sections"), known("_w").alias("section_words"), "status")
