"""Language of lines by word weights learned from labelled texts.

The model is a table of every word that occurs in a labelled text, with one weight per language: the logarithm of the word's
smoothed share of that language's words. A line belongs to the language with the largest sum over its known words (naive
Bayes with equal priors). Nothing of the vocabulary is a literal or reaches the driver. Blocks of lines ask for each of their words
once; these are joined to the table, small vocabularies broadcast by Spark itself, large ones by shuffle, and go back to their block,
where the lines are summed. So a word that is common in a block moves once, whatever its occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspark import scale
from chartspark.functions import text as X

WORD_BREAK = r"[^\p{L}]+"
BLOCK_LINES = 16_384  # lines whose words are looked up together
DIGITS = 9  # sums that differ by less are ties


def languages_of(df: DataFrame, language: str) -> list[str]:
    """The labels in use, in order: one row a language."""
    return [r[0] for r in df.select(language).distinct().where(F.col(language).isNotNull()).orderBy(language).collect()]


def word_weights(df: DataFrame, text: str, language: str) -> DataFrame:
    """(word, weights): weight of a word in each language of languages_of(), in that order; written once."""
    labelled = df.where(F.col(language).isNotNull()).select(F.col(language).alias("language"), F.col(text).alias("text"))
    words = labelled.select("language", F.explode(F.split(F.lower("text"), WORD_BREAK)).alias("word")).where("word <> ''")
    counts = scale.cut_lineage(words.groupBy("word", "language").agg(F.count(F.lit(1)).alias("n")))
    names = languages_of(df, language)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("language") == name, F.col("n"))), F.lit(0).cast("bigint"))
    wide = counts.groupBy("word").agg(F.array(*[of(n) for n in names]).alias("n"))
    whole = counts.agg(F.array(*[of(n) for n in names]).alias("total"), F.count_distinct("word").alias("size"))
    one_row = wide.crossJoin(F.broadcast(whole))  # the totals are one row
    weights = F.transform("n", lambda n, i: F.log((n + 1) / (F.element_at("total", i + 1) + F.col("size"))))
    return scale.cut_lineage(one_row.select("word", weights.alias("weights")))


def _asked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a block once; rows of a block follow each other."""
    asker, held = None, []

    def given() -> pa.RecordBatch:
        words = pc.unique(pa.concat_arrays(held))
        return pa.record_batch([pa.repeat(pa.scalar(asker, pa.int64()), len(words)), words], names=["asker", "word"])

    for batch in batches:
        of = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            if stop > start:
                if held and of[start] != asker:
                    yield given()
                    held = []
                asker = int(of[start])
                held.append(pc.unique(pc.split_pattern(batch.column(1).slice(start, stop - start), " ").flatten()))
    if held:
        yield given()


def _line_sums(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums of the word weights of each line of a block, n a line; NULL for lines without a known word."""

    def sums(lines: pa.Table, told: pa.Table) -> pa.Table:
        lists = pc.split_pattern(lines.column("words").combine_chunks(), " ")
        at = pc.index_in(lists.flatten(), told.column("word").combine_chunks())
        line = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        line, at = line[known], pc.drop_null(at).to_numpy(zero_copy_only=False)
        table = told.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        score = np.stack([np.bincount(line, table[at, i], len(lists)) for i in range(n)], axis=1)
        some = np.bincount(line, minlength=len(lists)) > 0
        offsets = np.zeros(len(lists) + 1, np.int32)
        np.cumsum(some * n, out=offsets[1:])
        column = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~some, False)), pa.array(score[some].reshape(-1), pa.float64()))
        return lines.drop_columns(["block", "words"]).append_column("score", column)

    return sums


def line_languages(df: DataFrame, key: str, text: str, weights: DataFrame, names: list[str]) -> DataFrame:
    """(key, line_no, letter counts, line_language) of every clean line.

    A dominant script wins and short lines have no language; the rest take the largest weight sum, first name on ties, and
    none where no word is known. key identifies a text. Lines of NULL or empty texts do not exist.
    """
    lines = df.select(key, F.posexplode(X.clean_lines(text)).alias("line_no", "line"))
    facts = X.line_scripts(lines, "line").withColumn("_open", F.col("readable") & F.col("script_language").isNull())
    carried = ["latin", *X.SCRIPTS, "script_total", "script_language"]
    # words hold letters only; a text of them is far smaller on its way than an array
    spoken = F.when(F.col("_open"), F.array_join(F.filter(F.split(F.lower("line"), WORD_BREAK), lambda w: w != ""), " ")).otherwise(F.lit(""))
    # numbers of task and row make blocks of neighbouring lines; written once, so that a task run again finds the same blocks
    block = F.struct(F.spark_partition_id().alias("part"), F.floor((F.monotonically_increasing_id() % (1 << 33)) / BLOCK_LINES).alias("place"))
    stored = scale.cut_lineage(facts.select(key, "line_no", *carried, spoken.alias("words")).withColumn("block", F.xxhash64(block["part"], block["place"])))
    # a block asks for each of its words once, and gets the weights of those that are known; an asker that is cut by a split asks twice
    asked = stored.select(F.col("block").alias("asker"), "words").where("words <> ''").mapInArrow(_asked_words, "asker long, word string")
    told = asked.join(weights, "word").select("asker", "word", "weights")
    scored = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stored.schema if f.name not in ('block', 'words'))}, score array<double>"
    sums = stored.groupBy("block").cogroup(told.groupBy("asker")).applyInArrow(_line_sums(len(names)), scored)
    ranked = F.array(*[
        F.struct(F.round(F.element_at("score", i + 1), DIGITS).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, n in enumerate(names)
    ])
    guess = F.when(F.element_at("score", 1).isNotNull(), F.array_max(ranked)["name"])
    return sums.select(key, "line_no", *[c for c in carried if c != "script_language"], F.coalesce("script_language", guess).alias("line_language"))


def document_languages(df: DataFrame, key: str, text: str, weights: DataFrame, names: list[str]) -> DataFrame:
    """(key, language, shares) of every text by letter-weighted votes of its lines; texts without lines are unknown."""
    votes = line_languages(df, key, text, weights, names)
    rows = df.select(key).distinct().join(votes, key, "left")
    return X.vote_language(rows, key, names)
