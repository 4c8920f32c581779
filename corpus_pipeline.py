"""From raw documents to token files: each stage's rows are written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns
of documents. Where a table repeats an id, near-dedup compares its texts each on its own; after mixing, ids repeat as often as a document is
taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartspark import scale
from chartspark.llm import book, decontaminate, language, mixing, near_dedup, token_files

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those of which no language has half of the letters."""
    return language.accepted(docs, book.language_model(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dedup.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.remove(docs, book.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, which is that of its Parquet rows; a row for each document of it, read back from them."""
    return token_files.read_documents(spark, token_files.write(docs, book.tokenizer_path(), order=token_files.stored_order()))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

# the language model and the token files are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    folder = f"{scale.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = book.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
