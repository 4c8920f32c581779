"""Exact duplicates by stateful streaming: keyed state on disk, never expired, and a look at the full bytes on hits.

The stream reads the files as they come. Its state, kept by RocksDB under the checkpoint folder, holds for each digest the
row that stays (largest id, then largest locator), its content locator (file and row number within it) and the number of
rows. Nothing is ever dropped from it, so a copy is found however late it comes; a restarted stream goes on where it was.

Rows whose digest the state has seen more than once are hits. Their texts are read again and compared byte by byte with the
text that the locator names. Rows that differ in spite of an equal digest are grouped by their whole texts instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark import scale

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
BROADCAST_DIGESTS = 100_000  # 6.4 MB of hexadecimal digits


def sha256(text: Column) -> Column:
    """Lowercase hex of the UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def _rows(docs: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest(F.col(text)).alias("digest"), locator.alias("locator"), *more)


def update_state(
    spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Run the stream over all files that are new since the last call; the state as digest, keep (doc_id, locator), n.

    With the same checkpoint folder a later call adds to the state. Without files_per_batch all new files are one batch.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern with one match, a path may be a folder of files or a single file
    keyed = _rows(reader.parquet(f"{path[:-1]}[{path[-1]}]"), doc_id, text, digest)
    state = keyed.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKS)
    try:
        # the state itself is the result; what each batch changed is not needed
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)
    held = spark.read.format("statestore").load(checkpoint)
    return held.select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))


def groups(
    spark: SparkSession, path: str, schema: T.StructType | None = None, checkpoint: str | None = None, doc_id: str = "doc_id",
    text: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None,
) -> DataFrame:
    """One row per row of the files: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the row with the largest id stays; null ids rank below all others, and of rows with the same id the one
    with the largest locator stays, so exactly one row of a group is kept. Null text counts as empty. A folder without rows
    gives none. Columns other than the two named are not read.
    """
    schema = schema or spark.read.parquet(path).schema
    checkpoint = checkpoint or f"{scale.shared_folder(spark)}/exact-dedup-{uuid.uuid4().hex}"
    state = scale.cut_lineage(update_state(spark, path, schema, checkpoint, doc_id, text, digest, files_per_batch))
    files = spark.read.schema(schema).parquet(path)
    rows = _rows(files, doc_id, text, digest)
    hits = state.where("n > 1")
    wanted = hits.select("digest", "keep")
    # the digests of hits decide which texts are read again; beyond the bound the join shuffles instead
    side = F.broadcast(wanted.select("digest")) if wanted.count() <= BROADCAST_DIGESTS else wanted.select("digest")
    texts = _rows(files, doc_id, text, digest, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    again = scale.cut_lineage(texts.join(side, "digest", "left_semi"))
    stays = again.join(wanted, "digest").where(F.col("keep.locator") == F.col("locator")).select("digest", F.col("body").alias("kept_body"))
    differ = again.join(stays, "digest").where(F.col("body") != F.col("kept_body")).select("doc_id", "digest", "locator", "body")
    differ = scale.cut_lineage(differ)
    found = rows.join(state, "digest")
    if differ.isEmpty():
        return found.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("keep.locator") == F.col("locator")).alias("kept"), "digest")
    return _regrouped(found, differ)


def _regrouped(found: DataFrame, differ: DataFrame) -> DataFrame:
    """The groups when rows share a digest but not their bytes: such rows are grouped by their texts."""
    own = differ.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "locator")).alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
    moved = differ.join(own, ["digest", "body"]).select("digest", "locator", "own_keep", "own_n")
    fewer = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    all_rows = found.join(moved, ["digest", "locator"], "left").join(fewer, "digest", "left")
    keep = F.coalesce("own_keep", "keep")
    size = F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0)))
    return all_rows.select("doc_id", keep["doc_id"].alias("keep_id"), size.alias("group_size"), (keep["locator"] == F.col("locator")).alias("kept"), "digest")
