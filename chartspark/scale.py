"""Lineage cuts, spreading and join helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def input_bytes(df: DataFrame) -> int:
    """Bytes of all leaf relations of the plan, from file metadata; runs no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a local one only in local mode with none set."""
    sc = spark.sparkContext
    shared = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="chartspark-checkpoint-")
        spark.conf.set(CHECKPOINT_KEY, shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder and read back.

    Lost executors do not lose them, later passes do not repeat the work before, and the planner knows their true size.
    """
    path = f"{shared_folder(df.sparkSession)}/chartspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def salted_keys(df: DataFrame, salt: str, pieces: int, *spread_by: str) -> DataFrame:
    """Add a salt in [0, pieces) taken from a hash of other columns, so a hot key spreads over tasks."""
    return df.withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(pieces)).cast("int"))


def join_back(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join one row per key onto every row of the key.

    facts holds one row per key, so a hot key makes only the df side long; the adaptive skew join splits that side.
    """
    return df.join(facts, keys, how)


def spread_for_cpu(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows whose bytes are few but whose work per row is heavy; as many pieces as the session shuffles into."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pieces_of(df: DataFrame, *keys: str, piece: int = 8 << 20) -> DataFrame:
    """Hash-partition by keys that have few rows each, in as many pieces as the input has of the given bytes, so that a task stays small."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-input_bytes(df) // piece)), *keys)


def enough_partitions(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table whose few large files would leave cores idle; a table with many splits stays as it is."""
    spark = df.sparkSession
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()  # the setting may have a unit
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if input_bytes(df) // split + 1 < cores else df
