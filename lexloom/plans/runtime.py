"""Lineage cuts and sizing helpers.

Intermediate results that are read more than once are written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` (shared by all executors, so a lost executor costs a re-read, never a recompute of lost
blocks). A private folder is used only where the session names none, as in local tests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task joins; keys with more are cut into parts. There are at most rows / HOT_ROWS such keys.
HOT_ROWS = 200_000

_private: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's ``spark.checkpoint.dir`` or, where unset and all runs in one process, one of our own.

    Elsewhere a missing setting is an error: executors on several machines would each write to their own disk."""
    global _private
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not single_process(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _private is None:
        _private = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, _private, ignore_errors=True)
    return f"file://{_private}"


def single_process(master: str) -> bool:
    """Whether a master runs everything on this machine's driver."""
    return master == "local" or master.startswith("local[")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and return a scan of it (same schema, no lineage).

    The file system deletes the folder when the driver's JVM ends, whatever its scheme."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.option("compression", "zstd").parquet(path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, per_block: int) -> int:
    """Partitions so that none holds more than about ``per_block`` rows."""
    return max(1, -(-rows // per_block))


def unique_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join on ``key``, of which ``right`` has one row each but ``left`` may have most of its rows. Hot keys are cut into parts by
    the hash of ``by``; only their row of ``right`` is repeated. The list of hot keys is at most rows / hot_rows long."""
    hot = left.groupBy(key).count().filter(F.col("count") > hot_rows).select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts"))
    hot = F.broadcast(materialize(hot, "hot"))
    one = F.coalesce("_parts", F.lit(1))
    cut = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), one).cast("int")).drop("_parts")
    again = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), one - 1))).drop("_parts")
    return cut.join(again, [key, "_part"], how).drop("_part")
