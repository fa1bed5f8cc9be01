"""Shared-folder tables: the only place where intermediate results are kept.

Executors share nothing but ``spark.checkpoint.dir`` (and the inputs), so a cut
in the lineage is always a Parquet table below that folder.  Such a table
survives any lost executor; ``localCheckpoint`` and local temp files do not.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temp folder where unset (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="keystrata-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever written in place."""
    return f"{shared_dir(spark)}/keystrata-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in the lineage."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keystrata_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._keystrata_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are gone: its cleaner acts when the driver collects garbage."""
    for _ in range(2):  # what the first round lets go holds others
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


BROADCAST_BYTES = 32 << 20


def checked_broadcast(df: DataFrame, weight: Column) -> DataFrame:
    """df, marked for a broadcast only if its rows of about ``weight`` bytes each are small together."""
    total = df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
