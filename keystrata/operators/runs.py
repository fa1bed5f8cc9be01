"""Reports on runs and the sparse block index of a sorted run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inventory(log: DataFrame, run: str, key: str, deleted: str = "_deleted") -> DataFrame:
    return log.groupBy(run).agg(
        F.count("*").alias("entries"),
        F.countDistinct(key).alias("distinct_keys"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.count_if(deleted).alias("tombstones"),
    )


def positions(df: DataFrame, key: str) -> DataFrame:
    """The key and its 0-based place in key order, by per-partition prefix sums instead of one global window."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select(key).repartitionByRange(n, key).withColumn("_pid", F.spark_partition_id())
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_pid").agg(F.count("*").alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_pid").orderBy(key)
    return dealt.withColumn("_k", F.row_number().over(inside)).join(F.broadcast(totals), "_pid").select(key, (F.col("_from") + F.col("_k") - 1).alias("place"))


def sparse_index(df: DataFrame, key: str, block_size: int) -> DataFrame:
    """First and last key and entries of each block of ``block_size`` keys."""
    block = F.expr(f"place div {block_size}").alias("block")
    return positions(df, key).groupBy(block).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("entries"))


def floor_seek(keys: DataFrame, key: str, index: DataFrame, first: str) -> DataFrame:
    """Greatest ``first`` not above each key (a backward as-of).  Keys below every block have no row.

    One sort by key: index rows stand before equal keys, and the last index value
    seen so far is the answer.  Ranges are linked by their maxima, one row each.
    """
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = index.select(F.col(first).alias("_k"), F.col(first).alias("_f")).unionByName(keys.select(F.col(key).alias("_k"), F.lit(None).cast(index.schema[first].dataType).alias("_f")))
    dealt = both.repartitionByRange(n, "_k").withColumn("_pid", F.spark_partition_id())
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("_pid").agg(F.max("_f").alias("_m")).select("_pid", F.max("_m").over(before).alias("_before"))
    inside = Window.partitionBy("_pid").orderBy(F.col("_k"), F.col("_f").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        dealt.withColumn("_in", F.max("_f").over(inside))
        .where("_f is null")
        .join(F.broadcast(carried), "_pid")
        .select(F.col("_k").alias(key), F.coalesce("_in", "_before").alias(first))
        .where(F.col(first).isNotNull())
    )
