"""Contiguous byte-balanced shards from global prefix sums [native].

Rows are put in id order by a range partitioning, each partition's totals are
summed, and the totals' prefix sums (one row a partition) are added to the
running sums inside the partitions.  No window runs over the whole table, and
only (id, size, crc) is ever shuffled, never a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise, shuffle_width

ROW_OVERHEAD = 16


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16.  In id order a row whose bytes span
    [a, a+size) of the total T goes to shard floor((a + size/2) * n / T), so each
    shard is a contiguous id range within half a row of T/n bytes at either end.
    Null text counts as empty (size 16, crc 0).  Null ids sort first; rows with
    equal ids are told apart by their place in the input.  An empty table gives
    no rows.  A row larger than T/n fills its shard alone and may leave a
    neighbour empty.  Other columns are ignored, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("_size"),
        F.crc32(text).alias("_crc"),
    ).withColumn("_tie", F.monotonically_increasing_id())
    # Written first: the range partitioning samples its input, which would read all texts twice.
    slim = materialise(slim, "shard-sizes")
    order = [F.col("_id").asc_nulls_first(), F.col("_tie")]
    # The partition number is stored with the row, so a recomputed task can't deal rows anew.
    dealt = materialise(
        slim.repartitionByRange(shuffle_width(spark), *order).withColumn("_pid", F.spark_partition_id()), "shard-ranges"
    )
    totals = dealt.groupBy("_pid").agg(F.sum("_size").alias("_psize"), F.count("*").alias("_prows"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_pid",
        F.coalesce(F.sum("_psize").over(before), F.lit(0)).alias("_size0"),
        F.coalesce(F.sum("_prows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_psize").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.withColumn("_end", F.sum("_size").over(inside))
        .withColumn("_nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "_pid")
        .withColumn("_mid2", 2 * (F.col("_size0") + F.col("_end")) - F.col("_size"))
        .withColumn("shard", F.expr(f"cast((_mid2 * {n_shards}L) div (2 * _total) as int)"))
        .withColumn("_row", F.col("_row0") + F.col("_nth") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
