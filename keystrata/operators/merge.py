"""Merge-on-read: the newest version of each key wins, tombstones go last."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key by ``order``; Spark cuts to one row a key and task before the shuffle."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def live(log: DataFrame, key: list[str], order: list[str], deleted: str = "_deleted") -> DataFrame:
    """``latest`` without deleted keys.  The merge comes first, so an older version can't come back."""
    return latest(log, key, order).where(~F.col(deleted))


def get(current: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the filter reaches the Parquet scan."""
    return current.where(F.col(key) == F.lit(value))


def multi_get(current: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return current.join(keys.select(key), key, "left_semi")


def multi_get_misses(current: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return keys.select(key).distinct().join(current.select(key), key, "left_anti")
