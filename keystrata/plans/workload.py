"""A deterministic workload of log rows and the keys that readers ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
LEVELS = ["INFO", "WARN", "ERROR"]
MESSAGES = [
    "user logged in", "user logged out", "order created", "order cancelled", "payment succeeded",
    "payment failed", "cache miss", "cache hit", "background job started", "background job finished",
]
MULTIPLIER, INCREMENT = 1664525, 1013904223
COLUMNS = {"level": "varchar", "message": "varchar", "ts": "timestamp"}


def _of(values: list[str], id_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (id_ % len(values) + 1).cast("int"))


def logs(spark: SparkSession, n: int, start_micros: int = 0) -> DataFrame:
    """id, level, message and ts (one millisecond apart) of n rows."""
    rows = spark.range(n)
    return rows.select("id", _of(LEVELS, F.col("id")).alias("level"), _of(MESSAGES, F.col("id")).alias("message"), F.timestamp_micros(F.col("id") * 1000 + start_micros).alias("ts"))


def sampled_keys(spark: SparkSession, n: int, max_id: int) -> DataFrame:
    """n keys below max_id by a linear congruence of their number; none if there are no ids."""
    return spark.range(n if max_id else 0).select("id", ((F.col("id") * MULTIPLIER + INCREMENT) % max(1, max_id)).alias("key"))
