"""Explicit-bucket histograms: a bucket holds values up to and with its bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
MICROSECOND_BOUNDS = [50.0, 100.0, 250.0, 500.0, 1_000.0, 2_500.0, 5_000.0, 10_000.0, 25_000.0, 50_000.0, 100_000.0, 250_000.0, 500_000.0, 1_000_000.0, 2_000_000.0, 5_000_000.0]
MILLISECOND_BOUNDS = [1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1_000.0, 2_500.0, 5_000.0]


def bounds_of(metric: str) -> list[float]:
    """The bounds that a metric's suffix calls for."""
    if metric.endswith("_duration_us"):
        return MICROSECOND_BOUNDS
    if metric.endswith("_duration_ms"):
        return MILLISECOND_BOUNDS
    raise ValueError(f"{metric} is no duration")


def bucket_counts(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Rows of each bucket; the one past the last bound takes the rest.  Null values are left out."""
    bucket = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col(value) <= b, F.lit(i)).otherwise(bucket)
    return df.where(F.col(value).isNotNull()).groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
