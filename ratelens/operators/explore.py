"""Exploratory counts and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_count(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Number of different non-null values."""
    return df.agg(F.count_distinct(column).alias(name))


def histogram(df: DataFrame, column: str, low: float = 0.0, high: float = 200.0, bins: int = 200) -> DataFrame:
    """Counts in equal-width bins over [low, high]; the last bin is closed, empty bins count 0."""
    value = F.col(column).cast("double")
    filled = (
        df.where(value.between(low, high))
        .select(F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    width = (high - low) / bins
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(filled, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"),
        (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
