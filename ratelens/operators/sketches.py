"""Counts that are kept per batch and merged without reading the batches' rows again.

A batch leaves one row for each group: its number of rows, which adds up exactly, and a sketch of the distinct values, a few
KB at most whatever their number. Merging reads these rows alone. A batch that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base 2 logarithm of the sketch's size; the estimate's standard error is about 1 / sqrt(2 ** LOG_SIZE), 1.6 %.
LOG_SIZE = 12


def batch_counts(rows: DataFrame, group: str, distinct: str, log_size: int = LOG_SIZE) -> DataFrame:
    """(group, n, sketch): rows of each group and a sketch of its different values of `distinct`; nulls count as rows alone."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, log_size).alias("sketch"))


def write_batch(counts: DataFrame, path: str, batch: int) -> None:
    """Keep a batch's counts below `path`; a batch that is there already is replaced."""
    counts.write.mode("overwrite").parquet(f"{path}/batch={int(batch)}")


def merged_counts(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(group, n, about): over all batches below `path` the rows of each group, exactly, and its different values, estimated."""
    kept = spark.read.parquet(path)
    merged = kept.groupBy(group).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))
    return merged.select(group, "n", F.hll_sketch_estimate("sketch").alias("about"))
