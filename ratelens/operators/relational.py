"""Keys, membership, support, duplicates and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.scalars import MISSING
from ratelens.operators.ordinals import top_k_per_group
from ratelens.session import materialize


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def frequent_keys(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """Keys with more than a given number of rows."""
    return counts_by(df, key).where(F.col("n") > more_than).select(key)


def min_support_filter(df: DataFrame, key: str, min_count: int) -> DataFrame:
    """Drop the rows of keys that have fewer than `min_count` rows."""
    rare = materialize(counts_by(df, key).where(F.col("n") < min_count).select(key))
    return df.join(rare, key, "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under a total order.

    The key's hash leads the grouping: long text keys are then sorted by a number first.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    return top_k_per_group(hashed, ["_hash", *keys], order, 1, name="_n").drop("_n", "_hash")


def only_unseen(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet; `stored` holds a key once."""
    return df.join(stored.select(key), key, "left_anti")


def only_listed(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a list that holds it once."""
    return df.join(allowed.select(key), key, "left_semi")


def attach_names(df: DataFrame, names: DataFrame, id_name: str) -> DataFrame:
    """Add the name that belongs to an id. The planner broadcasts `names` if it is small."""
    return df.join(names, id_name, "inner")


def complete_cases(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop("any", subset=list(columns) or None)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def most_common(df: DataFrame, column: str, without: str | None = MISSING) -> DataFrame:
    """One row: the most frequent value, the lowest one on a tie.

    Counting by value first keeps the state spread over tasks, unlike an aggregate that
    holds a map of all values.
    """
    present = df.where(F.col(column).isNotNull())
    if without is not None:
        present = present.where(F.col(column) != F.lit(without))
    return counts_by(present, column).orderBy(F.desc("n"), column).limit(1).select(column)


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, by count and then by value."""
    return counts_by(df, column).orderBy(F.desc("n"), column).limit(k)


def search_names(df: DataFrame, column: str, query: str, limit: int = 15) -> DataFrame:
    """Type-ahead: names that contain the query, case ignored."""
    return df.where(F.contains(F.lower(F.col(column)), F.lower(F.lit(query)))).orderBy(column).limit(limit)


def rows_of(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with one key; the value is bound as a literal, never pasted into SQL text."""
    return df.where(F.col(column) == F.lit(value))
