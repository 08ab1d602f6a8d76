"""Item feature tables for the models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.scalars import ascii_only

def clean_ascii(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: ascii_only(c) for c in columns})


def with_text_features(items: DataFrame, item_terms: DataFrame, key: str = "item") -> DataFrame:
    """Side data next to term columns, for items that have both."""
    return items.join(item_terms, key, "inner")


def one_hot_flags(df: DataFrame, key: str, column: str) -> DataFrame:
    """Long form (key, value, flag = 1), one row for each value that a row has: any number of values, no driver list."""
    return df.where(F.col(column).isNotNull()).select(key, F.col(column).alias("value"), F.lit(1).alias("flag"))


def flag_names(values: list[str], prefix: str | None = None) -> list[str]:
    """ASCII column names of the values; a name that an earlier value has taken gets a number."""
    head, taken, names = "" if prefix is None else f"{prefix}_", set(), []
    for value in values:
        plain = name = head + value.encode("ascii", "ignore").decode()
        again = 1
        while name.lower() in taken:
            again += 1
            name = f"{plain}_{again}"
        taken.add(name.lower())
        names.append(name)
    return names


def one_hot_columns(df: DataFrame, column: str, values: list[str], prefix: str | None = None) -> DataFrame:
    """Replace a column by 0/1 columns `prefix_value`, one for each of `values`, without a shuffle.

    For a column with many values use `one_hot_flags` or `one_hot_vectors`.
    """
    flags = {
        name: F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for name, v in zip(flag_names(values, prefix), values)
    }
    return df.withColumns(flags).drop(column)


def one_hot_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sparse 0/1 vectors for columns with any number of values."""
    indexed = [f"{c}_index" for c in columns]
    stages = [
        StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_vector" for c in columns], dropLast=False),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop(*indexed)
