"""Train/test splits that depend on row content only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_number(*columns: Column | str, seed: str = "") -> Column:
    """32-bit number from the md5 of the key; equal in every engine and on every layout."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    key = F.concat_ws("|", *([F.lit(seed)] if seed else []), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def in_share(*columns: Column | str, share: float, seed: str = "") -> Column:
    """True for about `share` of all keys."""
    return hash_number(*columns, seed=seed) % 10000 < int(round(share * 10000))


def hash_split(df: DataFrame, keys: list[str], test_share: float = 0.2, seed: str = "") -> DataFrame:
    """Add `split`, 'train' or 'test', without moving a row."""
    test = in_share(*keys, share=test_share, seed=seed)
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def train_and_test(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        labelled.where(F.col("split") == "train").drop("split"),
        labelled.where(F.col("split") == "test").drop("split"),
    )


def split_by_user(
    df: DataFrame,
    user: str = "user_name",
    item: str = "item",
    max_users: int | None = None,
    test_share: float = 0.2,
    seed: str = "",
) -> DataFrame:
    """Add `split`: a share of the items of every user, or of `max_users` sampled users if given, is 'test'."""
    if max_users is None:
        test = in_share(user, item, share=test_share, seed=seed)
        return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
    chosen = (
        df.select(user)
        .distinct()
        .orderBy(hash_number(user, seed=seed), user)
        .limit(max_users)
        .withColumn("_chosen", F.lit(True))
    )
    test = F.coalesce(F.col("_chosen"), F.lit(False)) & in_share(user, item, share=test_share, seed=seed)
    return (
        df.join(chosen, user, "left")
        .withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
        .drop("_chosen")
    )
