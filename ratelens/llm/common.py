"""What several operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens.session import materialize

#: Rows that one task numbers at a time; the number of buckets follows from it and the number of rows.
ROWS_PER_BUCKET = 65_536
#: Buckets at least, so that a few groups also spread over many tasks.
LEAST_BUCKETS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like `wanted` that no column of `df` bears, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def told_apart(df: DataFrame, *kept: str) -> tuple[DataFrame, dict[str, str]]:
    """`df` with a new name for each column that repeats an earlier one's, and the old names by the new. `kept` must be unique."""
    again = [c for i, c in enumerate(df.columns) if c in df.columns[:i] and c not in kept]
    names, old = fresh(df, *again), {}
    if not names:
        return df, old
    given, out = iter(names), []
    for i, c in enumerate(df.columns):
        out.append(next(given) if c in df.columns[:i] and c not in kept else c)
        old[out[-1]] = c
    return df.toDF(*out), old


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with these columns, which take the place of columns of the same name in any case."""
    lower = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lower]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, also where `body` uses it in a loop over an array."""
    return F.get(F.transform(F.array(value), body), 0)


def letters_lowered(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder_of_id(key: str, divisor: int) -> Column:
    """crc32 of the id as text modulo `divisor`; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def text_key(text: Column) -> list[Column]:
    """128 bits of a text, for grouping equal texts without moving them."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def number_within(
    df: DataFrame, groups: list[str], order: list[str], name: str, rows: int | None = None
) -> DataFrame:
    """Number the rows of every group from 0 without gaps, in no particular order.

    A group may hold any share of the rows: it is cut into buckets by a hash of `order`, each bucket is
    numbered in one task, and the bucket's first number comes from the sizes of the buckets before it.
    `order` should identify a row; rows that agree on it are interchangeable and share a bucket.
    """
    rows = df.count() if rows is None else rows
    buckets = max(LEAST_BUCKETS, math.ceil(rows / ROWS_PER_BUCKET))
    bucket, first, before, row = fresh(df, "bucket", "first", "before", "row")
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(*groups, bucket).agg(F.count("*").alias("n"))
    running = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select(*groups, bucket, F.coalesce(F.sum("n").over(running), F.lit(0)).alias(first)))
    starts = starts.select(*[F.col(g).alias(f"{before}_{g}") for g in groups], F.col(bucket).alias(before), first)
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    placed = dealt.withColumn(row, F.row_number().over(inside) - 1)
    same = placed[bucket] == starts[before]
    for g in groups:
        same = same & placed[g].eqNullSafe(starts[f"{before}_{g}"])
    joined = placed.join(starts, same)
    kept = [c for c in df.columns if c.lower() != name.lower()]
    return joined.select(*[placed[c] for c in kept], (F.col(row) + F.col(first)).cast("long").alias(name))
