"""Scans with fixed schemas; filters and column lists reach the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratelens.schema import REVIEWS
from ratelens.sources.writers import USER_BUCKETS, user_bucket


def table(spark: SparkSession, path_or_name: str, columns: list[str] | None = None) -> DataFrame:
    """Whole Parquet folder, or a catalogue table when the name is no path."""
    df = spark.read.parquet(path_or_name) if "/" in path_or_name else spark.table(path_or_name)
    return df.select(*columns) if columns else df


def query(spark: SparkSession, sql: str, args: dict | None = None, **views: DataFrame) -> DataFrame:
    """SQL over named DataFrames; `args` binds values, so text is never pasted into a query."""
    return spark.sql(sql, args=args, **views)


def jdbc_table(
    spark: SparkSession,
    url: str,
    name: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Database table; with a partition column it is read by many tasks at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(properties or {}))
    if partition_column:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    return reader.load()


def jdbc_query(spark: SparkSession, url: str, sql: str, properties: dict[str, str] | None = None) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", sql).options(**(properties or {})).load()


def documents(
    spark: SparkSession,
    path: str,
    fields: list[str] | None = None,
    where: Column | None = None,
    schema: StructType = REVIEWS,
) -> DataFrame:
    """JSON-lines export of the review documents, with an optional filter and field list."""
    df = spark.read.schema(schema).json(path)
    if where is not None:
        df = df.where(where)
    return df.select(*fields) if fields else df


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    return df.select(field).distinct()


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Comma-separated file with a header line and quoting."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def rating_lines(spark: SparkSession, path: str, names: tuple[str, str, str] = ("taste", "user_id", "item_id")) -> DataFrame:
    """Plain comma-separated rating lines without quoting: the first three fields, as text.

    Every line equal to the header is dropped, not only the first one of a file.
    """
    header = ",".join(names)
    parts = F.split("value", ",")
    return (
        spark.read.text(path)
        .where(F.col("value") != F.lit(header))
        .select(*[F.try_element_at(parts, F.lit(i)).alias(n) for i, n in enumerate(names, start=1)])
    )


def user_predictions(spark: SparkSession, path: str, user_id: int, buckets: int = USER_BUCKETS) -> DataFrame:
    """Stored scores of one user; only that user's bucket folder is read."""
    bucket = user_bucket(F.lit(user_id), buckets)
    return spark.read.parquet(path).where((F.col("user_bucket") == bucket) & (F.col("user_id") == user_id))
