"""Prediction quality over a `scored` table (actual, prediction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bound of a low rating under each rule.
BIASED_LOW = 5
BOTH_LOW = 6


def is_match(rule: str = "biased", actual: str = "actual", prediction: str = "prediction") -> Column:
    """Does a prediction count as right?

    "biased": high ratings need an error below 1, low ones (<= 5) a prediction <= 5.
    "both_low": an error below 1, or actual and prediction both under 6.
    """
    a, p = F.col(actual), F.col(prediction)
    close = F.abs(a - p) < 1
    if rule == "biased":
        return F.when(a > BIASED_LOW, close).otherwise(p <= BIASED_LOW)
    if rule == "both_low":
        return close | ((a < BOTH_LOW) & (p < BOTH_LOW))
    raise ValueError(f"unknown rule: {rule}")


def rate(flag: Column) -> Column:
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def root_mean_square(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def quality(scored: DataFrame, rule: str = "biased", by: list[str] | None = None) -> DataFrame:
    """Row count, matches, class rate and RMSE in one pass, per group if asked."""
    match = is_match(rule)
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.count_if(match).alias("matches"),
        rate(match).alias("class_rate"),
        root_mean_square(F.col("actual") - F.col("prediction")).alias("rmse"),
    )


def rmse(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(root_mean_square(F.col("actual") - F.col("prediction")).alias("rmse"))


def class_rate(scored: DataFrame, rule: str = "biased", by: list[str] | None = None) -> DataFrame:
    return scored.groupBy(*(by or [])).agg(F.count("*").alias("n"), rate(is_match(rule)).alias("class_rate"))


def error_rows(scored: DataFrame) -> DataFrame:
    """(act, error) rows in order of the actual value; error is prediction minus actual.

    Rows of one actual value are ordered by error, then by a hash of the row: a sort by the few actual values
    alone could not spread over more tasks than there are values.
    """
    errors = scored.withColumn("_mark", F.xxhash64(*scored.columns)).select(
        F.col("actual").alias("act"), (F.col("prediction") - F.col("actual")).alias("error"), "_mark"
    )
    return errors.orderBy("act", "error", "_mark").drop("_mark")


def absolute_errors(scored: DataFrame) -> DataFrame:
    return scored.withColumn("error", F.abs(F.col("prediction") - F.col("actual")))


def error_breakdown(scored: DataFrame) -> DataFrame:
    """Count, mean and standard deviation of the error per actual value."""
    error = F.col("prediction") - F.col("actual")
    return scored.groupBy(F.col("actual").alias("act")).agg(
        F.count("*").alias("n"),
        F.avg(error).alias("mean_error"),
        F.stddev_samp(error).alias("sd_error"),
    )


def best_by_class_rate(results: DataFrame, order: str = "point_no", rate_name: str = "class_rate") -> DataFrame:
    """The sweep point with the highest class rate; the first one wins a tie."""
    return results.orderBy(F.desc(rate_name), order).limit(1)


def score_pairs(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Truth and prediction side by side on (user_id, item_id)."""
    return truth.join(predictions, ["user_id", "item_id"], "inner")
