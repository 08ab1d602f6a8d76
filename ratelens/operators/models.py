"""Collaborative filtering and factorization models."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.session import ensure_checkpoint_dir, materialize

# Parameters of the served model.
FINAL_RANK = 6
FINAL_REG = 0.0875
FINAL_ITERATIONS = 20
#: Blocks of users and of items of a fit at least, and ratings of a block at most.
LEAST_BLOCKS, BLOCK_RATINGS = 6, 40_000_000


def als_blocks(ratings: int) -> int:
    """Blocks for so many ratings.

    Each half-step sends a key's factors to every block that has a rating of it, and runs one task a block that reads from all others. So few
    blocks move little, where as many as a shuffle has partitions would send the factors nearly once a rating; more are taken only as memory asks.
    """
    return max(LEAST_BLOCKS, math.ceil(ratings / BLOCK_RATINGS))


def fit_als(
    ratings: DataFrame,
    rank: int = FINAL_RANK,
    reg: float = FINAL_REG,
    iterations: int = FINAL_ITERATIONS,
    nonnegative: bool = True,
    implicit: bool = False,
    seed: int = 7,
    blocks: int | None = None,
    rating: str = "taste",
) -> ALSModel:
    """Alternating least squares on (user_id, item_id, rating); unknown ids get no prediction.

    Without `blocks` the ratings are counted first: give a written or cached table.
    """
    ensure_checkpoint_dir(ratings.sparkSession)
    als = ALS(
        userCol="user_id",
        itemCol="item_id",
        ratingCol=rating,
        rank=rank,
        regParam=reg,
        maxIter=iterations,
        nonnegative=nonnegative,
        implicitPrefs=implicit,
        coldStartStrategy="drop",
        checkpointInterval=5,
        seed=seed,
    )
    als = als.setNumBlocks(blocks or als_blocks(ratings.count()))
    return als.fit(ratings.select("user_id", "item_id", F.col(rating).cast("float").alias(rating)))


def fit_final_model(ratings: DataFrame, seed: int = 7) -> ALSModel:
    return fit_als(ratings, seed=seed)


def fit_ranking_model(
    ratings: DataFrame, rank: int = 12, reg: float = 1e-4, iterations: int = 15, seed: int = 7
) -> ALSModel:
    """Ranking objective: ratings weigh how sure a preference is instead of being reproduced."""
    return fit_als(ratings, rank, reg, iterations, nonnegative=True, implicit=True, seed=seed)


def predict_pairs(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Add `prediction` to (user_id, item_id) rows; pairs with an unknown id drop out."""
    return model.transform(pairs)


def user_optimality(model: ALSModel, ratings: DataFrame, reg: float, rating: str = "taste", slack: float = 1e-3) -> DataFrame:
    """(user_id, optimal): whether a user's factors solve the non-negative ridge problem against the item factors.

    The gradient must vanish where a factor is positive and must not be negative where it is 0, up to `slack` times
    the size of its parts. Spark's ALS multiplies `reg` by the user's number of ratings.
    """
    users = model.userFactors.select(F.col("id").alias("user_id"), F.col("features").alias("u"))
    items = model.itemFactors.select(F.col("id").alias("item_id"), F.col("features").alias("v"))
    met = ratings.join(users, "user_id").join(items, "item_id")
    product = F.aggregate(F.zip_with("u", "v", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    parts = met.withColumn("e", product - F.col(rating))
    sums = [f(k) for k in range(model.rank) for f in (
        lambda k: F.sum(F.col("v")[k] * F.col("e")).alias(f"g{k}"),
        lambda k: F.sum(F.abs(F.col("v")[k] * F.col(rating))).alias(f"s{k}"),
        lambda k: F.first(F.col("u")[k]).alias(f"u{k}"),
    )]
    found = parts.groupBy("user_id").agg(F.count("*").alias("n"), *sums)
    right = F.lit(True)
    for k in range(model.rank):
        gradient = F.col(f"g{k}") + reg * F.col("n") * F.col(f"u{k}")
        near = slack * (1 + F.col(f"s{k}"))
        right = right & (gradient >= -near) & ((F.col(f"u{k}") <= 1e-6) | (gradient <= near))
    return found.select("user_id", right.alias("optimal"))


@dataclass
class NumberTerm:
    """Slope on a standardised column; a missing value counts as the mean."""

    column: str
    mean: float
    deviation: float
    slope: float

    def value(self) -> Column:
        return F.coalesce((F.col(self.column) - self.mean) / self.deviation, F.lit(0.0))

    def attach(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, self.slope * self.value())


@dataclass
class ValueTerm:
    """One number for each value of a column; a value without one (NULL too) counts as 0."""

    column: str
    table: DataFrame  # (column, term)

    def attach(self, rows: DataFrame, name: str) -> DataFrame:
        named = self.table.withColumnRenamed("term", name)
        return rows.join(named, self.column, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


@dataclass
class BiasedFactorization:
    """Overall mean + side terms + user term + item term + product of factors."""

    mean: float
    side_terms: list[NumberTerm | ValueTerm]
    user_terms: DataFrame
    item_terms: DataFrame
    factors: ALSModel | None

    def linear(self, pairs: DataFrame, name: str = "prediction") -> DataFrame:
        """Rows with the sum of mean and all linear terms; rows of unknown users or items drop out."""
        out = pairs.join(self.user_terms, "user_id").join(self.item_terms, "item_id")
        total = F.lit(self.mean) + F.col("user_term") + F.col("item_term")
        for i, term in enumerate(self.side_terms):
            out = term.attach(out, f"_side{i}")
            total = total + F.col(f"_side{i}")
        return out.withColumn(name, total).drop("user_term", "item_term", *[f"_side{i}" for i in range(len(self.side_terms))])

    def predict(self, pairs: DataFrame) -> DataFrame:
        """`pairs` carry user_id, item_id and the side columns that the model was fitted with."""
        scored = self.factors.transform(self.linear(pairs, "_linear"))
        return scored.withColumn("prediction", F.col("_linear") + F.col("prediction")).drop("_linear")


def _number_term(data: DataFrame, column: str, shrink: float) -> NumberTerm:
    found = data.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation")).first()
    term = NumberTerm(column, float(found["mean"] or 0.0), float(found["deviation"] or 0.0) or 1.0, 0.0)
    sums = data.agg(F.sum(F.col("_r") * term.value()).alias("xy"), F.sum(term.value() * term.value()).alias("xx")).first()
    term.slope = (sums["xy"] or 0.0) / ((sums["xx"] or 0.0) + shrink or 1.0)
    return term


def fit_linear_terms(
    ratings: DataFrame, lin_reg: float = 2e-5, passes: int = 2, rating: str = "taste", side_columns: tuple[str, ...] = ()
) -> BiasedFactorization:
    """The linear part alone, in closed form; see `fit_factorization`."""
    kinds = dict(ratings.dtypes)
    data = ratings.select("user_id", "item_id", F.col(rating).cast("double").alias("_y"), *side_columns)
    overall = data.agg(F.avg("_y").alias("mean"), F.count("_y").alias("n")).first()
    if not overall["n"]:
        raise ValueError("there are no ratings to fit")
    mean, shrink = float(overall["mean"]), lin_reg * overall["n"]

    def ridge_terms(source: DataFrame, key: str, residual: Column, name: str) -> DataFrame:
        # Written, as the next fit joins it to all ratings and every prediction reads it.
        return materialize(source.groupBy(key).agg((F.sum(residual) / (F.count("*") + F.lit(shrink))).alias(name)))

    rest = data.withColumn("_r", F.col("_y") - mean)
    side_terms: list[NumberTerm | ValueTerm] = []
    for column in side_columns:
        if kinds[column] in ("string", "boolean"):
            term = ValueTerm(column, ridge_terms(rest.where(F.col(column).isNotNull()), column, F.col("_r"), "term"))
        else:
            term = _number_term(rest, column, shrink)
        side_terms.append(term)
        rest = term.attach(rest, "_t").withColumn("_r", F.col("_r") - F.col("_t")).drop("_t")
    rest = materialize(rest.select("user_id", "item_id", "_r"))  # each step below reads it
    item_terms = ridge_terms(rest, "item_id", F.col("_r"), "item_term")
    for step in range(passes):
        with_items = rest.join(item_terms, "item_id")
        user_terms = ridge_terms(with_items, "user_id", F.col("_r") - F.col("item_term"), "user_term")
        if step < passes - 1:
            with_users = rest.join(user_terms, "user_id")
            item_terms = ridge_terms(with_users, "item_id", F.col("_r") - F.col("user_term"), "item_term")
    return BiasedFactorization(mean, side_terms, user_terms, item_terms, None)


def fit_factorization(
    ratings: DataFrame,
    num_factors: int = 5,
    reg: float = 4e-4,
    lin_reg: float = 2e-5,
    iterations: int = 50,
    passes: int = 2,
    seed: int = 7,
    rating: str = "taste",
    side_columns: tuple[str, ...] = (),
) -> BiasedFactorization:
    """Factorization with intercept, side data, linear terms and factors.

    The loss is the squared error averaged over N rows plus `lin_reg` times the squared terms and `reg` times the
    squared factors. Side columns come first, in the order given: texts as one ridge mean for each value, numbers as
    one ridge slope on the standardised column. Then the terms of items and users are fitted in turn. A ridge mean of n rows is
    shrunk by n / (n + lin_reg N). The factors are fitted by ALS to what the linear part leaves over. Spark's ALS multiplies its penalty by a
    key's own row count, so `reg` is converted by N over the mean rows of a user or item. Every step is an
    aggregation or ALS: no parameter vector has to fit on the driver and no two values share a weight.
    """
    linear = fit_linear_terms(ratings, lin_reg, passes, rating, tuple(side_columns))
    left_over = linear.linear(ratings.withColumn("_y", F.col(rating).cast("double")), "_linear").select(
        "user_id", "item_id", (F.col("_y") - F.col("_linear")).alias("_residual")
    )
    left_over = materialize(left_over)
    keys = linear.user_terms.count() + linear.item_terms.count()
    penalty = reg * keys / 2  # N / (2 N / keys)
    linear.factors = fit_als(left_over, num_factors, penalty, iterations, nonnegative=False, seed=seed, rating="_residual")
    return linear
