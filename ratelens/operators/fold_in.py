"""New ratings folded into a fitted ALS model: the touched users are solved anew against the model's item factors.

A user's factors depend on the user's own ratings and the item factors alone, so a few new ratings need no fit of all
users and items. Each user's ridge problem is summed up by aggregates, map-side combined, and solved in batches. The item factors stay
as they are until the next full fit; items that the model does not know add nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.session import materialize

_ROUNDS, _STILL = 2000, 1e-9


@dataclass
class Factors:
    """What predictions and top-k need of a model: `userFactors` and `itemFactors` are (id, features)."""

    rank: int
    userFactors: DataFrame
    itemFactors: DataFrame

    def predict(self, pairs: DataFrame) -> DataFrame:
        """`pairs` (user_id, item_id) with `prediction`; pairs with an unknown id drop out."""
        users = self.userFactors.select(F.col("id").alias("user_id"), F.col("features").alias("_u"))
        items = self.itemFactors.select(F.col("id").alias("item_id"), F.col("features").alias("_v"))
        product = F.aggregate(F.zip_with("_u", "_v", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        return pairs.join(users, "user_id").join(items, "item_id").withColumn("prediction", product).drop("_u", "_v")


def solve_ridge(a: np.ndarray, b: np.ndarray, nonnegative: bool) -> np.ndarray:
    """Solutions of a x = b for each positive definite matrix, or of the least squares behind it with x >= 0.

    The latter by coordinate descent, each problem until no unknown moves by more than 1e-9 of the largest.
    """
    if not nonnegative or not len(b):
        return np.linalg.solve(a, b[:, :, None])[:, :, 0]
    x = np.maximum(np.linalg.solve(a, b[:, :, None])[:, :, 0], 0)
    open_ = np.arange(len(b))
    for _ in range(_ROUNDS):
        before = x[open_].copy()
        for j in range(b.shape[1]):
            now = x[open_]
            slope = b[open_, j] - (a[open_, j] * now).sum(1)
            x[open_, j] = np.maximum(0, now[:, j] + slope / a[open_, j, j])
        moved = np.abs(x[open_] - before).max(1) > _STILL * (1e-12 + np.abs(x[open_]).max(1))
        open_ = open_[moved]
        if not len(open_):
            break
    return x


def fold_in_users(
    model: ALSModel | Factors, ratings: DataFrame, reg: float, touched: DataFrame | None = None, nonnegative: bool = True, rating: str = "taste"
) -> Factors:
    """`model` with the users of `touched` (user_id; all of `ratings` by default) solved against its item factors.

    `ratings` are all ratings of these users, (user_id, item_id, rating), old and new; other users' rows are ignored. The problem is
    that of a fit's last half-step: squared errors plus `reg` times the user's number of ratings times the squared factors. A touched user none of
    whose items is known keeps what the model had. Rows with a missing value are left out.
    """
    rank = model.rank
    given = ratings.select("user_id", "item_id", F.col(rating).cast("double").alias("y")).dropna()
    if touched is not None:
        given = given.join(touched.select("user_id").distinct(), "user_id", "left_semi")
    # A written table: a popular item's ratings can then be split over tasks in the join.
    items = materialize(model.itemFactors)
    vector = F.col("features").cast("array<double>").alias("v")
    met = given.join(items.select(F.col("id").alias("item_id"), vector), "item_id")
    upper = [(i, j) for i in range(rank) for j in range(i, rank)]
    each = ", ".join([f"sum(v[{i}] * v[{j}])" for i, j in upper] + [f"sum(v[{i}] * y)" for i in range(rank)])
    sums = met.groupBy("user_id").agg(F.expr(f"array({each})").alias("sums"), F.count("*").alias("n"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.array(upper).T
        for frame in frames:
            if not len(frame):
                continue
            s = np.stack(frame["sums"].to_list()).astype(float)
            a = np.zeros((len(frame), rank, rank))
            a[:, at[0], at[1]] = a[:, at[1], at[0]] = s[:, : len(upper)]
            a += (reg * frame["n"].to_numpy(float))[:, None, None] * np.eye(rank)
            found = solve_ridge(a, s[:, len(upper) :], nonnegative)
            yield pd.DataFrame({"id": frame["user_id"].to_numpy(), "features": pd.Series(list(found.astype(np.float32)), dtype=object)})

    kind = dict(ratings.dtypes)["user_id"]
    solved = materialize(sums.mapInPandas(solve, f"id {kind}, features array<float>"))
    kept = model.userFactors.join(solved.select("id"), "id", "left_anti")
    return Factors(rank, kept.unionByName(solved), items)
