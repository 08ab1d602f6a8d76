"""Rating tables: ids, support, appended ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions import scalars as S
from ratelens.operators.ordinals import dense_id_tables, dense_ids, new_ids
from ratelens.operators.relational import first_per_key, min_support_filter, only_listed, only_unseen
from ratelens.session import materialize

# The lowest number of ratings of a kept user, and the rating scale.
MIN_USER_RATINGS = 4
RATING_RANGE = (0.0, 10.0)


def user_dimension(reviews: DataFrame) -> DataFrame:
    """(user_name, user_id), ids by name."""
    return dense_ids(reviews, "user_name", "user_id")


def item_dimension(reviews: DataFrame) -> DataFrame:
    """(item, item_id), ids by name."""
    return dense_ids(reviews, "item", "item_id")


def dimensions(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User and item ids from one pass over the reviews."""
    tables = dense_id_tables(reviews, {"user_name": "user_id", "item": "item_id"})
    return tables["user_name"], tables["item"]


def rated_reviews(reviews: DataFrame, region: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rated reviews with the rating on the 0-10 scale, of one region if asked.

    `keep` names further review columns to carry along.
    """
    kept = reviews if region is None else reviews.where(F.col("region") == F.lit(region))
    rating = S.rating_out_of_ten("taste").alias("taste")
    return kept.select("review_id", "item", "user_name", rating, *keep).where(F.col("taste").isNotNull())


def with_ids(rated: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return rated.join(users, "user_name", "left").join(items, "item", "left")


def item_user_pairs(
    reviews: DataFrame,
    region: str | None = None,
    users: DataFrame | None = None,
    items: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rated (user, item) rows with ids and the rating on the 0-10 scale.

    Ids come from all reviews, unrated ones included, also when only one region is kept.
    """
    if users is None and items is None:
        users, items = dimensions(reviews)
    users = user_dimension(reviews) if users is None else users
    items = item_dimension(reviews) if items is None else items
    paired = with_ids(rated_reviews(reviews, region, keep), users, items)
    return paired.select("review_id", "item", "user_name", "user_id", "item_id", "taste", *keep)


def supported_ratings(ratings: DataFrame, min_count: int = MIN_USER_RATINGS) -> DataFrame:
    """Ratings of users that gave at least `min_count`."""
    return min_support_filter(ratings, "user_name", min_count)


def typed_ratings(ratings: DataFrame) -> DataFrame:
    """(user_id, item_id, taste) with the rating cut to its integer part."""
    return ratings.select("user_id", "item_id", S.truncated("taste").alias("taste"))


def user_id_pairs(ratings: DataFrame, app_only: bool = False) -> DataFrame:
    """Distinct (user_name, user_id), of application ratings only if asked."""
    rows = ratings.where(F.col("appdata") == 1) if app_only else ratings
    return rows.select("user_name", "user_id").distinct()


def item_id_pairs(ratings: DataFrame) -> DataFrame:
    return ratings.select("item", "item_id").distinct()


def ratings_of_user(ratings: DataFrame, user_name: str) -> DataFrame:
    return ratings.where(F.col("user_name") == F.lit(user_name)).select("item", "taste")


def append_ratings(
    stored: DataFrame, batch: DataFrame, items: DataFrame, order: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Split a batch of new ratings (user_name, item, taste) into accepted and rejected rows.

    `order` must be total over the batch. Accepted rows carry ids and `appdata` = 1; a known user keeps the id, a new one gets the
    next free one. Rejected rows carry a `reason`: an unknown item, a rating outside the
    scale, or a (user, item) pair that is stored or comes earlier in the batch.
    """
    low, high = RATING_RANGE
    keyed = batch.withColumns(
        {"review_id": S.review_key("item", "user_name"), "_rating": S.number(F.col("taste").cast("string"))}
    ).join(items.select("item", "item_id"), "item", "left")
    problem = (
        F.when(F.col("item_id").isNull(), F.lit("unknown item"))
        .when(F.col("user_name").isNull(), F.lit("no user"))
        .when(~F.coalesce(F.col("_rating").between(low, high), F.lit(False)), F.lit("invalid rating"))
    )
    checked = keyed.withColumn("reason", problem)
    valid = checked.where(F.col("reason").isNull()).drop("reason")
    # Decided once; ids, accepted and rejected rows all follow from the same choice.
    firsts = first_per_key(valid, ["review_id"], order)
    fresh = materialize(only_unseen(firsts, stored, "review_id"))

    known = stored.groupBy("user_name").agg(F.min("user_id").alias("user_id"))
    named_now = only_listed(known, fresh.select("user_name").distinct(), "user_name")
    users = materialize(named_now.unionByName(new_ids(known, fresh, "user_name", "user_id")))
    accepted = fresh.join(users, "user_name").select(
        "review_id",
        "item",
        F.col("_rating").alias("taste"),
        "user_name",
        "user_id",
        "item_id",
        F.lit(1).alias("appdata"),
    )
    columns = batch.columns
    later = valid.exceptAll(fresh.select(*valid.columns)).withColumn("reason", F.lit("duplicate"))
    invalid = checked.where(F.col("reason").isNotNull())
    rejected = invalid.select(*columns, "reason").unionByName(later.select(*columns, "reason"))
    return accepted, rejected
