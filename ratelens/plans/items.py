"""Item tables: side data, features, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions import scalars as S
from ratelens.operators.features import clean_ascii, with_text_features
from ratelens.operators.ordinals import dense_ids
from ratelens.operators.relational import frequent_keys, most_common, only_listed
from ratelens.plans.ratings import supported_ratings
from ratelens.session import materialize
from ratelens.sources.writers import write_csv

SIDE_COLUMNS = ("item", "abv", "calories", "maker", "site_rating", "style", "region")
FREQUENT_ITEM = 50


def raw_side_data(reviews: DataFrame) -> DataFrame:
    return reviews.select(*SIDE_COLUMNS).dropDuplicates()


def impute_mode(side: DataFrame, *columns: str) -> DataFrame:
    """Replace the missing marker by the most frequent text of the column."""
    modes = {c: most_common(side, c).scalar() for c in columns}
    return side.withColumns({c: S.missing_as(c, mode) for c, mode in modes.items()})


def item_side_data(reviews: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row per distinct item description, imputed, numeric and with the item's id."""
    side = materialize(raw_side_data(reviews))  # one row per item, read for both modes, the ids and the result
    items = dense_ids(side, "item", "item_id") if items is None else items
    filled = impute_mode(side, "abv", "calories")
    return filled.join(items, "item", "left").select(
        "item",
        "item_id",
        S.number(S.without_percent("abv")).alias("abv"),
        S.number("calories").alias("calories"),
        "maker",
        S.number("site_rating").alias("site_rating"),
        "style",
        "region",
    )


def modeling_inputs(
    ratings: DataFrame, items: DataFrame, item_terms: DataFrame, min_count: int = 4
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Supported ratings, item side data and item terms, as the models take them."""
    return supported_ratings(ratings, min_count), items, item_terms


def feature_table(items: DataFrame, item_terms: DataFrame) -> DataFrame:
    """Side data and term columns per item, names cut to ASCII."""
    return clean_ascii(with_text_features(items, item_terms), "maker", "style")


def write_feature_table(items: DataFrame, item_terms: DataFrame, path: str) -> None:
    write_csv(feature_table(items, item_terms), path)


def frequent_item_features(
    ratings: DataFrame, items: DataFrame, item_terms: DataFrame, more_than: int = FREQUENT_ITEM
) -> DataFrame:
    """(item_id, abv, calories, term columns) of items with more than `more_than` ratings."""
    frequent = materialize(frequent_keys(ratings, "item_id", more_than))
    wanted = only_listed(items.select("item", "item_id", "abv", "calories"), frequent, "item_id")
    return wanted.join(item_terms, "item").drop("item").distinct()


def wide_catalogue(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct rated items with side data and their number of ratings.

    Ratings are counted by item before the joins, so one row per item is left to move.
    """
    counted = ratings.groupBy("item", "item_id").agg(F.count("*").alias("n"))
    totals = counted.groupBy("item_id").agg(F.sum("n").alias("count"))
    side = items.select("item_id", "abv", "calories", "style", "maker").distinct()
    return counted.drop("n").join(side, "item_id").join(totals, "item_id")


def vector_of(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Numeric feature columns as one array, for the similarity join."""
    return df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("vector"))
