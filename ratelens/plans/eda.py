"""Exploratory summary of reviews and items."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ratelens.operators.explore import distinct_count, histogram
from ratelens.operators.relational import counts_by, top_values


def summary(reviews: DataFrame, items: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """Style counts and the spread of reviews per item and per user, each as a table."""
    per_item = counts_by(reviews, "item")
    per_user = counts_by(reviews, "user_name")
    return {
        "style_count": distinct_count(items, "style"),
        "styles": counts_by(items, "style"),
        "top_styles": top_values(items, "style", top),
        "reviews_per_item": per_item,
        "reviews_per_user": per_user,
        "histogram_item": histogram(per_item, "n"),
        "histogram_user": histogram(per_user, "n"),
    }
