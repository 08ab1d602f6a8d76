"""Links, page fields and review fields from a table of raw pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions import scalars as S
from ratelens.session import materialize

# Markup patterns.
HREF_PATTERN = r'href="([^"]*)"'
ANCHOR_PATTERN = r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
MARKUP_PATTERN = r"<[^>]*>"
LANGUAGE_PATTERN = r'<html[^>]*\slang="([^"]*)"'
TITLE_PATTERN = r"(?s)<title>(.*?)</title>"
HEADING_PATTERN = r"(?s)<h1>(.*?)</h1>"
REVIEW_PARTS = ("aroma", "appearance", "taste", "palate", "overall")


def links(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per link, in page order."""
    found = F.regexp_extract_all(F.col(html), F.lit(HREF_PATTERN), F.lit(1))
    return pages.select(page_id, F.posexplode(found).alias("position", "href"))


def anchors(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per anchor element with an address, in page order: its address and its text without markup."""
    whole = F.regexp_extract_all(F.col(html), F.lit(ANCHOR_PATTERN), F.lit(0))
    found = pages.select(page_id, F.posexplode(whole).alias("position", "_anchor"))
    inner = F.regexp_extract("_anchor", ANCHOR_PATTERN, 2)
    return found.select(
        page_id,
        "position",
        F.regexp_extract("_anchor", ANCHOR_PATTERN, 1).alias("href"),
        F.trim(F.regexp_replace(inner, MARKUP_PATTERN, "")).alias("name"),
    )


def keep_links(
    found: DataFrame,
    prefix: str | None = None,
    containing: str | None = None,
    excluding: tuple[str, ...] = (),
    href: str = "href",
) -> DataFrame:
    """Keep links by path rules."""
    path: Column = F.col(href)
    if prefix is not None:
        found = found.where(F.startswith(path, F.lit(prefix)))
    if containing is not None:
        found = found.where(F.contains(path, F.lit(containing)))
    for part in excluding:
        found = found.where(~F.contains(path, F.lit(part)))
    return found


def absolute(found: DataFrame, base: Column | str, href: str = "href") -> DataFrame:
    """Add `url`: the site's base address followed by the path."""
    start = F.lit(base) if isinstance(base, str) else base
    return found.withColumn("url", F.concat(start, F.col(href)))


def captured(c: Column | str, pattern: str, default: str | None = None, place: int = 1) -> Column:
    """Capture of the `place`-th match of a pattern (-1: of the last), or the default when it is absent."""
    if place == 1:
        found = F.regexp_extract(c, pattern, 1)
    else:
        found = F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(place))
    value = F.nullif(found, F.lit(""))
    return value if default is None else F.coalesce(value, F.lit(default))


def page_fields(
    pages: DataFrame,
    patterns: dict[str, str],
    required: tuple[str, ...] = (),
    defaults: dict[str, str] | None = None,
    page_id: str = "page_id",
    html: str = "html",
    places: dict[str, int] | None = None,
) -> DataFrame:
    """One column per named pattern; a page without a required field gives no row.

    `places` names fields that are not the first match: 2 for the second, -1 for the last.
    """
    defaults, places = defaults or {}, places or {}
    fields = pages.select(
        page_id, *[captured(html, p, defaults.get(name), places.get(name, 1)).alias(name) for name, p in patterns.items()]
    )
    for name in required:
        fields = fields.where(F.col(name).isNotNull())
    return fields


def review_fields(
    reviews: DataFrame, scores: str, author: str, combined: str | None = None, body: str | None = None
) -> DataFrame:
    """Add the five part scores as fractions and user, location and date of a review block.

    With `combined`, the column of the overall score's text, also `combined` as a number; with `body`, the column
    of the review's markup, also `review`, its text without markup.
    """
    if combined is not None:
        reviews = reviews.withColumn("combined", S.leading_number(combined))
    if body is not None:
        reviews = reviews.withColumn("review", F.trim(F.regexp_replace(body, MARKUP_PATTERN, "")))
    parts = {name: S.nth_fraction(scores, i) for i, name in enumerate(REVIEW_PARTS, start=1)}
    people = {name: S.user_info(author, i) for i, name in enumerate(("user_name", "location", "date"), start=1)}
    return reviews.withColumns({**parts, **people})


def with_placeholders(items: DataFrame, reviews: DataFrame, key: str = "item") -> DataFrame:
    """Every item at least once; one without reviews gets a row with NULL review columns.

    A left join could not split an item with very many reviews, an inner join can; the items
    without reviews are added apart.
    """
    reviewed = materialize(reviews.select(key).distinct())
    without = items.join(reviewed, key, "left_anti")
    return items.join(reviews, key).unionByName(without, allowMissingColumns=True)
