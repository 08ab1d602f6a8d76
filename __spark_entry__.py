
from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import scalars as S
from ratelens.functions import text as T
from ratelens.operators import evaluate as EV
from ratelens.operators import explore, factorization, features, fold_in, models, pages, recommend, relational, search, similarity, sketches, sparse_similarity, split
from ratelens.operators import text as TX
from ratelens.plans import eda
from ratelens.plans import items as I
from ratelens.plans import ratings as R
from ratelens.plans import recommendations as RC
from ratelens.plans import review_tables as RT
from ratelens.session import materialize, shared_folder
from ratelens.sources import keyed_store, readers, writers

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

# --------------------------------------------------------------------------- shared SQL

_CATALOGUE = """
catalogue AS (
  SELECT p_partkey, concat(p_name, ' #', CAST(p_partkey AS VARCHAR)) AS item, p_type AS style, p_brand AS maker,
         n_name AS region,
         CASE WHEN p_partkey % 11 = 0 THEN 'NA' ELSE concat(CAST(p_size AS VARCHAR), '%') END AS abv,
         CASE WHEN p_partkey % 13 = 0 THEN 'NA'
              ELSE CAST(CAST(floor(p_retailprice) AS INTEGER) AS VARCHAR) END AS calories,
         CASE WHEN p_partkey % 17 = 0 THEN 'NA' ELSE CAST(CAST(p_size AS DOUBLE) / 10 AS VARCHAR) END AS site_rating
  FROM part JOIN nation ON n_nationkey = p_partkey % 25)"""

_REVIEWS = (
    _CATALOGUE
    + """,
reviews AS (
  SELECT concat(item, '_', c_name) AS review_id, item, c_name AS user_name, style, maker, region, abv, calories,
         site_rating,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 37 = 0 THEN 'NA'
              ELSE CAST(ceil(l_quantity / 5) / 10 AS VARCHAR) END AS taste,
         CAST(l_linenumber = 1 AS INTEGER) AS appdata, l_quantity, l_shipdate AS review_ts, l_orderkey, l_linenumber
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN catalogue ON p_partkey = l_partkey)"""
)

_DOCS = (
    _REVIEWS
    + """,
docs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY review_ts, l_orderkey, l_linenumber, taste) AS rn
    FROM reviews) WHERE rn = 1)"""
)

_RATINGS = (
    _DOCS
    + """,
users AS (SELECT user_name, CAST(row_number() OVER (ORDER BY user_name) - 1 AS INTEGER) AS user_id
          FROM (SELECT DISTINCT user_name FROM reviews)),
items AS (SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS item_id
          FROM (SELECT DISTINCT item FROM reviews)),
ratings AS (
  SELECT review_id, item, user_name, user_id, item_id, TRY_CAST(taste AS DOUBLE) * 10 AS taste, appdata, region
  FROM docs JOIN users USING (user_name) JOIN items USING (item) WHERE taste <> 'NA')"""
)

_SIDE = (
    _RATINGS
    + """,
raw_side AS (SELECT DISTINCT item, abv, calories, maker, site_rating, style, region FROM reviews),
abv_mode AS (SELECT abv AS m FROM raw_side WHERE abv <> 'NA' GROUP BY abv ORDER BY count(*) DESC, abv LIMIT 1),
calories_mode AS (SELECT calories AS m FROM raw_side WHERE calories <> 'NA' GROUP BY calories
                  ORDER BY count(*) DESC, calories LIMIT 1),
filled AS (
  SELECT item, CASE WHEN abv = 'NA' THEN (SELECT m FROM abv_mode) ELSE abv END AS abv,
         CASE WHEN calories = 'NA' THEN (SELECT m FROM calories_mode) ELSE calories END AS calories,
         maker, site_rating, style, region FROM raw_side),
side AS (
  SELECT item, item_id, TRY_CAST(replace(abv, '%', '') AS DOUBLE) AS abv, TRY_CAST(calories AS DOUBLE) AS calories,
         maker, TRY_CAST(site_rating AS DOUBLE) AS site_rating, style, region
  FROM filled JOIN items USING (item))"""
)

_SCORED = (
    _RATINGS
    + """,
labelled AS (
  SELECT *, CASE WHEN CAST('0x' || substr(md5(review_id), 1, 8) AS BIGINT) % 10000 < 2000
                 THEN 'test' ELSE 'train' END AS split FROM ratings),
item_means AS (SELECT item_id, sum(taste) / count(taste) AS prediction FROM labelled WHERE split = 'train'
               GROUP BY item_id),
scored AS (SELECT user_id, item_id, taste AS actual, split, prediction FROM labelled JOIN item_means USING (item_id))"""
)

_TERMS = """
words AS (
  SELECT {key} AS key, list_filter(regexp_extract_all(lower({text}), '[a-z0-9]{{2,}}'),
                                   lambda t: t NOT IN ('10', '12')) AS w FROM {source}),
occurrences AS (
  SELECT key, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM words),
counts AS (SELECT key, term, count(*) AS n FROM occurrences GROUP BY key, term),
vocabulary AS (SELECT term, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY term ORDER BY 2 DESC, 1 LIMIT 100),
listed AS (SELECT key, term, n FROM counts JOIN vocabulary USING (term)),
tf AS (SELECT key, term, n / sqrt(sum(n * n) OVER (PARTITION BY key)) AS tf FROM listed)"""

# An ASCII token, the words left out and the lemmas of the text queries.
ASCII_TOKEN = "[a-z0-9]{2,}"
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "that", "le", "la", "les", "et", "der", "die", "und", "el")
LEMMAS = {"ears": "ear", "ones": "one", "res": "re", "tions": "tion"}
# The weights of the damping sweep.
DAMPING = (0.0, 1.0, 2.0, 5.0, 10.0, 20.0)
NEW_RATINGS_FROM = "1995-03-01"


_SIDE_COLUMNS = ("abv", "calories", "maker", "site_rating", "style", "region")


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return register


# --------------------------------------------------------------------------- counts and histograms


@query("ratings_by_user", _with(_DOCS) + "SELECT user_name, count(*) AS n FROM docs GROUP BY user_name")
def ratings_by_user(spark, d):
    return relational.counts_by(RT.stored_reviews(spark, d), "user_name")


@query("ratings_by_item", _with(_DOCS) + "SELECT item, count(*) AS n FROM docs GROUP BY item")
def ratings_by_item(spark, d):
    return relational.counts_by(RT.stored_reviews(spark, d), "item")


@query("styles", _with(_SIDE) + "SELECT style, count(*) AS n FROM raw_side GROUP BY style")
def styles(spark, d):
    return relational.counts_by(I.raw_side_data(RT.reviews(spark, d)), "style")


@query(
    "top_styles",
    _with(_SIDE) + "SELECT style, count(*) AS n FROM raw_side GROUP BY style ORDER BY n DESC, style LIMIT 20",
)
def top_styles(spark, d):
    return relational.top_values(I.raw_side_data(RT.reviews(spark, d)), "style", 20)


@query("style_count", _with(_REVIEWS) + "SELECT count(DISTINCT style) AS n FROM reviews")
def style_count(spark, d):
    return explore.distinct_count(RT.reviews(spark, d), "style")


def _histogram_sql(key: str) -> str:
    return (
        _with(_DOCS)
        + f"""SELECT CAST(b AS INTEGER) AS bin, CAST(b - 1 AS DOUBLE) AS bin_start, coalesce(n, 0) AS n
        FROM range(1, 201) AS bins(b) LEFT JOIN (
          SELECT least(c + 1, 200) AS bin, count(*) AS n
          FROM (SELECT count(*) AS c FROM docs GROUP BY {key}) WHERE c BETWEEN 0 AND 200 GROUP BY 1) ON bin = b"""
    )


@query("histogram_item", _histogram_sql("item"))
def histogram_item(spark, d):
    return explore.histogram(ratings_by_item(spark, d), "n")


@query("histogram_user", _histogram_sql("user_name"))
def histogram_user(spark, d):
    return explore.histogram(ratings_by_user(spark, d), "n")


def _summary_sql() -> str:
    parts = {"style_count": "''", "styles": "style", "ratings_by_item": "item", "ratings_by_user": "user_name", "histogram_item": "bin", "histogram_user": "bin"}
    named = {"ratings_by_item": "reviews_per_item", "ratings_by_user": "reviews_per_user"}
    return " UNION ALL ".join(f"SELECT '{named.get(q, q)}' AS part, CAST({key} AS VARCHAR) AS key, n FROM ({_ORACLES[q]})" for q, key in parts.items())


@query("summary", _summary_sql())
def summary(spark, d):
    """All tables of the exploratory summary, one below the other."""
    docs = RT.store(spark, d)
    tables = eda.summary(docs, materialize(I.raw_side_data(RT.reviews(spark, d))))
    out = None
    for part, found in tables.items():
        if part != "top_styles":  # a query of its own
            key = F.lit("") if part == "style_count" else F.col(found.columns[0]).cast("string")
            rows = found.select(F.lit(part).alias("part"), key.alias("key"), "n")
            out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "merged_style_counts",
    _with(_REVIEWS) + "SELECT style, count(*) AS n, count(DISTINCT user_name) AS users, true AS near FROM reviews GROUP BY style",
)
def merged_style_counts(spark, d):
    """Reviews and users of each style from the kept counts of seven yearly batches, beside the exact number of users.

    `near`: the estimate is within 6 % of it, over three standard errors.
    """
    rows = materialize(RT.reviews(spark, d).select("style", "user_name", F.year("review_ts").alias("year")))
    path = shared_folder(spark, "style-counts")
    for year in sorted(r["year"] for r in rows.select("year").distinct().collect()):  # a handful of years
        sketches.write_batch(sketches.batch_counts(rows.where(F.col("year") == year), "style", "user_name"), path, year)
    exact = rows.groupBy("style").agg(F.count_distinct("user_name").alias("users"))
    both = sketches.merged_counts(spark, path, "style").join(exact, "style")
    return both.select("style", "n", "users", (F.abs(F.col("about") - F.col("users")) <= 1 + 0.06 * F.col("users")).alias("near"))


# --------------------------------------------------------------------------- rating tables


@query(
    "item_user_pairs",
    _with(_RATINGS) + "SELECT review_id, item, user_name, user_id, item_id, taste FROM ratings",
)
def item_user_pairs(spark, d):
    return RT.ratings(spark, d).drop("appdata")


@query(
    "region_item_user_pairs",
    _with(_RATINGS)
    + "SELECT review_id, item, user_name, user_id, item_id, taste FROM ratings WHERE region = 'NATION_7'",
)
def region_item_user_pairs(spark, d):
    # An item has one region, so the filter may go before the de-duplication; ids come from all reviews' names.
    raw = RT.reviews(spark, d)
    users, items = R.dimensions(raw)
    regional = RT.first_reviews(raw.where("region = 'NATION_7'"))
    return R.item_user_pairs(regional, users=users, items=items)


@query(
    "min_support_users",
    _with(_RATINGS)
    + """, regional AS (SELECT * FROM ratings WHERE region = 'NATION_7')
    SELECT review_id, item, user_name, user_id, item_id, taste FROM regional
    WHERE user_name NOT IN (SELECT user_name FROM regional GROUP BY user_name HAVING count(*) < 4)""",
)
def min_support_users(spark, d):
    # The table is counted and filtered: written once, read twice.
    return R.supported_ratings(materialize(region_item_user_pairs(spark, d)))


@query("ratings_typed", _with(_RATINGS) + "SELECT user_id, item_id, CAST(trunc(taste) AS INTEGER) AS taste FROM ratings")
def ratings_typed(spark, d):
    return R.typed_ratings(RT.ratings(spark, d))


@query("user_id_pairs", _with(_RATINGS) + "SELECT DISTINCT user_name, user_id FROM ratings")
def user_id_pairs(spark, d):
    return R.user_id_pairs(RT.ratings(spark, d))


@query("app_user_id_pairs", _with(_RATINGS) + "SELECT DISTINCT user_name, user_id FROM ratings WHERE appdata = 1")
def app_user_id_pairs(spark, d):
    return R.user_id_pairs(RT.ratings(spark, d), app_only=True)


@query("item_id_pairs", _with(_RATINGS) + "SELECT DISTINCT item, item_id FROM ratings")
def item_id_pairs(spark, d):
    return R.item_id_pairs(RT.ratings(spark, d))


@query(
    "user_ratings", _with(_RATINGS) + "SELECT item, taste FROM ratings WHERE user_name = 'Customer#000000007'"
)
def user_ratings(spark, d):
    # The key of a review contains its user, so the filter may go before the de-duplication.
    name = "Customer#000000007"
    own = RT.first_reviews(RT.reviews(spark, d).where(F.col("user_name") == name))
    return R.ratings_of_user(R.rated_reviews(own), name)


@query(
    "id_lookup",
    _with(_RATINGS)
    + "SELECT user_id, item_id, CAST(trunc(taste) AS INTEGER) AS taste, user_name, item FROM ratings",
)
def id_lookup(spark, d):
    docs = RT.store(spark, d)
    users, items = R.dimensions(docs)
    typed = R.typed_ratings(R.with_ids(R.rated_reviews(docs), users, items))
    return relational.attach_names(relational.attach_names(typed, users, "user_id"), items, "item_id")


@query(
    "dedupe_reviews",
    _with(_DOCS) + "SELECT review_id, item, user_name, taste, l_orderkey, l_linenumber FROM docs",
)
def dedupe_reviews(spark, d):
    return RT.stored_reviews(spark, d).select(
        "review_id", "item", "user_name", "taste", "l_orderkey", "l_linenumber"
    )


_APPEND = (
    _REVIEWS
    + f""",
all_items AS (SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS item_id FROM catalogue),
old_docs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY review_ts, l_orderkey, l_linenumber, taste) AS rn
    FROM reviews WHERE review_ts < TIMESTAMP '{NEW_RATINGS_FROM}') WHERE rn = 1),
old_users AS (SELECT user_name, row_number() OVER (ORDER BY user_name) - 1 AS user_id
              FROM (SELECT DISTINCT user_name FROM old_docs)),
stored AS (SELECT review_id, user_name, user_id FROM old_docs JOIN old_users USING (user_name) WHERE taste <> 'NA'),
known AS (SELECT DISTINCT user_name, user_id FROM stored),
batch AS (
  SELECT review_id, item, user_name, TRY_CAST(taste AS DOUBLE) * 10 AS taste, review_ts, l_orderkey, l_linenumber
  FROM reviews WHERE review_ts >= TIMESTAMP '{NEW_RATINGS_FROM}'),
firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY review_ts, l_orderkey, l_linenumber, taste) AS rn
    FROM batch WHERE taste IS NOT NULL) WHERE rn = 1),
fresh AS (SELECT * FROM firsts WHERE review_id NOT IN (SELECT review_id FROM stored)),
new_users AS (
  SELECT user_name, row_number() OVER (ORDER BY user_name) + (SELECT max(user_id) FROM known) AS user_id
  FROM (SELECT DISTINCT user_name FROM fresh) WHERE user_name NOT IN (SELECT user_name FROM known)),
everyone AS (SELECT * FROM known UNION ALL SELECT * FROM new_users)"""
)


def _append(spark, d):
    columns = ("review_id", "user_name", "item", "taste", "review_ts", "l_orderkey", "l_linenumber")
    raw = materialize(RT.reviews(spark, d).select(*columns))  # split into the stored and the new ratings
    items = R.item_dimension(RT.part_items(spark, d))
    cutoff = F.lit(NEW_RATINGS_FROM).cast("timestamp_ntz")
    order = [F.col(c) for c in RT.REVIEW_ORDER]
    old = relational.first_per_key(raw.where(F.col("review_ts") < cutoff), ["review_id"], order)
    stored = materialize(R.item_user_pairs(old, items=items))
    batch = raw.where(F.col("review_ts") >= cutoff).select(
        "user_name", "item", S.rating_out_of_ten("taste").alias("taste"), "review_ts", "l_orderkey", "l_linenumber"
    )
    return R.append_ratings(stored, batch, items, order)


@query(
    "append_ratings",
    _with(_APPEND)
    + """SELECT review_id, item, taste, user_name, CAST(user_id AS INTEGER) AS user_id, item_id,
    CAST(1 AS INTEGER) AS appdata FROM fresh JOIN everyone USING (user_name) JOIN all_items USING (item)""",
)
def append_ratings(spark, d):
    return _append(spark, d)[0]


@query(
    "append_rejected",
    _with(_APPEND)
    + """SELECT user_name, item, taste, l_orderkey, l_linenumber, 'invalid rating' AS reason
    FROM batch WHERE taste IS NULL
    UNION ALL
    SELECT user_name, item, taste, l_orderkey, l_linenumber, 'duplicate' FROM (
      SELECT * FROM batch WHERE taste IS NOT NULL EXCEPT ALL SELECT * FROM fresh)""",
)
def append_rejected(spark, d):
    return _append(spark, d)[1].drop("review_ts")


# --------------------------------------------------------------------------- item tables


@query(
    "item_side_data",
    _with(_SIDE) + "SELECT item, item_id, abv, calories, maker, site_rating, style, region FROM side",
)
def item_side_data(spark, d):
    return I.item_side_data(RT.reviews(spark, d))


@query("mode_impute", _with(_SIDE) + "SELECT item, abv, calories FROM filled")
def mode_impute(spark, d):
    side = materialize(I.raw_side_data(RT.reviews(spark, d)))
    return I.impute_mode(side, "abv", "calories").select("item", "abv", "calories")


@query(
    "complete_cases",
    _with(_SIDE) + "SELECT item, item_id, abv, calories, site_rating FROM side WHERE site_rating IS NOT NULL",
)
def complete_cases(spark, d):
    side = item_side_data(spark, d).select("item", "item_id", "abv", "calories", "site_rating")
    return relational.complete_cases(side)


@query("regions", _with(_REVIEWS) + "SELECT DISTINCT region FROM reviews")
def regions(spark, d):
    return readers.distinct_values(RT.reviews(spark, d), "region")


@query(
    "catalog_search",
    _with(_CATALOGUE) + "SELECT item FROM catalogue WHERE contains(lower(item), 'widget') ORDER BY item LIMIT 15",
)
def catalog_search(spark, d):
    return relational.search_names(RT.part_items(spark, d).select("item"), "item", "Widget")


@query(
    "wide_catalogue",
    _with(_SIDE)
    + """, item_counts AS (SELECT item_id, count(*) AS count FROM ratings GROUP BY item_id)
    SELECT DISTINCT ratings.item, item_id, abv, calories, count, side.style, maker
    FROM ratings JOIN side USING (item_id) JOIN item_counts USING (item_id)""",
)
def wide_catalogue(spark, d):
    docs = RT.store(spark, d, *_SIDE_COLUMNS)
    items = R.item_dimension(docs)
    pairs = R.rated_reviews(docs).join(items, "item")
    return I.wide_catalogue(pairs, I.item_side_data(docs, items))


def _item_texts(spark, d) -> DataFrame:
    """A short text per item: its name, style and maker."""
    return RT.part_items(spark, d).select("item", F.concat_ws(" ", "item", "style", "maker").alias("text"))


_ITEM_TERMS = _TERMS.format(key="item", text="concat(item, ' ', style, ' ', maker)", source="catalogue")


@query(
    "frequent_item_features",
    _with(_SIDE, _ITEM_TERMS)
    + """SELECT DISTINCT item_id, abv, calories, term, round(tf, 6) AS tf
    FROM side JOIN tf ON key = item
    WHERE item_id IN (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) > 30)""",
)
def frequent_item_features(spark, d):
    docs = RT.store(spark, d, *_SIDE_COLUMNS)
    items = R.item_dimension(docs)
    pairs = R.rated_reviews(docs).join(items, "item")
    terms = TX.term_frequency(_item_texts(spark, d), "item", "text", pattern=ASCII_TOKEN)
    rounded = terms.withColumn("tf", F.round("tf", 6))
    return I.frequent_item_features(pairs, I.item_side_data(docs, items), rounded, more_than=30)


@query(
    "feature_table",
    _with(_SIDE, _ITEM_TERMS)
    + """SELECT item, item_id, abv, calories, regexp_replace(maker, '[^\\x00-\\x7F]', '', 'g') AS maker, site_rating,
    regexp_replace(style, '[^\\x00-\\x7F]', '', 'g') AS style, region, term, round(tf, 6) AS tf
    FROM side JOIN tf ON key = item""",
)
def feature_table(spark, d):
    terms = TX.term_frequency(_item_texts(spark, d), "item", "text", pattern=ASCII_TOKEN)
    return I.feature_table(item_side_data(spark, d), terms).withColumn("tf", F.round("tf", 6))


_MAKERS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "one_hot_maker",
    _with(_SIDE)
    + "SELECT item, "
    + ", ".join(f"CAST(maker = '{m}' AS INTEGER) AS \"maker_{m}\"" for m in _MAKERS)
    + " FROM raw_side",
)
def one_hot_maker(spark, d):
    return features.one_hot_columns(I.raw_side_data(RT.reviews(spark, d)).select("item", "maker"), "maker", _MAKERS, "maker")


@query(
    "style_flags",
    _with(_SIDE)
    + """, top AS (SELECT style, row_number() OVER (ORDER BY count(*) DESC, style) AS place FROM raw_side GROUP BY style)
    SELECT item, top.style, CAST(raw_side.style = top.style AS INTEGER) AS flag
    FROM raw_side, top WHERE place <= 30""",
)
def style_flags(spark, d):
    side = I.raw_side_data(RT.reviews(spark, d)).select("item", "style")
    top = [r["style"] for r in relational.top_values(side, "style", 30).collect()]
    wide = features.one_hot_columns(side, "style", top)
    return wide.unpivot("item", top, "style", "flag")


@query(
    "items_without_app_reviews",
    _with(_DOCS)
    + """SELECT catalogue.item, user_name, taste FROM catalogue
    LEFT JOIN (SELECT item, user_name, taste FROM docs WHERE appdata = 1) r ON catalogue.item = r.item""",
)
def items_without_app_reviews(spark, d):
    app = RT.stored_reviews(spark, d).where("appdata = 1").select("item", "user_name", "taste")
    return pages.with_placeholders(RT.part_items(spark, d).select("item"), app)


# --------------------------------------------------------------------------- splits


@query("hash_split", _with(_SCORED) + "SELECT review_id, split FROM labelled")
def hash_split(spark, d):
    return split.hash_split(RT.rated(spark, d), ["review_id"]).select("review_id", "split")


@query(
    "per_user_split",
    _with(_RATINGS)
    + """, chosen AS (
      SELECT user_name FROM (SELECT DISTINCT user_name FROM ratings)
      ORDER BY CAST('0x' || substr(md5(user_name), 1, 8) AS BIGINT), user_name LIMIT 4000)
    SELECT review_id, CASE WHEN user_name IN (SELECT user_name FROM chosen)
      AND CAST('0x' || substr(md5(user_name || '|' || item), 1, 8) AS BIGINT) % 10000 < 2000
      THEN 'test' ELSE 'train' END AS split FROM ratings""",
)
def per_user_split(spark, d):
    return split.split_by_user(R.rated_reviews(RT.store(spark, d)), max_users=4000).select("review_id", "split")


# --------------------------------------------------------------------------- evaluation


def _scored(spark, d) -> DataFrame:
    return RT.scored(RT.labelled(RT.store(spark, d)))


@query(
    "rmse",
    _with(_SCORED)
    + "SELECT split, round(sqrt(avg((actual - prediction) ** 2)), 6) AS rmse FROM scored GROUP BY split",
)
def rmse(spark, d):
    return EV.rmse(_scored(spark, d), ["split"]).withColumn("rmse", F.round("rmse", 6))


_BIASED = """((actual > 5 AND abs(actual - prediction) < 1) OR (actual <= 5 AND prediction <= 5))"""
_BOTH_LOW = """(abs(actual - prediction) < 1 OR (actual < 6 AND prediction < 6))"""


def _rate_sql(rule: str) -> str:
    return (
        _with(_SCORED)
        + f"""SELECT split, count(*) AS n, round(avg(CASE WHEN {rule} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS class_rate
        FROM scored GROUP BY split"""
    )


@query("class_rate_biased", _rate_sql(_BIASED))
def class_rate_biased(spark, d):
    return EV.class_rate(_scored(spark, d), "biased", ["split"]).withColumn("class_rate", F.round("class_rate", 6))


@query("class_rate_both_low", _rate_sql(_BOTH_LOW))
def class_rate_both_low(spark, d):
    return EV.class_rate(_scored(spark, d), "both_low", ["split"]).withColumn("class_rate", F.round("class_rate", 6))


@query(
    "quality",
    _with(_SCORED)
    + f"""SELECT split, count(*) AS n, count(*) FILTER (WHERE {_BOTH_LOW}) AS matches,
    round(avg(CASE WHEN {_BOTH_LOW} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS class_rate,
    round(sqrt(avg((actual - prediction) ** 2)), 6) AS rmse FROM scored GROUP BY split""",
)
def quality(spark, d):
    found = EV.quality(_scored(spark, d), "both_low", ["split"])
    return found.withColumns({c: F.round(c, 6) for c in ("class_rate", "rmse")})


@query(
    "error_rows",
    _with(_SCORED) + "SELECT actual AS act, round(prediction - actual, 6) AS error FROM scored ORDER BY act",
)
def error_rows(spark, d):
    return EV.error_rows(_scored(spark, d)).withColumn("error", F.round("error", 6))


@query(
    "error_breakdown",
    _with(_SCORED)
    + """SELECT actual AS act, count(*) AS n, round(avg(prediction - actual), 6) AS mean_error,
    round(stddev_samp(prediction - actual), 6) AS sd_error FROM scored GROUP BY actual""",
)
def error_breakdown(spark, d):
    found = EV.error_breakdown(_scored(spark, d))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_error", "sd_error")})


_DAMPING_SQL = (
    _SCORED
    + """,
sums AS (SELECT item_id, sum(taste) AS s, count(taste) AS c FROM labelled WHERE split = 'train' GROUP BY item_id),
overall AS (SELECT avg(taste) AS m FROM labelled WHERE split = 'train'),
weights AS (SELECT w.point_no, w.damping FROM (VALUES """
    + ", ".join(f"({i}, {w}::DOUBLE)" for i, w in enumerate(DAMPING))
    + """) AS w(point_no, damping)),
points AS (
  SELECT point_no, damping, taste AS actual, (s + damping * (SELECT m FROM overall)) / (c + damping) AS prediction
  FROM labelled JOIN sums USING (item_id), weights WHERE split = 'test'),
damped AS (
  SELECT CAST(point_no AS INTEGER) AS point_no, damping,
         round(avg(CASE WHEN """
    + _BOTH_LOW
    + """ THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS class_rate,
         round(sqrt(avg((actual - prediction) ** 2)), 6) AS rmse
  FROM points GROUP BY point_no, damping)"""
)


@query("damping_sweep", _with(_DAMPING_SQL) + "SELECT * FROM damped")
def damping_sweep(spark, d):
    """Quality of item means pulled to the overall mean by each weight, all in one pass."""
    train, test = split.train_and_test(RT.labelled(RT.store(spark, d)))
    sums = materialize(train.groupBy("item").agg(F.sum("taste").alias("s"), F.count("taste").alias("c")))
    overall = train.agg(F.avg("taste").alias("m")).scalar()
    names = [f"p{i}" for i in range(len(DAMPING))]
    predicted = test.join(sums, "item").select(
        F.col("taste").alias("actual"),
        *[((F.col("s") + F.lit(w) * overall) / (F.col("c") + F.lit(w))).alias(p) for p, w in zip(names, DAMPING)],
    )
    measures = [
        F.struct(
            F.lit(i).alias("point_no"),
            F.lit(w).alias("damping"),
            F.round(EV.rate(EV.is_match("both_low", "actual", p)), 6).alias("class_rate"),
            F.round(EV.root_mean_square(F.col("actual") - F.col(p)), 6).alias("rmse"),
        )
        for i, (p, w) in enumerate(zip(names, DAMPING))
    ]
    return predicted.agg(F.array(*measures).alias("points")).select(F.inline("points"))


@query(
    "sweep_best",
    _with(_DAMPING_SQL) + "SELECT * FROM damped ORDER BY class_rate DESC, point_no LIMIT 1",
)
def sweep_best(spark, d):
    return EV.best_by_class_rate(damping_sweep(spark, d))


# --------------------------------------------------------------------------- ranking and similarity


@query(
    "top_k_item_mean",
    _with(_SCORED)
    + """, allowed AS (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= 10),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS INTEGER) AS rank
               FROM scored WHERE item_id IN (SELECT item_id FROM allowed))
    SELECT user_name, rank, item, round(prediction, 6) AS prediction
    FROM ranked JOIN users USING (user_id) JOIN items USING (item_id) WHERE rank <= 20""",
)
def top_k_item_mean(spark, d):
    table, users, items = RT.id_ratings(spark, d)
    predictions = RT.scored(table, "user_id", "item_id").select("user_id", "item_id", "prediction")
    allowed = RC.allow_list(table)
    named = RC.named(recommend.rank_items(predictions, 20, allowed), users, items)
    return named.withColumn("prediction", F.round("prediction", 6))


@query(
    "prediction_lookup",
    _with(_SCORED)
    + """SELECT r.user_id, r.item_id, round(coalesce(prediction, 0), 6) AS prediction
    FROM ratings r LEFT JOIN (SELECT * FROM scored WHERE split = 'test') s
      ON r.user_id = s.user_id AND r.item_id = s.item_id""",
)
def prediction_lookup(spark, d):
    docs = RT.store(spark, d)
    users, items = R.dimensions(docs)
    table = RT.labelled(docs)
    stored = R.with_ids(RT.scored(table).where("split = 'test'"), users, items)
    requests = R.with_ids(table, users, items).select("user_id", "item_id")
    found = recommend.look_up(stored.select("user_id", "item_id", "prediction"), requests, missing_as_zero=True)
    return found.withColumn("prediction", F.round("prediction", 6))


@query(
    "cosine_pairs",
    """WITH unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    kept AS (SELECT v, min(vec_id) AS id FROM unit GROUP BY v),
    pairs AS (
      SELECT a.id AS item_id1, b.id AS item_id2,
             1 - list_inner_product(a.v, b.v)
                 / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS dist
      FROM kept a JOIN kept b ON a.id < b.id
      UNION ALL
      SELECT kept.id, vec_id, 0 FROM unit JOIN kept USING (v) WHERE vec_id <> kept.id)
    SELECT item_id1, item_id2, CASE WHEN dist = 0 THEN 0
      ELSE round(dist * pow(10, 4 - floor(log10(abs(dist))))) / pow(10, 4 - floor(log10(abs(dist)))) END AS distance
    FROM pairs WHERE dist <= 0.65""",
)
def cosine_pairs(spark, d):
    return similarity.similar_items(RT.load(spark, d, "embeddings"), "vec_id", "embedding", max_distance=0.65)


@query(
    "similar_item_features",
    _with(_CATALOGUE, _ITEM_TERMS)
    + """, lengths AS (SELECT key, CAST(sum(n * n) AS DOUBLE) AS sq, list(term || '=' || n ORDER BY term) AS v
      FROM listed GROUP BY key),
    numbered AS (SELECT lengths.*, p_partkey AS id FROM lengths JOIN catalogue ON key = item),
    kept AS (SELECT v, min(id) AS id, any_value(sq) AS sq FROM numbered GROUP BY v),
    entries AS (SELECT kept.id, kept.sq, term, n FROM kept JOIN numbered ON kept.id = numbered.id JOIN listed ON listed.key = numbered.key),
    pairs AS (SELECT a.id AS item_id1, b.id AS item_id2, 1 - sum(a.n * b.n) / sqrt(any_value(a.sq) * any_value(b.sq)) AS dist
      FROM entries a JOIN entries b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
    near AS (SELECT * FROM pairs WHERE dist <= 0.12
      UNION ALL SELECT kept.id, numbered.id, 0 FROM numbered JOIN kept USING (v) WHERE numbered.id <> kept.id)
    SELECT item_id1, item_id2, round(dist, 5) AS distance FROM near""",
)
def similar_item_features(spark, d):
    texts = RT.part_items(spark, d).select("p_partkey", F.concat_ws(" ", "item", "style", "maker").alias("text"))
    frequencies = TX.term_frequency(texts, "p_partkey", "text", pattern=ASCII_TOKEN)
    found = sparse_similarity.similar_sparse_items(frequencies, "p_partkey", "term", "tf", 0.12)
    return found.withColumn("distance", F.round("distance", 5))


@query(
    "latent_rank",
    "SELECT vec_id, "
    + ", ".join(
        f"CAST(row_number() OVER (ORDER BY embedding[{i}] DESC, vec_id) AS INTEGER) AS l{i}_rank" for i in range(1, 65)
    )
    + " FROM embeddings",
)
def latent_rank(spark, d):
    return recommend.latent_ranks(RT.load(spark, d, "embeddings"), 64, key="vec_id", features="embedding")


# --------------------------------------------------------------------------- text


@query(
    "text_by_item",
    """SELECT source, part, string_agg(text, '' ORDER BY place) AS text FROM (
      SELECT *, CAST(floor((place - 1) / 20) AS INTEGER) AS part FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents))
    GROUP BY source, part""",
)
def text_by_item(spark, d):
    return TX.text_by_item(RT.load(spark, d, "documents"), "source", "text", ["doc_id"], texts_per_row=20)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
_LEMMA_SQL = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEMMAS.items()) + " ELSE t END"


def _clean_sql(text: str) -> str:
    return f"""coalesce(array_to_string(list_transform(
      list_filter(regexp_extract_all(lower({text}), '{ASCII_TOKEN}'), lambda t: t NOT IN ({_STOP_SQL})),
      lambda t: {_LEMMA_SQL}), ' '), '')"""


@query("clean_text", f"SELECT doc_id, {_clean_sql('text')} AS clean FROM documents")
def clean_text(spark, d):
    docs = RT.documents(spark, d)
    return TX.clean_text(docs, "text", STOP_WORDS, LEMMAS, ASCII_TOKEN).select("doc_id", "clean")


@query(
    "item_clean_text",
    f"""WITH joined AS (
      SELECT source, part, string_agg(text, '' ORDER BY place) AS text FROM (
        SELECT *, CAST(floor((place - 1) / 20) AS INTEGER) AS part FROM (
          SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents))
      GROUP BY source, part)
    SELECT source, part, {_clean_sql('text')} AS clean FROM joined""",
)
def item_clean_text(spark, d):
    return TX.clean_text(text_by_item(spark, d), "text", STOP_WORDS, LEMMAS, ASCII_TOKEN).drop("text")


@query(
    "lemma_table",
    f"""WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '{ASCII_TOKEN}') AS w FROM documents),
    placed AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM words),
    vocabulary AS (SELECT DISTINCT token FROM placed),
    dictionary AS (SELECT p.token, v.token AS lemma FROM vocabulary p JOIN vocabulary v
                   ON length(p.token) > 3 AND p.token = v.token || 's'),
    replaced AS (SELECT doc_id, string_agg(coalesce(lemma, placed.token), ' ' ORDER BY pos) AS words
                 FROM placed LEFT JOIN dictionary USING (token) GROUP BY doc_id)
    SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN replaced USING (doc_id)""",
)
def lemma_table(spark, d):
    """Plural tokens replaced by their singular where the texts hold both."""
    docs = RT.documents(spark, d).select("doc_id", T.tokens("text", ASCII_TOKEN).alias("words"))
    vocabulary = docs.select(F.explode("words").alias("token")).distinct()
    plural = vocabulary.where((F.length("token") > 3) & F.endswith("token", F.lit("s"))).select(
        "token", F.expr("left(token, length(token) - 1)").alias("lemma")
    )
    dictionary = relational.only_listed(plural, vocabulary.withColumnRenamed("token", "lemma"), "lemma")
    done = TX.lemmatize_by_table(docs, "doc_id", "words", materialize(dictionary.select("token", "lemma")))
    return done.withColumn("words", T.joined(F.col("words")))


_DOC_TERMS = _TERMS.format(key="doc_id", text="text", source="documents")


@query("term_frequency", _with(_DOC_TERMS) + "SELECT key AS doc_id, term, round(tf, 6) AS tf FROM tf")
def term_frequency(spark, d):
    found = TX.term_frequency(RT.documents(spark, d), "doc_id", "text", pattern=ASCII_TOKEN)
    return found.withColumn("tf", F.round("tf", 6))


@query("vocabulary", _with(_DOC_TERMS) + "SELECT term, total FROM vocabulary")
def vocabulary(spark, d):
    return TX.vocabulary(
        TX.term_occurrences(RT.documents(spark, d), "doc_id", "text", TX.RATING_WORDS, ASCII_TOKEN)
    )


@query(
    "item_term_frequency",
    _with(_TERMS.format(key="source", text="text", source="documents"))
    + "SELECT key AS source, term, round(tf, 6) AS tf FROM tf",
)
def item_term_frequency(spark, d):
    found = TX.term_frequency(RT.documents(spark, d), "source", "text", pattern=ASCII_TOKEN)
    return found.withColumn("tf", F.round("tf", 6))


@query("ascii_clean", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents")
def ascii_clean(spark, d):
    return features.clean_ascii(RT.documents(spark, d).select("doc_id", "text"), "text")


# --------------------------------------------------------------------------- pages

_LINKS = """
raw_links AS (SELECT page_id, url AS page_url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS found FROM pages),
links AS (SELECT page_id, page_url, CAST(generate_subscripts(found, 1) - 1 AS INTEGER) AS position,
                 unnest(found) AS href FROM raw_links)"""


def _site_links(spark, d) -> DataFrame:
    # The site's address is carried along the links, so nothing has to be joined back.
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("site")
    raw = RT.load(spark, d, "pages").select(F.struct("page_id", site).alias("page"), "html")
    return pages.links(raw, page_id="page").select("page.page_id", "page.site", "position", "href")


@query("page_links", _with(_LINKS) + "SELECT page_id, position, href FROM links")
def page_links(spark, d):
    return pages.links(RT.load(spark, d, "pages"))


@query(
    "item_links",
    _with(_LINKS)
    + """SELECT page_id, position, href, regexp_extract(page_url, '^(https?://[^/]+)', 1) || href AS url FROM links
    WHERE starts_with(href, '/') AND NOT contains(href, '.') AND NOT contains(href, ',')""",
)
def item_links(spark, d):
    kept = pages.keep_links(_site_links(spark, d), prefix="/", excluding=(".", ","))
    return pages.absolute(kept, F.col("site")).select("page_id", "position", "href", "url")


@query(
    "unseen_items",
    _with(_LINKS)
    + """SELECT page_id, position, regexp_extract(page_url, '^(https?://[^/]+)', 1) || href AS url FROM links
    WHERE regexp_extract(page_url, '^(https?://[^/]+)', 1) || href NOT IN (SELECT url FROM pages)""",
)
def unseen_items(spark, d):
    found = pages.absolute(_site_links(spark, d), F.col("site"))
    stored = materialize(RT.load(spark, d, "pages").select("url").distinct())
    unseen = relational.only_unseen(found, stored, "url")
    return unseen.select("page_id", "position", "url")


@query(
    "page_fields",
    r"""SELECT * FROM (
      SELECT page_id, nullif(regexp_extract(html, '<html[^>]*\slang="([^"]*)"', 1), '') AS language,
             nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title,
             coalesce(nullif(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), ''), 'NA') AS heading FROM pages)
    WHERE title IS NOT NULL""",
)
def page_fields(spark, d):
    patterns = {
        "language": pages.LANGUAGE_PATTERN,
        "title": pages.TITLE_PATTERN,
        "heading": pages.HEADING_PATTERN,
    }
    return pages.page_fields(RT.load(spark, d, "pages"), patterns, ("title",), {"heading": S.MISSING})


def _score_text(text_type: str) -> str:
    quantity = f"CAST(CAST(l_quantity AS INTEGER) AS {text_type})"
    line = f"CAST(l_linenumber AS {text_type})"
    return (
        f"concat('AROMA ', {line}, '/10 APPEARANCE ', {line}, '/0 TASTE ', {quantity}, '/50 PALATE ', "
        f"CASE WHEN l_linenumber = 7 THEN 'none' ELSE concat({line}, '/7') END, ' OVERALL 15/20')"
    )


@query(
    "review_parse",
    _with(_REVIEWS)
    + f""", raw AS (SELECT review_id, l_orderkey, l_linenumber, {_score_text('VARCHAR')} AS scores,
      CASE WHEN l_linenumber = 6 THEN user_name ELSE concat(user_name, ' - ', region, ' - ', 'day ', CAST(l_orderkey AS VARCHAR)) END AS author
      FROM reviews),
    parsed AS (SELECT *, regexp_extract_all(scores, '([0-9]+/[0-9]+)', 1) AS f, string_split(author, ' - ') AS who FROM raw)
    SELECT review_id, l_orderkey, l_linenumber,
      """
    + ",\n      ".join(
        f"CASE WHEN split_part(f[{i}], '/', 2) IN ('', '0') THEN NULL ELSE CAST(split_part(f[{i}], '/', 1) AS DOUBLE)"
        f" / CAST(split_part(f[{i}], '/', 2) AS DOUBLE) END AS {name}"
        for i, name in enumerate(pages.REVIEW_PARTS, start=1)
    )
    + """,
      who[1] AS user_name, who[2] AS location, who[3] AS date FROM parsed""",
)
def review_parse(spark, d):
    raw = RT.reviews(spark, d).select(
        "review_id",
        "l_orderkey",
        "l_linenumber",
        F.expr(_score_text("STRING")).alias("scores"),
        F.when(F.col("l_linenumber") == 6, F.col("user_name"))
        .otherwise(F.concat("user_name", F.lit(" - "), "region", F.lit(" - "), F.lit("day "), F.col("l_orderkey").cast("string")))
        .alias("author"),
    )
    return pages.review_fields(raw, "scores", "author").drop("scores", "author")


@query(
    "page_anchors",
    r"""WITH raw AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 0) AS w FROM pages),
    one AS (SELECT page_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS position, unnest(w) AS x FROM raw)
    SELECT page_id, position, regexp_extract(x, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS href,
           trim(regexp_replace(regexp_extract(x, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2), '<[^>]*>', '', 'g')) AS name FROM one""",
)
def page_anchors(spark, d):
    return pages.anchors(RT.load(spark, d, "pages"))


@query(
    "unseen_names",
    r"""WITH raw AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS w FROM pages),
    one AS (SELECT page_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS position, trim(regexp_replace(unnest(w), '<[^>]*>', '', 'g')) AS name FROM raw)
    SELECT page_id, position, name FROM one
    WHERE lower(name) NOT IN (SELECT lower(n_name) FROM nation UNION SELECT 'the' UNION SELECT 'and')""",
)
def unseen_names(spark, d):
    """Anchors whose text is not among the stored names: links are compared by text, not by address."""
    stored = RT.load(spark, d, "nation").select(F.lower("n_name").alias("key")).union(spark.createDataFrame([("the",), ("and",)], "key string"))
    found = pages.anchors(RT.load(spark, d, "pages")).withColumn("key", F.lower("name"))
    return relational.only_unseen(found, stored, "key").select("page_id", "position", "name")


@query(
    "page_paragraphs",
    r"""SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)[2] AS second, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)[-1] AS last
    FROM pages WHERE nullif(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)[2], '') IS NOT NULL AND nullif(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)[-1], '') IS NOT NULL""",
)
def page_paragraphs(spark, d):
    """Fields that are not the first match of their pattern."""
    paragraph = r"(?s)<p>(.*?)</p>"
    wanted = {"second": paragraph, "last": paragraph}
    return pages.page_fields(RT.load(spark, d, "pages"), wanted, ("second", "last"), places={"second": 2, "last": -1})


@query(
    "review_text",
    _with(_REVIEWS)
    + """SELECT l_orderkey, l_linenumber, review_id, CAST(l_linenumber AS DOUBLE) + 0.5 AS combined,
    trim(concat(item, ' by ', maker)) AS review FROM reviews""",
)
def review_text(spark, d):
    """The overall score and the text of a review block."""
    raw = RT.reviews(spark, d).select(
        "review_id", "l_orderkey", "l_linenumber", F.lit("").alias("scores"), F.lit("").alias("author"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(".5/5 of all")).alias("of_all"),
        F.concat(F.lit("<p> <b>"), "item", F.lit("</b> by <i class='m'>"), "maker", F.lit("</i></p>")).alias("body"),
    )
    return pages.review_fields(raw, "scores", "author", "of_all", "body").select("l_orderkey", "l_linenumber", "review_id", "combined", "review")


# --------------------------------------------------------------------------- sources and sinks
#
# Each writes rows of the given tables to the shared folder and reads them back; SQL sees the input.


@query("document_export", _with(_DOCS) + "SELECT review_id, item, user_name, taste FROM docs WHERE region = 'NATION_7'")
def document_export(spark, d):
    """Documents as JSON lines, scanned with a filter and a field list."""
    folder = shared_folder(spark, "json")
    RT.stored_reviews(spark, d).select("review_id", "item", "user_name", "taste", "region").write.json(folder)
    return readers.documents(spark, folder, ["review_id", "item", "user_name", "taste"], F.col("region") == "NATION_7")


@query("csv_round_trip", _with(_SIDE) + "SELECT item, abv, maker || ', \"' || style || '\"' AS label FROM side")
def csv_round_trip(spark, d):
    folder = shared_folder(spark, "csv")
    label = F.concat("maker", F.lit(', "'), "style", F.lit('"')).alias("label")
    writers.write_csv(item_side_data(spark, d).select("item", "abv", label), folder)
    return readers.csv(spark, folder, "item string, abv double, label string")


@query("rating_line_scan", _with(_RATINGS) + "SELECT CAST(taste AS VARCHAR) AS taste, CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id FROM ratings")
def rating_line_scan(spark, d):
    """Plain lines, each file with a header, first three fields as text."""
    folder = shared_folder(spark, "lines")
    RT.ratings(spark, d).select("taste", "user_id", "item_id", "appdata").write.option("header", True).csv(folder)
    lines = spark.read.text(folder).withColumn("value", F.regexp_replace("value", ",appdata$", ""))
    plain = shared_folder(spark, "plain")
    lines.write.text(plain)
    return readers.rating_lines(spark, plain)


@query("bound_query", _with(_RATINGS) + "SELECT item, count(*) AS n FROM ratings WHERE taste >= 7.5 GROUP BY item")
def bound_query(spark, d):
    """SQL over named frames with a bound value."""
    return readers.query(spark, "SELECT item, count(*) AS n FROM {rated} WHERE taste >= :low GROUP BY item", {"low": 7.5}, rated=RT.rated(spark, d))


@query("sorted_table", _with(_RATINGS) + "SELECT user_name, item, taste FROM ratings")
def sorted_table(spark, d):
    folder = shared_folder(spark, "sorted")
    writers.create_table(RT.rated(spark, d).select("user_name", "item", "taste"), folder, ("user_name", "item"))
    return readers.table(spark, folder)


@query("appended_rows", _with(_RATINGS) + "SELECT user_name, item, taste FROM ratings UNION ALL SELECT user_name, item, taste FROM ratings WHERE appdata = 1")
def appended_rows(spark, d):
    folder, rated = shared_folder(spark, "rows"), materialize(RT.rated(spark, d))
    writers.create_table(rated.select("user_name", "item", "taste"), folder)
    writers.append_rows(rated.where("appdata = 1").select("user_name", "item", "taste"), folder)
    return readers.table(spark, folder)


@query("keyed_insert", _with(_DOCS) + "SELECT review_id, taste FROM docs")
def keyed_insert(spark, d):
    """Reviews inserted by key in two overlapping batches: what is stored stays, a repeated batch adds nothing."""
    folder, raw = shared_folder(spark, "keyed"), RT.reviews(spark, d).select("review_id", "taste", *RT.REVIEW_ORDER[:3])
    order = [F.col(c) for c in RT.REVIEW_ORDER]
    middle = F.lit(NEW_RATINGS_FROM).cast("timestamp_ntz")
    for batch in (raw.where(F.col("review_ts") < middle), raw, raw.where(F.col("review_ts") < middle)):
        writers.insert_new(batch, folder, "review_id", order)
    return readers.table(spark, folder, ["review_id", "taste"])


@query("keyed_store", _with(_DOCS) + "SELECT review_id, taste FROM docs")
def keyed_store_query(spark, d):
    """The batches of `keyed_insert` in a store of parts with Bloom filters, where a batch reads only the parts it may meet."""
    raw = RT.reviews(spark, d).select("review_id", "taste", *RT.REVIEW_ORDER[:3])
    order = [F.col(c) for c in RT.REVIEW_ORDER]
    middle = F.lit(NEW_RATINGS_FROM).cast("timestamp_ntz")
    store = keyed_store.KeyedStore(shared_folder(spark, "keyed-store"), "review_id")
    for batch in (raw.where(F.col("review_ts") < middle), raw, raw.where(F.col("review_ts") < middle)):
        store.insert(batch, order)
    return store.rows(raw).select("review_id", "taste")


@query("stored_scores", _with(_SCORED) + "SELECT user_id, item_id, round(prediction, 6) AS prediction FROM scored WHERE user_id = 7")
def stored_scores(spark, d):
    """Scores in user buckets, one user looked up."""
    docs = RT.store(spark, d)
    users, items = R.dimensions(docs)
    scores = R.with_ids(RT.scored(RT.labelled(docs)), users, items).select("user_id", "item_id", F.round("prediction", 6).alias("prediction"))
    folder = shared_folder(spark, "scores")
    writers.store_predictions(scores, folder)
    return readers.user_predictions(spark, folder, 7).select("user_id", "item_id", "prediction")


# --------------------------------------------------------------------------- functions


@query(
    "scored_pairs",
    _with(_SCORED)
    + """SELECT user_id, item_id, taste, round(prediction, 6) AS prediction, round(abs(prediction - taste), 6) AS error
    FROM labelled JOIN (SELECT user_id, item_id, prediction FROM scored) USING (user_id, item_id)""",
)
def scored_pairs(spark, d):
    """Truth beside prediction on user and item, with the absolute error."""
    scores = materialize(RT.scored(RT.id_ratings(spark, d)[0], "user_id", "item_id"))
    truth = scores.select("user_id", "item_id", F.col("actual").alias("taste"))
    both = EV.score_pairs(truth, scores.select("user_id", "item_id", "prediction"))
    found = EV.absolute_errors(both.withColumn("actual", F.col("taste"))).drop("actual")
    return found.withColumns({c: F.round(c, 6) for c in ("prediction", "error")})


@query(
    "scalar_functions",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size + 0.5 AS DOUBLE) END AS leading,
    contains(concat(p_type, CASE WHEN p_size % 2 = 0 THEN ' 50%' ELSE '' END), '%') AS has_percent,
    printf('%.1f', floor((p_size + 0.25) * 10 + 0.5) / 10) AS one_digit, least(p_partkey, p_size * 40) AS low, greatest(p_partkey, p_size * 40) AS high FROM part""",
)
def scalar_functions(spark, d):
    part = RT.load(spark, d, "part")
    low, high = S.ordered_pair("p_partkey", F.col("p_size").cast("long") * 40)
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("none/5")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5/5")))
    marked = F.concat("p_type", F.when(F.col("p_size") % 2 == 0, F.lit(" 50%")).otherwise(""))
    return part.select(
        "p_partkey", S.leading_number(text).alias("leading"), S.has_percent(marked).alias("has_percent"),
        S.one_decimal(F.col("p_size") + 0.25).alias("one_digit"), low.alias("low"), high.alias("high"),
    )


@query(
    "grids",
    _with(_SCORED) + "SELECT k AS point_no, round(CAST(0.05 + 0.0375 * k AS DOUBLE), 8) AS linear, round(pow(10.0, -4 + k), 8) AS logarithmic, (SELECT count(*) FROM scored) AS n FROM range(5) AS r(k)",
)
def grids(spark, d):
    """Parameter grids beside the number of rows that they would be tried on."""
    points = list(enumerate(zip(S.linear_grid(0.05, 0.2, 5), S.log_grid(-4, 0, 5))))
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in points], "point_no long, linear double, logarithmic double")
    n = _scored(spark, d).count()
    return table.select("point_no", F.round("linear", 8).alias("linear"), F.round("logarithmic", 8).alias("logarithmic"), F.lit(n).cast("long").alias("n"))


@query(
    "unicode_tokens",
    r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\pL\pM\p{Nd}\p{Pc}]{2,}')) AS n FROM documents""",
)
def unicode_tokens(spark, d):
    """Number of tokens under the library's default pattern."""
    return RT.load(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n"))


@query("links_containing", _with(_LINKS) + "SELECT page_id, position, href FROM links WHERE contains(href, 'th')")
def links_containing(spark, d):
    return pages.keep_links(page_links(spark, d), containing="th")


@query(
    "style_one_hot",
    _with(_SIDE) + "SELECT item, style AS value, CAST(1 AS INTEGER) AS flag FROM raw_side WHERE style IS NOT NULL",
)
def style_one_hot(spark, d):
    """One-hot flags in long form, for any number of values."""
    return features.one_hot_flags(I.raw_side_data(RT.reviews(spark, d)), "item", "style")


# --------------------------------------------------------------------------- models
#
# Values of a fitted model have no SQL form; beside each value query stands one whose rows SQL can check.

_SPLIT_SQL = """,
labelled AS (
  SELECT *, CASE WHEN CAST('0x' || substr(md5(review_id), 1, 8) AS BIGINT) % 10000 < 2000
                 THEN 'test' ELSE 'train' END AS split FROM ratings),
trained_users AS (SELECT DISTINCT user_id FROM labelled WHERE split = 'train'),
trained_items AS (SELECT DISTINCT item_id FROM labelled WHERE split = 'train'),
scorable AS (SELECT user_id, item_id FROM labelled
             WHERE split = 'test' AND user_id IN (FROM trained_users) AND item_id IN (FROM trained_items))"""
_SIDE_TERMS = ("style", "maker", "abv", "calories")


def _typed(spark, d) -> DataFrame:
    """The rating table by ids, written."""
    return R.typed_ratings(RT.id_ratings(spark, d)[0])


def _split_typed(spark, d) -> tuple[DataFrame, DataFrame]:
    return split.train_and_test(RT.id_ratings(spark, d)[0].select("user_id", "item_id", "taste", "split"))


def _split_with_side(spark, d) -> tuple[DataFrame, DataFrame]:
    rated, _, items, sides = RT.id_ratings(spark, d, sides=True)
    side = I.item_side_data(sides, items).select("item_id", *_SIDE_TERMS)
    return split.train_and_test(materialize(rated.drop("appdata").join(side, "item_id")))


@query("als_top20")
def als_top20(spark, d):
    rated, users, items = RT.id_ratings(spark, d)
    return RC.retrain_and_rank(rated, users=users, items=items)


@query(
    "als_top20_check",
    _with(_RATINGS)
    + """SELECT user_id, least(20, (SELECT count(*) FROM (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= 10))) AS n,
    true AS gapless, true AS falling, true AS allowed_only FROM (SELECT DISTINCT user_id FROM ratings)""",
)
def als_top20_check(spark, d):
    """Of each user's list: its length, ranks 1 to n, falling scores, and allowed items only."""
    rated = RT.id_ratings(spark, d)[0]
    allowed = RC.allow_list(rated)
    best = materialize(recommend.recommend_top_k(models.fit_final_model(R.typed_ratings(rated)), None, 20, allowed))
    marked = best.join(allowed.withColumn("listed", F.lit(True)), "item_id", "left")
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "prediction")))  # at most 20 rows of a user
    lists = marked.groupBy("user_id").agg(by_rank.alias("l"), F.count("*").alias("n"), F.count("listed").alias("m"))
    scores = F.transform("l", lambda x: x["prediction"])
    return lists.select(
        "user_id",
        "n",
        (F.transform("l", lambda x: x["rank"]) == F.sequence(F.lit(1), F.col("n").cast("int"))).alias("gapless"),
        (scores == F.sort_array(scores, asc=False)).alias("falling"),
        (F.col("n") == F.col("m")).alias("allowed_only"),
    )


@query("als_predictions")
def als_predictions(spark, d):
    train, test = _split_typed(spark, d)
    return models.predict_pairs(models.fit_final_model(train), test)


@query("als_prediction_pairs", _with(_RATINGS + _SPLIT_SQL) + "SELECT user_id, item_id, true AS finite FROM scorable")
def als_prediction_pairs(spark, d):
    """The pairs that are scored under cold start, and whether each score is a number."""
    found = als_predictions(spark, d)
    return found.select("user_id", "item_id", (F.abs("prediction") < float("inf")).alias("finite"))


@query("als_user_optimality", _with(_RATINGS) + "SELECT DISTINCT user_id, true AS optimal FROM ratings")
def als_user_optimality(spark, d):
    """Whether the last half-step solved each user's non-negative ridge problem against the final item factors."""
    typed = _typed(spark, d)
    model = models.fit_final_model(typed)
    return models.user_optimality(model, typed, models.FINAL_REG)


@query("fold_in_check", _with(_RATINGS) + "SELECT DISTINCT user_id, true AS same FROM ratings")
def fold_in_check(spark, d):
    """All users folded into the fitted model: the factors that the fit's own last half-step gave them."""
    typed = _typed(spark, d)
    model = models.fit_final_model(typed)
    folded = fold_in.fold_in_users(model, typed, models.FINAL_REG)
    both = folded.userFactors.join(model.userFactors.withColumnRenamed("features", "fitted"), "id")
    far = F.array_max(F.zip_with("features", "fitted", lambda x, y: F.abs(x - y)))
    return both.select(F.col("id").alias("user_id"), (far <= 1e-3 * (1 + F.array_max("fitted"))).alias("same"))


_NEW_SQL = f""",
dated AS (SELECT r.user_id, r.item_id, r.user_name, d.review_ts >= TIMESTAMP '{NEW_RATINGS_FROM}' AS fresh FROM ratings r JOIN docs d USING (review_id)),
known_items AS (SELECT DISTINCT item_id FROM dated WHERE NOT fresh),
touched AS (SELECT DISTINCT user_id FROM dated WHERE fresh)"""


def _refreshed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rating table by ids, its older part as numbers and its newer part, and the names of users and items."""
    rated, users, items = RT.id_ratings(spark, d, keep=("review_ts",))
    fresh = F.col("review_ts") >= F.lit(NEW_RATINGS_FROM).cast("timestamp_ntz")
    return rated, materialize(R.typed_ratings(rated.where(~fresh))), rated.where(fresh), users, items


@query(
    "fold_in_optimality",
    _with(_RATINGS + _NEW_SQL)
    + "SELECT DISTINCT user_id, true AS optimal FROM dated WHERE user_id IN (FROM touched) AND item_id IN (FROM known_items)",
)
def fold_in_optimality(spark, d):
    """A model of the older ratings, then the newer ones: whether each touched user's factors solve the problem of all the user's ratings."""
    rated, old, new, _, _ = _refreshed(spark, d)
    model = models.fit_final_model(old)
    typed, touched = R.typed_ratings(rated), materialize(new.select("user_id").distinct())
    folded = fold_in.fold_in_users(model, typed, models.FINAL_REG, touched)
    found = models.user_optimality(folded, typed.join(touched, "user_id"), models.FINAL_REG)
    return found


@query(
    "refreshed_top20",
    _with(_RATINGS + _NEW_SQL)
    + """, allowed AS (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= 10),
    held AS (SELECT DISTINCT user_name FROM dated WHERE user_id IN (FROM touched) AND item_id IN (FROM known_items)
             UNION SELECT user_name FROM dated WHERE user_id IN (FROM touched) AND NOT fresh)
    SELECT user_name, least(20, (SELECT count(*) FROM allowed WHERE item_id IN (FROM known_items))) AS n, true AS gapless FROM held""",
)
def refreshed_top20(spark, d):
    """The lists of the users with newer ratings, from a model of the older ones."""
    rated, old, new, users, items = _refreshed(spark, d)
    best = RC.refresh_and_rank(models.fit_final_model(old), rated, new.select("user_id"), users=users, items=items)
    lists = best.groupBy("user_name").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks"))
    return lists.select("user_name", "n", ((F.col("last") == F.col("n")) & (F.col("ranks") == F.col("n"))).alias("gapless"))


@query("catalogue_scores")
def catalogue_scores(spark, d):
    """The whole catalogue scored for one user, as kept for later look-ups."""
    rated, _, items = RT.id_ratings(spark, d)
    model = models.fit_final_model(R.typed_ratings(rated))
    return recommend.score_catalogue(model, items, [0])


@query(
    "catalogue_score_pairs",
    _with(_RATINGS)
    + """SELECT u.user_id, i.item_id, true AS scored FROM (SELECT DISTINCT item_id FROM ratings) i,
    (SELECT DISTINCT user_id FROM ratings WHERE user_id IN (0, 3)) u""",
)
def catalogue_score_pairs(spark, d):
    """Whole-catalogue scores of two users, written to the shared folder and looked up there."""
    rated, _, items = RT.id_ratings(spark, d)
    model = models.fit_final_model(R.typed_ratings(rated))
    folder = shared_folder(spark, "catalogue")
    RC.store_catalogue(model, items, [0, 3], folder)
    both = readers.user_predictions(spark, folder, 0).unionByName(readers.user_predictions(spark, folder, 3))
    return both.select("user_id", "item_id", F.col("prediction").isNotNull().alias("scored"))


@query("als_latent_rank")
def als_latent_rank(spark, d):
    rated, _, items = RT.id_ratings(spark, d)
    model = models.fit_final_model(R.typed_ratings(rated))
    ranks = recommend.latent_ranks(model.itemFactors, model.rank, key="id").withColumnRenamed("id", "item_id")
    return relational.attach_names(ranks, items, "item_id")


@query(
    "als_latent_rank_check",
    _with(_RATINGS)
    + """, n AS (SELECT count(DISTINCT item_id) AS n FROM ratings)
    SELECT 'l' || k || '_rank' AS factor, n AS items, n AS ranks, CAST(1 AS INTEGER) AS first, CAST(n AS INTEGER) AS last
    FROM n, range(1, 7) AS r(k)""",
)
def als_latent_rank_check(spark, d):
    names = [f"l{k}_rank" for k in range(1, 7)]
    long = als_latent_rank(spark, d).unpivot(["item", "item_id"], names, "factor", "place")
    return long.groupBy("factor").agg(
        F.count("*").alias("items"), F.countDistinct("place").alias("ranks"), F.min("place").alias("first"), F.max("place").alias("last")
    )


@query("als_sweep")
def als_sweep(spark, d):
    train, test = _split_typed(spark, d)
    return search.sweep(train, test, parallelism=4)


@query(
    "als_sweep_check",
    _with(_RATINGS + _SPLIT_SQL)
    + "SELECT point_no, rank, round(reg, 6) AS reg, (SELECT count(*) FROM scorable) AS n, true AS in_range FROM (VALUES "
    + ", ".join(
        f"({i}::INTEGER, {rank}::INTEGER, {reg}::DOUBLE)"
        for i, (rank, reg) in enumerate((k, r) for k in search.GRID_RANKS for r in search.GRID_REGS)
    )
    + ") AS p(point_no, rank, reg)",
)
def als_sweep_check(spark, d):
    """Grid points, scored test rows, and whether both rates lie where they can."""
    found = als_sweep(spark, d)
    ok = F.col("class_rate").between(0, 1) & F.col("rmse").between(0, 10)
    return found.select("point_no", "rank", F.round("reg", 6).alias("reg"), "n", ok.alias("in_range"))


@query("factorization_predictions")
def factorization_predictions(spark, d):
    """The published model: 5 factors, no side data."""
    train, test = _split_typed(spark, d)
    return factorization.fit_joint_factorization(train).predict(test)


def _planted(rated: DataFrame, liking: Column) -> DataFrame:
    """The pairs of the rating table with ratings that a model has to find: users of two kinds rate the items of two kinds 3 above or below."""
    user = F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1)
    item = F.when(liking, 1).otherwise(-1)
    return rated.withColumn("taste", 6.0 + (F.col("user_id") % 5 - 2) / 2 + 3.0 * user * item)


def _planted_with_side(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Planted ratings whose two kinds of items are those of odd and even makers, in two parts, and the items' side data.

    A tenth of the items has no rating in the first part.
    """
    docs = RT.store(spark, d, *_SIDE_COLUMNS)
    users, items = R.dimensions(docs)
    side = materialize(I.item_side_data(docs, items).select("item_id", *_SIDE_TERMS))
    pairs = R.with_ids(R.rated_reviews(docs), users, items)
    odd = F.substring("maker", -1, 1).cast("int") % 2 == 1
    rated = _planted(split.hash_split(pairs, ["review_id"]).join(side.select("item_id", "maker"), "item_id"), odd)
    train, test = split.train_and_test(materialize(rated.select("user_id", "item_id", "taste", "split")))
    return train.where("item_id % 10 <> 0"), test, side


def _errors(train: DataFrame, predicted: DataFrame, linear: DataFrame) -> DataFrame:
    """Scored rows, and whether the model's RMSE is under 0.7 times that of the training mean and of its own linear part."""
    mean = train.agg(F.avg("taste")).scalar()
    both = predicted.join(linear.select("user_id", "item_id", "linear"), ["user_id", "item_id"])
    rms = {n: EV.root_mean_square(F.col("taste") - c) for n, c in (("model", F.col("prediction")), ("linear", F.col("linear")), ("mean", F.lit(mean)))}
    found = both.agg(F.count("*").alias("n"), *[c.alias(n) for n, c in rms.items()])
    return found.select("n", *[(F.col("model") < 0.7 * F.col(n)).alias(f"better_than_{n}") for n in ("mean", "linear")])


@query(
    "factorization_check",
    _with(_RATINGS + _SPLIT_SQL) + "SELECT count(*) AS n, true AS better_than_mean, true AS better_than_linear FROM scorable",
)
def factorization_check(spark, d):
    """The published model against planted ratings that no sum of terms explains."""
    train, test = (_planted(part, F.col("item_id") % 2 == 0) for part in _split_typed(spark, d))
    model = factorization.fit_joint_factorization(train)
    return _errors(train, model.predict(test), model.linear(test, "linear"))


_SIDE_MODEL = dict(num_factors=12, reg=1e-4, lin_reg=1e-5, iterations=15)


@query("side_factorization_predictions")
def side_factorization_predictions(spark, d):
    docs = RT.store(spark, d, *_SIDE_COLUMNS)
    users, items = R.dimensions(docs)
    side = materialize(I.item_side_data(docs, items).select("item_id", *_SIDE_TERMS))
    pairs = R.with_ids(R.rated_reviews(docs), users, items)
    labelled = split.hash_split(pairs, ["review_id"]).select("user_id", "item_id", "taste", "split")
    train, test = split.train_and_test(materialize(labelled))
    return factorization.fit_joint_factorization(train, side, _SIDE_TERMS, **_SIDE_MODEL).predict(test)


_COLD_SQL = """,
warm_users AS (SELECT DISTINCT user_id FROM labelled WHERE split = 'train' AND item_id % 10 <> 0)"""


@query(
    "side_factorization_check",
    _with(_RATINGS + _SPLIT_SQL + _COLD_SQL)
    + """SELECT item_id % 10 = 0 AS cold, count(*) AS n, true AS better_than_mean, true AS better_than_linear
    FROM labelled WHERE split = 'test' AND user_id IN (FROM warm_users) GROUP BY 1""",
)
def side_factorization_check(spark, d):
    """Factors on side values against planted ratings, for items with training ratings and for items known by their side values alone."""
    train, test, side = _planted_with_side(spark, d)
    model = factorization.fit_joint_factorization(train, side, ("maker", "abv"), **_SIDE_MODEL)
    predicted, linear = materialize(model.predict(test)), materialize(model.linear(test, "linear"))
    parts = [(cold, F.col("item_id") % 10 == 0 if cold else F.col("item_id") % 10 != 0) for cold in (True, False)]
    found = [_errors(train, predicted.where(at), linear.where(at)).select(F.lit(cold).alias("cold"), "*") for cold, at in parts]
    return found[0].unionByName(found[1])


@query(
    "factorization_block_check",
    _with(_SIDE + _SPLIT_SQL)
    + """, train AS (SELECT user_id, item_id FROM labelled WHERE split = 'train' AND item_id % 10 <> 0)
    SELECT 'user_id' AS block, count(DISTINCT user_id) AS keys, true AS still FROM train
    UNION ALL SELECT 'item_id', count(DISTINCT item_id), true FROM train
    UNION ALL SELECT 'maker', count(DISTINCT maker), true FROM side WHERE item_id IN (SELECT item_id FROM train)
    UNION ALL SELECT 'abv', 1, true""",
)
def factorization_block_check(spark, d):
    """Whether the loss stands still in the terms and factors of every block at the end of the fit."""
    train, _, side = _planted_with_side(spark, d)
    model = factorization.fit_joint_factorization(train, side, ("maker", "abv"), num_factors=2, reg=1e-4, lin_reg=1e-5, iterations=20, tolerance=1e-5)
    return factorization.block_slopes(model).select("block", "keys", (F.col("slope") < 0.05).alias("still"))


@query("ranking_factorization_predictions")
def ranking_factorization_predictions(spark, d):
    """The published ranking model: 12 factors, 15 iterations, side values with factors of their own, unseen items held low."""
    docs = RT.store(spark, d, *_SIDE_COLUMNS)
    users, items = R.dimensions(docs)
    side = materialize(I.item_side_data(docs, items).select("item_id", *_SIDE_TERMS))
    rated = R.typed_ratings(R.with_ids(R.rated_reviews(docs), users, items))
    train, valid = split.train_and_test(materialize(split.split_by_user(rated, "user_id", "item_id", max_users=4000)))
    return factorization.fit_ranking_factorization(train, side, _SIDE_TERMS).predict(valid)


@query(
    "ranking_factorization_check",
    _with(_SIDE + _SPLIT_SQL)
    + """SELECT count(*) AS held_out, true AS finds_liked_items, true AS clearly_better FROM labelled JOIN side USING (item_id)
    WHERE split = 'test' AND (user_id % 2 = 0) = (CAST(right(maker, 1) AS INTEGER) % 2 = 1)""",
)
def ranking_factorization_check(spark, d):
    """Users rate what they like alone: held-out items of theirs against one item each that they have not rated.

    Half of those items are liked too, so 3 of 4 cases is the best that a model can do. The model with side data must come near to that, for items
    without training ratings too, where it must be clearly better than the ranking model without side data.
    """
    train, test, side = _planted_with_side(spark, d)
    liked = F.col("taste") > 6.0 + (F.col("user_id") % 5 - 2) / 2
    train, held_out = materialize(train.where(liked)), materialize(test.where(liked).select("user_id", "item_id"))
    plain = models.fit_ranking_model(train)
    fitted = (factorization.fit_ranking_factorization(train, side, ("maker", "abv")).predict, lambda pairs: models.predict_pairs(plain, pairs))
    parts = (held_out, held_out.where("item_id % 10 = 0"))
    shares = [[factorization.pairwise_accuracy(predict, part, train).first()["share"] for part in parts] for predict in fitted]
    return held_out.agg(F.count("*").alias("held_out")).select(
        "held_out",
        F.lit(shares[0][0] > 0.68 and shares[0][1] > 0.55).alias("finds_liked_items"),
        F.lit(shares[0][0] > shares[1][0] and shares[0][1] > shares[1][1] + 0.1).alias("clearly_better"),
    )


_TERMS_SQL = (
    _SIDE
    + _SPLIT_SQL
    + """,
base AS (SELECT user_id, labelled.item_id, taste AS y, style, maker, abv, calories FROM labelled JOIN side USING (item_id) WHERE split = 'train'),
c AS (SELECT avg(y) AS m, count(*) * 2e-5 AS s FROM base),
r1 AS (SELECT *, y - (SELECT m FROM c) AS r FROM base),
t1 AS (SELECT style, sum(r) / (count(*) + (SELECT s FROM c)) AS t FROM r1 GROUP BY style),
r2 AS (SELECT r1.* EXCLUDE (r), r - t AS r FROM r1 JOIN t1 USING (style)),
t2 AS (SELECT maker, sum(r) / (count(*) + (SELECT s FROM c)) AS t FROM r2 GROUP BY maker),
r3 AS (SELECT r2.* EXCLUDE (r), r - t AS r FROM r2 JOIN t2 USING (maker)),
z3 AS (SELECT avg(abv) AS mu, stddev_pop(abv) AS sd FROM base),
t3 AS (SELECT sum(r * (abv - mu) / sd) / (sum(((abv - mu) / sd) ** 2) + (SELECT s FROM c)) AS t FROM r3, z3),
r4 AS (SELECT r3.* EXCLUDE (r), r - t * (abv - mu) / sd AS r FROM r3, t3, z3),
z4 AS (SELECT avg(calories) AS mu, stddev_pop(calories) AS sd FROM base),
t4 AS (SELECT sum(r * (calories - mu) / sd) / (sum(((calories - mu) / sd) ** 2) + (SELECT s FROM c)) AS t FROM r4, z4),
r5 AS (SELECT r4.* EXCLUDE (r), r - t * (calories - mu) / sd AS r FROM r4, t4, z4),
i1 AS (SELECT item_id, sum(r) / (count(*) + (SELECT s FROM c)) AS t FROM r5 GROUP BY item_id),
u1 AS (SELECT user_id, sum(r - t) / (count(*) + (SELECT s FROM c)) AS t FROM r5 JOIN i1 USING (item_id) GROUP BY user_id),
i2 AS (SELECT item_id, sum(r - t) / (count(*) + (SELECT s FROM c)) AS t FROM r5 JOIN u1 USING (user_id) GROUP BY item_id),
u2 AS (SELECT user_id, sum(r - t) / (count(*) + (SELECT s FROM c)) AS t FROM r5 JOIN i2 USING (item_id) GROUP BY user_id)"""
)


@query(
    "factorization_terms",
    _with(_TERMS_SQL)
    + """SELECT kind, key, round(t, 5) AS term FROM (
      SELECT 'mean' AS kind, '' AS key, m AS t FROM c
      UNION ALL SELECT 'style', style, t FROM t1 UNION ALL SELECT 'maker', maker, t FROM t2
      UNION ALL SELECT 'abv', '', t FROM t3 UNION ALL SELECT 'calories', '', t FROM t4
      UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), t FROM i2 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), t FROM u2)""",
)
def factorization_terms(spark, d):
    """All terms of the linear part: mean, side columns, items and users."""
    train, _ = _split_with_side(spark, d)
    model = models.fit_linear_terms(train, side_columns=_SIDE_TERMS)
    one = [("mean", "", model.mean)] + [(t.column, "", t.slope) for t in model.side_terms if isinstance(t, models.NumberTerm)]
    terms = spark.createDataFrame(one, "kind string, key string, term double")
    tables = [(t.column, t.table.select(F.col(t.column).alias("key"), "term")) for t in model.side_terms if isinstance(t, models.ValueTerm)]
    tables += [(n, t.select(F.col(f"{n}_id").cast("string").alias("key"), F.col(f"{n}_term").alias("term"))) for n, t in (("item", model.item_terms), ("user", model.user_terms))]
    for kind, found in tables:
        terms = terms.unionByName(found.withColumn("kind", F.lit(kind)))
    return terms.withColumn("term", F.round("term", 5))


@query("implicit_top20")
def implicit_top20(spark, d):
    rated = RT.id_ratings(spark, d)[0]
    model = models.fit_ranking_model(R.typed_ratings(rated))
    return recommend.recommend_top_k(model, None, 20, RC.allow_list(rated))


@query(
    "implicit_top20_check",
    _with(_RATINGS)
    + """SELECT user_id, least(20, (SELECT count(*) FROM (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= 10))) AS n,
    CAST(1 AS INTEGER) AS first FROM (SELECT DISTINCT user_id FROM ratings)""",
)
def implicit_top20_check(spark, d):
    return implicit_top20(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.min("rank").alias("first"))


_SEARCHES = {
    "random_search": dict(nmf=[True, False]),
    "wide_random_search": dict(
        reg=search.WIDE_PENALTIES, lin_reg=search.WIDE_PENALTIES, nmf=(True, False), num_factors=(8, 12), side_data_factorization=(True, False)
    ),
    "fine_random_search": dict(reg=search.FINE_PENALTIES, lin_reg=search.FINE_PENALTIES, nmf=(True, False)),
}
_MODELS = {"random_search": 5, "wide_random_search": 20, "fine_random_search": 10}


def _searched(spark, d, name: str) -> DataFrame:
    lists = _SEARCHES[name]
    side = True in lists.get("side_data_factorization", ())
    train, test = _split_with_side(spark, d) if side else _split_typed(spark, d)
    return search.random_search(train, test, num_models=_MODELS[name], parallelism=8, side_columns=_SIDE_TERMS if side else (), **lists)


@query("random_search")
def random_search(spark, d):
    """A search over the short list of penalties: both kinds of model, 50 iterations, 5 models."""
    return _searched(spark, d, "random_search")


@query("wide_random_search")
def wide_random_search(spark, d):
    """The published cluster search: six penalties, side data and non-negative factors drawn, 8 or 12 factors; 20 models."""
    return _searched(spark, d, "wide_random_search")


@query("fine_random_search")
def fine_random_search(spark, d):
    """The published serial search: 50 penalties from 1 to 1e-10, non-negative factors drawn, 8, 12 or 16 factors; 10 models."""
    return _searched(spark, d, "fine_random_search")


def _search_sql(name: str) -> str:
    given = dict(reg=search.PENALTIES, lin_reg=search.PENALTIES, nmf=(False,), max_iterations=(50,), num_factors=(8, 12, 16),
                 side_data_factorization=(False,)) | _SEARCHES[name]
    rows = search.draw_parameters(given, _MODELS[name])
    for r in rows:  # side data come without non-negative factors
        r["nmf"] = r["nmf"] and not r["side_data_factorization"]
    values = ", ".join(
        f"({r['reg']!r}::DOUBLE, {'NULL' if r['nmf'] else repr(r['lin_reg'])}::DOUBLE, {str(r['nmf']).lower()}, {r['max_iterations']}::INTEGER, "
        f"{r['num_factors']}::INTEGER, {str(r['side_data_factorization']).lower()}, true)"
        for r in rows
    )
    return f"SELECT * FROM (VALUES {values}) AS s(reg, lin_reg, nmf, max_iterations, num_factors, side_data_factorization, in_range)"


def _search_check(found: DataFrame) -> DataFrame:
    rates = [F.col(f"{p}_class_rate").between(0, 1) & F.col(f"{q}_rmse").isNotNull() for p, q in (("train", "training"), ("test", "test"))]
    return found.select("reg", "lin_reg", "nmf", "max_iterations", "num_factors", "side_data_factorization", (rates[0] & rates[1]).alias("in_range"))


@query("random_search_check", _search_sql("random_search"))
def random_search_check(spark, d):
    return _search_check(random_search(spark, d))


@query("wide_random_search_check", _search_sql("wide_random_search"))
def wide_random_search_check(spark, d):
    return _search_check(wide_random_search(spark, d))


@query("fine_random_search_check", _search_sql("fine_random_search"))
def fine_random_search_check(spark, d):
    return _search_check(fine_random_search(spark, d))


# --------------------------------------------------------------------------- contract


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: retrain on all ratings and rank the 20 best items of every user. `RATELENS_DATA` names another folder."""
    return als_top20(spark, os.environ.get("RATELENS_DATA", "/root/testdata/sf0.001"))


def _corpus_queries() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the training-data subpackage; none, with a warning, where it or a module that it needs is not installed."""
    try:
        from ratelens.llm import queries as corpus
    except ImportError as missing:
        warnings.warn(f"no training-data queries: {missing}", stacklevel=2)
        return {}, {}
    return corpus.queries(), corpus.oracle_sql()


def queries() -> dict[str, Query]:
    return {**_QUERIES, **_corpus_queries()[0]}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **_corpus_queries()[1]}
