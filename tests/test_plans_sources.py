import json

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ratelens.plans import eda, items as I, ratings as R
from ratelens.schema import REVIEWS
from ratelens.session import ensure_checkpoint_dir
from ratelens.sources import readers, writers
from ratelens.streaming.append import append_stream

BASE = {
    "style": "ale", "description": "d", "site_rating": "3.9", "maker": "Bräu", "region": "north", "abv": "5%",
    "calories": "150", "location": "x", "date": "May", "aroma": 0.5, "appearance": 0.5, "palate": 0.5,
    "overall": 0.5, "combined": 2.5, "review": "good",
}


def document(item, user, taste, **other):
    return {**BASE, "review_id": f"{item}_{user}", "item": item, "user_name": user, "taste": taste, **other}


DOCUMENTS = [
    document("b", "zoe", "0.7"),
    document("b", "ann", "NA"),
    document("a", "ann", "1.0", region="south", abv="NA", calories="NA", site_rating="NA"),
    document("c", "bob", None, abv="9%", calories="200"),
    document("c", "ann", "0.3", abv="9%", calories="200"),
]


@pytest.fixture()
def export(tmp_path):
    path = tmp_path / "reviews.json"
    path.write_text("\n".join(json.dumps(d) for d in DOCUMENTS))
    return str(path)


@pytest.fixture()
def reviews(spark, export):
    return readers.documents(spark, export)


def test_document_scan(spark, export):
    got = readers.documents(spark, export, ["item", "user_name"], F.col("region") == "south")
    assert rows(got) == [("a", "ann")]
    assert rows(readers.distinct_values(readers.documents(spark, export), "item")) == [("a",), ("b",), ("c",)]
    assert readers.documents(spark, export).schema == REVIEWS


def test_item_user_pairs(reviews):
    assert rows(R.item_user_pairs(reviews).drop("review_id")) == [
        ("a", "ann", 0, 0, 10.0),
        ("b", "zoe", 2, 1, 7.0),
        ("c", "ann", 0, 2, 3.0),
    ]


def test_region_keeps_global_ids(reviews):
    got = R.item_user_pairs(reviews, "north").select("item", "item_id", "user_id")
    assert rows(got) == [("b", 1, 2), ("c", 2, 0)]


def test_side_data(reviews):
    got = {r["item"]: r for r in I.item_side_data(reviews).collect()}
    assert len(got) == 3
    # Counted over distinct items: 5% and 9% tie, the lowest text wins; so does 150 over 200.
    assert (got["a"]["abv"], got["a"]["calories"], got["a"]["site_rating"]) == (5.0, 150.0, None)
    assert (got["c"]["abv"], got["c"]["item_id"]) == (9.0, 2)


def test_feature_tables(spark, reviews, tmp_path):
    items = I.item_side_data(reviews)
    terms = spark.createDataFrame([("a", 0.6, 0.8), ("c", 1.0, 0.0)], "item string, hop double, malt double")
    table = I.feature_table(items, terms)
    assert rows(table.select("item", "maker", "hop")) == [("a", "Bru", 0.6), ("c", "Bru", 1.0)]
    I.write_feature_table(items, terms, str(tmp_path / "features"))
    back = readers.csv(spark, str(tmp_path / "features"), table.schema)
    assert rows(back) == rows(table)
    many = spark.createDataFrame([(0,)] * 51 + [(2,)] * 50, "item_id int")
    assert rows(I.frequent_item_features(many, items, terms)) == [(0, 5.0, 150.0, 0.6, 0.8)]
    supported, _, _ = I.modeling_inputs(R.item_user_pairs(reviews), items, terms, min_count=2)
    assert rows(supported.select("user_name").distinct()) == [("ann",)]
    assert I.vector_of(table, "item_id", ["abv", "hop"]).first()["vector"] is not None


def test_wide_catalogue(reviews):
    got = I.wide_catalogue(R.item_user_pairs(reviews), I.item_side_data(reviews))
    assert rows(got.select("item", "count", "abv")) == [("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, 9.0)]


def test_summary(reviews):
    tables = eda.summary(reviews, I.item_side_data(reviews))
    assert rows(tables["style_count"]) == [(1,)]
    assert rows(tables["top_styles"]) == [("ale", 3)]
    assert rows(tables["reviews_per_user"]) == [("ann", 3), ("bob", 1), ("zoe", 1)]
    assert tables["histogram_item"].agg(F.sum("n")).first()[0] == 3


STORED = [("b_zoe", "b", 7.0, "zoe", 5, 1, 0), ("a_ann", "a", 9.0, "ann", 3, 0, 1)]
STORED_SCHEMA = "review_id string, item string, taste double, user_name string, user_id int, item_id int, appdata int"
BATCH = [
    ("zoe", "a", "8", 1),  # known user, not known by the application so far
    ("new", "a", "6", 2),
    ("new", "a", "7", 3),  # second one for the pair
    ("ann", "a", "5", 4),  # stored
    ("New", "b", "5", 5),
    ("ann", "b", "11", 6),
    ("ann", "b", "good", 7),
    ("ann", "nothing", "5", 8),
    (None, "b", "5", 9),
]
BATCH_SCHEMA = "user_name string, item string, taste string, at int"


@pytest.fixture()
def batch(spark):
    return spark.createDataFrame(BATCH, BATCH_SCHEMA)


@pytest.fixture()
def catalogue(spark):
    return spark.createDataFrame([("a", 0), ("b", 1)], "item string, item_id int")


def test_append_ratings(spark, batch, catalogue):
    stored = spark.createDataFrame(STORED, STORED_SCHEMA)
    accepted, rejected = R.append_ratings(stored, batch, catalogue, [F.col("at")])
    assert rows(accepted.select("review_id", "taste", "user_id", "item_id", "appdata")) == [
        ("a_new", 6.0, 7, 0, 1),
        ("a_zoe", 8.0, 5, 0, 1),
        ("b_New", 5.0, 6, 1, 1),
    ]
    assert sorted((r["at"], r["reason"]) for r in rejected.collect()) == [
        (3, "duplicate"),
        (4, "duplicate"),
        (6, "invalid rating"),
        (7, "invalid rating"),
        (8, "unknown item"),
        (9, "no user"),
    ]
    together = stored.unionByName(accepted)
    again, refused = R.append_ratings(together, batch, catalogue, [F.col("at")])
    assert again.count() == 0 and refused.count() == len(BATCH)


def test_id_pairs(spark):
    stored = spark.createDataFrame(STORED, STORED_SCHEMA)
    assert rows(R.user_id_pairs(stored)) == [("ann", 3), ("zoe", 5)]
    assert rows(R.user_id_pairs(stored, app_only=True)) == [("ann", 3)]
    assert rows(R.item_id_pairs(stored)) == [("a", 0), ("b", 1)]
    assert rows(R.ratings_of_user(stored, "zoe")) == [("b", 7.0)]
    assert rows(R.typed_ratings(stored.withColumn("taste", F.lit(7.9)))) == [(3, 0, 7), (5, 1, 7)]


def test_append_stream(spark, batch, catalogue, tmp_path):
    table, rejected, incoming = (str(tmp_path / n) for n in ("table", "rejected", "incoming"))
    spark.createDataFrame(STORED, STORED_SCHEMA).write.parquet(table)
    batch.write.parquet(incoming)
    for _ in range(2):
        arriving = spark.readStream.schema(BATCH_SCHEMA).parquet(incoming)
        append_stream(
            arriving, table, rejected, catalogue, [F.col("at")], str(tmp_path / "progress")
        ).awaitTermination()
        assert spark.read.parquet(table).count() == 5
    assert spark.read.parquet(rejected).count() == 6


def test_append_stream_that_loses_its_progress_adds_nothing(spark, batch, catalogue, tmp_path):
    table, rejected, incoming = (str(tmp_path / n) for n in ("table", "rejected", "incoming"))
    spark.createDataFrame(STORED, STORED_SCHEMA).write.parquet(table)
    batch.write.parquet(incoming)
    seen = []
    for turn in range(2):  # another folder for the progress: batch 0 is run twice
        arriving = spark.readStream.schema(BATCH_SCHEMA).parquet(incoming)
        append_stream(arriving, table, rejected, catalogue, [F.col("at")], str(tmp_path / f"progress{turn}")).awaitTermination()
        seen.append((rows(spark.read.option("mergeSchema", True).parquet(table)), rows(spark.read.parquet(rejected))))
    assert seen[0] == seen[1]


def test_error_rows_spread_over_tasks(spark):
    from ratelens.operators import evaluate

    scored = spark.range(20_000).selectExpr("cast(id % 3 as double) AS actual", "id / 7.0 AS prediction").repartition(4)
    found = evaluate.error_rows(scored.withColumn("prediction", F.col("prediction").cast("double")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [len(p) for p in found.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(n > 0 for n in sizes) >= 4 and found.columns == ["act", "error"]


def test_table_sink_sorts_if_asked(spark, tmp_path):
    writers.create_table(spark.createDataFrame([(2, "b"), (1, "z"), (2, "a")], "u int, i string"), str(tmp_path / "t"), ("u", "i"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).orderBy("u", "i").collect()] == [(1, "z"), (2, "a"), (2, "b")]


def test_table_sink_refuses_to_overwrite(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    writers.create_table(df, path)
    with pytest.raises(AnalysisException):
        writers.create_table(df, path)
    assert readers.table(spark, path, ["id"]).count() == 3
    writers.append_rows(df, path)
    assert readers.table(spark, path).count() == 6
    writers.create_table(df, "named_table")
    assert readers.table(spark, "named_table").count() == 3
    spark.sql("DROP TABLE named_table")


def test_query_binds_values(spark):
    df = spark.createDataFrame(STORED, STORED_SCHEMA)
    got = readers.query(spark, "SELECT item FROM {r} WHERE user_name = :u", {"u": "zoe"}, r=df)
    assert rows(got) == [("b",)]
    assert rows(readers.query(spark, "SELECT item FROM {r} WHERE user_name = :u", {"u": "x' OR '1'='1"}, r=df)) == []


def test_csv_keeps_quotes_and_commas(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice'), (2, None)], "id int, text string")
    writers.write_csv(df, str(tmp_path / "c"))
    assert rows(readers.csv(spark, str(tmp_path / "c"), "id int, text string")) == rows(df)


def test_rating_lines_drop_every_header(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"r{n}.txt").write_text("taste,user_id,item_id\n7,1,2,more\n8,3\n")
    got = readers.rating_lines(spark, str(tmp_path / "*.txt"))
    assert rows(got) == sorted([("7", "1", "2"), ("8", "3", None)] * 2, key=repr)


def test_insert_new_is_idempotent_and_first_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("k1", 2, "late"), ("k1", 1, "early"), ("k2", 1, "x")], "k string, t int, v string")
    order = [F.col("t"), F.col("v")]
    for _ in range(2):
        writers.insert_new(first, path, "k", order)
    writers.insert_new(spark.createDataFrame([("k2", 0, "no"), ("k3", 0, "yes")], first.schema), path, "k", order)
    assert rows(spark.read.parquet(path).select("k", "v")) == [("k1", "early"), ("k2", "x"), ("k3", "yes")]


def test_stored_predictions_are_pruned_by_user(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(300).select(
        F.col("id").cast("int").alias("user_id"), F.lit(1).alias("item_id"), F.lit(5.0).alias("prediction")
    )
    writers.store_predictions(df, path, buckets=16)
    one = readers.user_predictions(spark, path, 77, buckets=16)
    assert rows(one.select("user_id", "prediction")) == [(77, 5.0)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_bucket" in plan


def test_checkpoint_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)
