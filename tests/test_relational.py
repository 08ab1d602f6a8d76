import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.operators import explore, ordinals, relational, split
from ratelens.session import materialize, spread


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key."""
    return spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("key"),
    )


def test_ordinal_is_the_global_position(spark, skewed):
    placed = ordinals.with_ordinal(skewed, "key", "id").orderBy("ordinal").collect()
    expected = sorted(((r["key"], r["id"]) for r in skewed.collect()))
    assert [r["ordinal"] for r in placed] == list(range(3000))
    assert [(r["key"], r["id"]) for r in placed] == expected


def test_ordinal_of_nothing(spark):
    assert ordinals.with_ordinal(spark.range(0), "id").collect() == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(st.text(alphabet="abcXYZ é_", max_size=4), min_size=1, max_size=60))
def test_dense_ids_are_a_bijection(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: r["id"] for r in ordinals.dense_ids(df, "name", "id").collect()}
    assert got == {n: i for i, n in enumerate(sorted(set(names), key=lambda n: n.encode()))}


def test_dense_ids_of_two_columns_are_separate(spark):
    df = spark.createDataFrame([("u2", "i1"), ("u1", "i1"), ("u1", None)], "user string, item string")
    tables = ordinals.dense_id_tables(df, {"user": "user_id", "item": "item_id"})
    assert rows(tables["user"]) == [("u1", 0), ("u2", 1)]
    assert rows(tables["item"]) == [("i1", 0)]


def test_new_ids_count_on(spark):
    known = spark.createDataFrame([("a", 4), ("b", 2)], "user_name string, user_id int")
    batch = spark.createDataFrame([("c",), ("a",), ("A",), ("c",)], "user_name string")
    assert rows(ordinals.new_ids(known, batch, "user_name", "user_id")) == [("A", 5), ("c", 6)]
    nobody = known.where("false")
    assert rows(ordinals.new_ids(nobody, batch, "user_name", "user_id")) == [("A", 0), ("a", 1), ("c", 2)]


def test_group_rank_with_a_hot_group(spark, skewed):
    got = ordinals.group_rank(skewed, ["key"], [F.desc("id")]).collect()
    by_key = {}
    for r in skewed.collect():
        by_key.setdefault(r["key"], []).append(r["id"])
    want = {(k, i): n for k, ids in by_key.items() for n, i in enumerate(sorted(ids, reverse=True), 1)}
    assert {(r["key"], r["id"]): r["rank"] for r in got} == want


def test_top_k_is_cut_before_the_exchange(spark, skewed):
    top = ordinals.top_k_per_group(skewed, ["key"], [F.col("id")], 2)
    assert rows(top.where("key = 'hot'").select("id", "rank")) == [(0, 1), (3, 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), ("a", 1, "w")], "k string, t int, v string")
    assert rows(relational.first_per_key(df, ["k"], [F.col("t"), F.col("v")])) == [("a", 1, "w"), ("b", 5, "z")]


def test_support_bounds(spark):
    df = spark.createDataFrame([("three",)] * 3 + [("four",)] * 4, "user_name string")
    assert rows(relational.min_support_filter(df, "user_name", 4).distinct()) == [("four",)]
    many = spark.createDataFrame([("fifty",)] * 50 + [("more",)] * 51, "item string")
    assert rows(relational.frequent_keys(many, "item", 50)) == [("more",)]


def test_membership_and_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id int, v string")
    ids = spark.createDataFrame([(1, "one"), (3, "three")], "item_id int, item string")
    assert rows(relational.only_listed(df, ids, "item_id")) == [(1, "a"), (3, "c")]
    assert rows(relational.only_unseen(df, ids, "item_id")) == [(2, "b")]
    assert rows(relational.attach_names(df, ids, "item_id").select("item", "v")) == [("one", "a"), ("three", "c")]
    assert rows(relational.rows_of(df, "v", "b' OR '1'='1")) == []


def test_mode_takes_the_lowest_text_on_a_tie(spark):
    df = spark.createDataFrame([("9%",), ("10%",), ("NA",), ("NA",), ("NA",), (None,)], "abv string")
    assert rows(relational.most_common(df, "abv")) == [("10%",)]
    assert rows(relational.top_values(df.where("abv is not null"), "abv", 2)) == [("10%", 1), ("NA", 3)]


def test_complete_cases_and_distinct(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    assert rows(relational.complete_cases(df)) == [(2, "x"), (2, "x")]
    assert rows(relational.complete_cases(df, "a")) == rows(df)
    assert relational.distinct_rows(df).count() == 2


def test_search_ignores_case_and_stops_at_the_limit(spark):
    df = spark.range(40).select(F.format_string("Pale %02d", "id").alias("item"))
    found = [r["item"] for r in relational.search_names(df, "item", "pALE").collect()]
    assert found == [f"Pale {i:02d}" for i in range(15)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (199,), (200,), (201,), (-1,)], "n int")
    got = {r["bin"]: r["n"] for r in explore.histogram(df, "n").collect()}
    assert len(got) == 200
    assert {b: n for b, n in got.items() if n} == {1: 2, 2: 1, 200: 2}


def test_distinct_count_skips_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "style string")
    assert rows(explore.distinct_count(df, "style")) == [(1,)]


def test_hash_split_is_complete_and_stable(spark, skewed):
    parts = split.hash_split(skewed, ["id"], 0.2)
    train, test = split.train_and_test(parts)
    assert train.count() + test.count() == 3000
    assert train.join(test, "id", "left_semi").count() == 0
    assert 450 < test.count() < 750
    again = split.hash_split(skewed.repartition(7), ["id"], 0.2)
    assert rows(parts) == rows(again)
    assert rows(split.hash_split(skewed, ["id"], 0.2, seed="s").select("id", "split")) != rows(parts.select("id", "split"))


def test_split_by_user_respects_the_cap(spark):
    df = spark.range(2000).select(
        F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("user_name"),
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("item"),
    )
    got = split.split_by_user(df, max_users=10)
    assert got.count() == 2000
    assert got.where("split = 'test'").select("user_name").distinct().count() <= 10
    assert got.where("split = 'test'").count() > 0


def test_materialize_keeps_rows_and_schema(spark, skewed):
    kept = materialize(skewed)
    assert kept.schema.simpleString() == skewed.schema.simpleString()
    assert kept.count() == 3000


def test_spread_leaves_large_scans_alone(spark):
    wide = spark.range(100, numPartitions=64)
    assert spread(wide) is wide
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def _skew_split(spark, build):
    """Run with every join shuffled and a low skew bound; True if the planner split a hot partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = build()
        n = len(df.collect())
        return n, "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_split_in_joins(spark):
    facts = materialize(
        spark.range(0, 60000, numPartitions=16).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 20011).cast("string"))).alias("key"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
    )
    n, split_up = _skew_split(spark, lambda: relational.min_support_filter(facts, "key", 2))
    rare = facts.groupBy("key").count().where("count < 2").count()
    assert (n, split_up) == (60000 - rare, True)
    ids = ordinals.dense_ids(facts, "key", "key_id")
    assert _skew_split(spark, lambda: facts.join(ids, "key", "left")) == (60000, True)
    from ratelens.operators.pages import with_placeholders

    items = materialize(facts.select("key").distinct().union(spark.createDataFrame([("alone",)], "key string")))
    assert _skew_split(spark, lambda: with_placeholders(items, facts, "key")) == (60001, True)
