"""The rating table by ids against the plain path by names, on rows of its own."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ratelens.operators.split import hash_split
from ratelens.plans import items as I
from ratelens.plans import ratings as R
from ratelens.plans import recommendations as RC
from ratelens.plans import review_tables as RT


def write(spark, folder, customers, parts, lines):
    """Tables of order lines (order, line, part, quantity, day); order n is of customer n % 100."""
    tables = {
        "customer": (customers, "c_custkey long, c_name string"),
        "part": ([(k, n, f"type {k % 3}", f"maker {k % 2}", k % 50, 10.5 + k) for k, n in parts],
                 "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"),
        "nation": ([(k, f"nation {k}") for k in range(25)], "n_nationkey long, n_name string"),
        "orders": ([(o, o % 100) for o in sorted({r[0] for r in lines})], "o_orderkey long, o_custkey long"),
        "lineitem": ([(o, n, p, q, dt.datetime(1995, 1, day)) for o, n, p, q, day in lines],
                     "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


PARTS = [(1, "blue"), (2, "red"), (3, "green"), (4, "never reviewed"), (13, "grey")]
LINES = [(o * 100 + c, n, (o + c + n) % 3 + 1, float((o * 13 + c * 5 + n) % 51), o + n) for o in range(1, 9) for c in (1, 2, 3) for n in (1, 2)]
LINES += [(101, 3, 2, 7.0, 3), (101, 3, 2, 7.0, 3)]  # a line that comes twice
CLEAR = [(1, "ann"), (2, "bob"), (3, "cyd"), (4, "absent")]
UNCLEAR = [(1, "ann"), (2, None), (2, "b_ob"), (3, "blue #1_ann"), (4, "absent"), (1, "zoe")]


@pytest.mark.parametrize(("customers", "parts"), [(CLEAR, PARTS), (CLEAR[:3], PARTS[:3]), (UNCLEAR, [*PARTS, (3, None), (2, "red"), (2, "rose")])])
def test_same_rows_as_by_names(spark, tmp_path, customers, parts):
    folder = str(tmp_path)
    write(spark, folder, customers, parts, LINES)
    docs = RT.stored_reviews(spark, folder)
    users, items = R.dimensions(RT.reviews(spark, folder))
    plain = hash_split(R.with_ids(R.rated_reviews(docs, keep=("appdata",)), users, items), ["review_id"])
    rated, got_users, got_items, sides = RT.id_ratings(spark, folder, sides=True)
    columns = ["user_id", "item_id", "taste", "appdata", "split"]
    assert rated.columns == columns
    assert sorted(map(repr, rated.collect())) == sorted(map(repr, plain.select(*columns).collect()))
    assert sorted(map(tuple, got_users.collect())) == sorted(map(tuple, users.collect()))
    assert sorted(map(tuple, got_items.collect())) == sorted(map(tuple, items.collect()))
    if customers is not UNCLEAR:
        assert sorted(map(repr, I.raw_side_data(sides).collect())) == sorted(map(repr, I.raw_side_data(docs).collect()))
        return
    named = ["review_id", "item", "user_name", "user_id", "item_id", "taste", "appdata"]
    assert sorted(map(repr, RT.ratings(spark, folder).select(*named).collect())) == sorted(map(repr, plain.select(*named).collect()))


def test_no_name_moves_with_the_ratings(spark, tmp_path, monkeypatch):
    """The shuffle that the first reviews are found by, and the table that a fit reads, carry numbers only."""
    write(spark, str(tmp_path), CLEAR, PARTS, LINES)
    grouped = []
    monkeypatch.setattr(RT, "top_k_per_group", lambda df, *a, **k: grouped.append(df) or E.recommend.top_k_per_group(df, *a, **k))
    train, _ = E._split_typed(spark, str(tmp_path))
    assert {c for c, kind in grouped[0].dtypes if kind == "string"} == {"taste"}
    assert {"review_id", "item", "user_name"}.isdisjoint(train.columns)


def test_reviews_of_one_id_are_not_moved_once_more(spark, tmp_path, monkeypatch):
    """They meet by part key, by which they lie after the join to large parts; before, a digest was shuffled."""
    write(spark, str(tmp_path), CLEAR, PARTS, LINES)
    firsts, plain = [], RT._regions
    monkeypatch.setattr(RT, "top_k_per_group", lambda *a, **k: firsts.append(E.recommend.top_k_per_group(*a, **k)) or firsts[-1])
    monkeypatch.setattr(RT, "_regions", lambda *a: F.broadcast(plain(*a)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        RT.id_ratings(spark, str(tmp_path))
        plan = firsts[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = set(re.findall(r"hashpartitioning\((\w+)#", plan))
    assert "p_partkey" in moved and moved <= {"l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "l_partkey", "p_partkey"}


def test_rank_with_given_names(spark):
    ratings = spark.createDataFrame([(u, i, float(5 + (u + i) % 3)) for u in range(4) for i in range(5)], "user_id int, item_id int, taste double")
    users = spark.createDataFrame([(f"u{k}", k) for k in range(4)], "user_name string, user_id int")
    items = spark.createDataFrame([(f"i{k}", k) for k in range(5)], "item string, item_id int")
    got = RC.retrain_and_rank(ratings, min_count=1, k=2, users=users, items=items).collect()
    assert sorted((r["user_name"], r["rank"]) for r in got) == [(f"u{u}", rank) for u in range(4) for rank in (1, 2)]
    assert {r["item"] for r in got} <= {f"i{k}" for k in range(5)}


def test_refreshed_ratings_keep_their_time_and_carry_no_names(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, CLEAR, PARTS, LINES)
    docs = RT.stored_reviews(spark, folder)
    users, items = R.dimensions(RT.reviews(spark, folder))
    plain = R.with_ids(R.rated_reviews(docs, keep=("review_ts",)), users, items)
    rated, old, new, got_users, got_items = E._refreshed(spark, folder)
    assert not {"user_name", "item", "review_id"} & {*rated.columns, *old.columns, *new.columns}
    columns = ["user_id", "item_id", "taste", "review_ts"]
    assert sorted(map(repr, rated.select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))
    assert sorted(map(tuple, got_users.collect())) == sorted(map(tuple, users.collect()))
    assert sorted(map(tuple, got_items.collect())) == sorted(map(tuple, items.collect()))


def test_scored_pairs_are_those_by_names_from_a_table_of_numbers(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    write(spark, folder, CLEAR, PARTS, LINES)
    docs = RT.stored_reviews(spark, folder)
    users, items = R.dimensions(RT.reviews(spark, folder))
    plain = R.with_ids(RT.scored(RT.labelled(docs)), users, items)
    monkeypatch.setattr(RT, "store", None)  # the store bears names and is not asked for
    found = {(r["user_id"], r["item_id"]): (r["taste"], r["prediction"]) for r in E.scored_pairs(spark, folder).collect()}
    expected = {(r["user_id"], r["item_id"]): (r["actual"], round(r["prediction"], 6)) for r in plain.collect()}
    assert found == expected
