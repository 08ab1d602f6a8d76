import numpy as np
import pytest
from frames import clashing, frame, odd_rows
from pyspark.sql import functions as F

from ratelens.llm import sharding


def jump(key, shards):
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        to = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("shards", [1, 2, 24, 57, 300])
def test_shards_equal_the_published_loop(spark, shards):
    keys = [0, 1, 2, 42, 256, -1, -7, 2**62, 0xDEAD10CC, *range(1000, 1200)]
    placed = sharding.with_shards(spark.createDataFrame([(k,) for k in keys], "k long"), "k", shards)
    for r in placed.collect():
        assert (r["shard"], r["grown_shard"]) == (jump(r["k"] & (2**64 - 1), shards), jump(r["k"] & (2**64 - 1), shards + 1))


def test_known_values():
    assert [jump(1, 1), jump(42, 57), jump(0xDEAD10CC, 666), jump(256, 1024)] == [0, 43, 361, 520]


def test_appending_a_shard_moves_rows_only_into_it_and_sizes_are_even(spark):
    placed = sharding.with_shards(spark.range(40_000).withColumnRenamed("id", "k"), "k", 24).toPandas()
    moved = placed[placed["shard"] != placed["grown_shard"]]
    assert (moved["grown_shard"] == 24).all()
    assert 0.8 / 25 < len(moved) / len(placed) < 1.2 / 25
    sizes = np.bincount(placed["shard"])
    assert sizes.min() > 0.85 * sizes.mean() and sizes.max() < 1.15 * sizes.mean()


def test_string_keys_missing_keys_and_a_hot_key(spark):
    rows = [("a",)] * 500 + [(None,)] * 3 + [(f"k{i}",) for i in range(200)]
    placed = sharding.shard_rows(spark.createDataFrame(rows, "k string").repartition(4), "k", 7, ["k"]).toPandas()
    assert placed.groupby("k", dropna=False)["shard"].nunique().max() == 1
    for _, own in placed.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert len(placed) == len(rows)


def test_odd_rows_clashing_columns_and_empty_table(spark):
    docs = clashing(frame(spark, odd_rows()))
    placed = sharding.shard_rows(docs, "doc_id", 4, ["doc_id", "text"])
    assert placed.count() == len(odd_rows())
    assert placed.columns.count("shard") == 1 and placed.where("shard IS NULL OR slot IS NULL").count() == 0
    assert sharding.shard_rows(docs.where(F.lit(False)), "doc_id", 4, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.jump(F.lit(0), F.lit(0), 0)
