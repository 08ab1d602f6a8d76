from pyspark.sql import functions as F

from ratelens.sources.keyed_store import KeyedStore


def batch(spark, first, last, value="x"):
    return spark.range(first, last).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(value).alias("v"))


def test_first_wins_and_a_batch_run_twice_adds_nothing(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "store"), "k", parts=8)
    first = spark.createDataFrame([("k1", "late"), ("k1", "early"), (None, "none"), ("", "empty")], "k string, v string")
    assert store.rows(first) is None
    for _ in range(2):
        store.insert(first, [F.col("v")])
    store.insert(spark.createDataFrame([("k1", "no"), (None, "no"), ("k3", "yes")], first.schema), [F.col("v")])
    store.insert(first.where(F.lit(False)), [F.col("v")])
    found = sorted(map(tuple, store.rows(first).collect()), key=repr)
    assert found == sorted([("k1", "early"), (None, "none"), ("", "empty"), ("k3", "yes")], key=repr)


def test_a_batch_reads_only_the_parts_of_keys_that_may_be_stored(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "store"), "k", parts=32, bitmaps=4)
    assert store.insert(batch(spark, 0, 5000), [F.col("v")]) == 0
    # No stored key is ever ruled out, and few others pass.
    assert store.maybe_stored(batch(spark, 0, 5000)).count() == 5000
    assert store.maybe_stored(batch(spark, 5000, 10_000)).count() < 50
    # Three known keys among new ones: at most their parts and those of a few false hits are read.
    mixed = batch(spark, 4997, 5040, "later")
    parts = {r["part"] for r in store.maybe_stored(mixed).collect()}
    assert 0 < len(parts) <= 5
    read = store.stored_keys(mixed, sorted(parts))
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 5 * len(parts) and {f.split("part=")[1].split("/")[0] for f in files} == {str(p) for p in parts}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan and "ReadSchema: struct<k:string>" in plan
    assert store.insert(mixed, [F.col("v")]) == len(parts)
    found = store.rows(mixed)
    assert found.count() == 5040 and found.select("k").distinct().count() == 5040
    assert found.where("v = 'later'").count() == 40
