from conftest import rows

from ratelens.operators import sketches


def test_batches_add_up_and_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "counts")
    table = spark.range(30_000).selectExpr("id % 3 AS g", "id % 5000 AS v", "id % 4 AS batch")
    for batch in (0, 1, 2, 3, 2):
        sketches.write_batch(sketches.batch_counts(table.where(f"batch = {batch}"), "g", "v"), path, batch)
    found = {r["g"]: r for r in sketches.merged_counts(spark, path, "g").collect()}
    exact = {r["g"]: r["n"] for r in table.selectExpr("g", "v").distinct().groupBy("g").count().withColumnRenamed("count", "n").collect()}
    assert {g: r["n"] for g, r in found.items()} == {0: 10_000, 1: 10_000, 2: 10_000}
    assert all(abs(found[g]["about"] - exact[g]) <= 0.06 * exact[g] for g in exact)


def test_nulls_are_rows_and_no_values(spark, tmp_path):
    path = str(tmp_path / "counts")
    odd = spark.createDataFrame([("a", 1), ("a", None), ("b", None), (None, 2)], "g string, v int")
    sketches.write_batch(sketches.batch_counts(odd, "g", "v"), path, 1)
    assert rows(sketches.merged_counts(spark, path, "g")) == sorted([("a", 2, 1), ("b", 1, 0), (None, 1, 1)], key=repr)
