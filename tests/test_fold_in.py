import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.operators import fold_in, models, recommend


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 7))
def test_nonnegative_solutions_meet_the_optimality_conditions(seed, rank):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(5, 20, rank))
    a = v.transpose(0, 2, 1) @ v + 0.1 * np.eye(rank)
    b = np.einsum("mni,mn->mi", v, rng.normal(size=(5, 20)))
    x = fold_in.solve_ridge(a, b, True)
    slope = np.einsum("mij,mj->mi", a, x) - b
    assert (x >= 0).all() and (slope > -1e-5).all() and (np.abs(slope * x) < 1e-5).all()
    np.testing.assert_allclose(np.einsum("mij,mj->mi", a, fold_in.solve_ridge(a, b, False)), b, atol=1e-8)


def test_fold_in(spark):
    rng = np.random.default_rng(2)
    u, v = rng.uniform(0.5, 2, (40, 2)), rng.uniform(0.5, 2, (30, 2))
    rows = [(i, j, float(u[i] @ v[j])) for i in range(40) for j in range(30) if rng.random() < 0.5]
    table = spark.createDataFrame(rows, "user_id int, item_id int, taste double").cache()
    model = models.fit_als(table.where("user_id < 35"), rank=3, reg=0.02, iterations=8)
    touched = spark.createDataFrame([(36,), (3,), (77,)], "user_id int")
    odd = spark.createDataFrame([(36, 999, 1.0), (77, 999, 1.0), (36, 1, None), (None, 1, 2.0)], "user_id int, item_id int, taste double")
    folded = fold_in.fold_in_users(model, table.unionByName(odd), 0.02, touched)
    old = {r["id"]: list(r["features"]) for r in model.userFactors.collect()}
    new = {r["id"]: list(r["features"]) for r in folded.userFactors.collect()}
    assert new.keys() == old.keys() | {36}  # user 77 has rated no known item
    assert all(new[k] == old[k] for k in old if k != 3)
    np.testing.assert_allclose(new[3], old[3], atol=1e-4)  # nothing new: the fit's own last half-step
    error = folded.predict(table.where("user_id = 36")).agg(F.max(F.abs(F.col("prediction") - F.col("taste")))).first()[0]
    assert error < 0.5
    best = recommend.recommend_top_k(folded, touched, 5)
    assert best.where("user_id = 36").count() == 5 and best.where("user_id = 77").count() == 0
    assert fold_in.fold_in_users(model, table.where("false"), 0.02).userFactors.count() == 35
