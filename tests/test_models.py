import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ratelens.operators import evaluate, models, recommend, search, similarity
from ratelens.operators.split import hash_split, train_and_test
from ratelens.plans import recommendations


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings from a rank-2 model of 60 users and 40 items, about half of the pairs."""
    source = np.random.default_rng(3)
    u, v = source.uniform(0.5, 2.0, (60, 2)), source.uniform(0.5, 2.0, (40, 2))
    truth = u @ v.T
    seen = [(i, j, float(truth[i, j])) for i in range(60) for j in range(40) if source.random() < 0.5]
    return spark.createDataFrame(seen, "user_id int, item_id int, taste double").cache()


@pytest.fixture(scope="module")
def parts(planted):
    return train_and_test(hash_split(planted, ["user_id", "item_id"]))


@pytest.fixture(scope="module")
def model(parts):
    return models.fit_als(parts[0], rank=4, reg=0.01, iterations=10)


def _rmse(predictions):
    return evaluate.rmse(predictions.withColumn("actual", F.col("taste"))).first()["rmse"]


def _baseline(parts):
    mean = parts[0].agg(F.avg("taste")).first()[0]
    return _rmse(parts[1].withColumn("prediction", F.lit(mean)))


def test_als_beats_the_mean_and_stays_nonnegative(parts, model):
    assert _rmse(models.predict_pairs(model, parts[1])) < 0.3 * _baseline(parts)
    lowest = model.itemFactors.select(F.min(F.array_min("features"))).first()[0]
    assert lowest >= 0


def test_unknown_ids_get_no_prediction(spark, model):
    pairs = spark.createDataFrame([(0, 0), (999, 0), (0, 999)], "user_id int, item_id int")
    assert models.predict_pairs(model, pairs).count() == 1


def test_factorization_beats_the_mean(parts):
    fitted = models.fit_factorization(parts[0], num_factors=4, reg=1e-4, lin_reg=1e-5, iterations=10)
    predicted = fitted.predict(parts[1])
    assert _rmse(predicted) < 0.5 * _baseline(parts)
    assert "user_term" not in predicted.columns


def test_side_terms_beat_the_mean(spark):
    source = np.random.default_rng(8)
    side = {i: (float(source.uniform(100, 2000)), "abc"[i % 3]) for i in range(50)}
    seen = [
        (u, i, 5 + 0.002 * side[i][0] + {"a": 0.0, "b": 1.5, "c": -1.5}[side[i][1]] + float(source.normal(0, 0.3)), *side[i])
        for u in range(60) for i in range(50) if source.random() < 0.4
    ]
    table = spark.createDataFrame(seen, "user_id int, item_id int, taste double, calories double, style string")
    split_up = train_and_test(hash_split(table, ["user_id", "item_id"]))
    fitted = models.fit_factorization(split_up[0], num_factors=2, reg=1e-3, iterations=5, side_columns=("calories", "style"))
    predicted = fitted.predict(split_up[1])
    assert _rmse(predicted) < 0.4 * _baseline(split_up)
    assert set(predicted.columns) == set(split_up[1].columns) | {"prediction"}
    # An unseen value and a missing number count as the mean; the item itself must be known.
    odd = split_up[1].limit(1).withColumns({"style": F.lit("new"), "calories": F.lit(None).cast("double")})
    assert fitted.predict(odd).first()["prediction"] is not None
    assert {t.column for t in fitted.side_terms} == {"calories", "style"}


def test_strong_penalty_leaves_the_mean(parts):
    fitted = models.fit_factorization(parts[0], num_factors=3, reg=10.0, lin_reg=100.0, iterations=3)
    assert _rmse(fitted.predict(parts[1])) == pytest.approx(_baseline(parts), rel=0.02)


def test_user_optimality(parts, model):
    found = models.user_optimality(model, parts[0], 0.01).toPandas()
    assert found["optimal"].all() and len(found) == parts[0].select("user_id").distinct().count()
    assert not models.user_optimality(model, parts[0], 3.0).toPandas()["optimal"].any()


def test_ranking_model(parts):
    fitted = models.fit_ranking_model(parts[0], rank=4, iterations=5)
    assert recommend.recommend_top_k(fitted, k=3).groupBy("user_id").count().where("count <> 3").count() == 0


def test_tied_scores_stay_small():
    import tracemalloc

    users, items = np.zeros((3000, 6), "float32"), np.random.default_rng(1).random((20_000, 6)).astype("float32")
    tracemalloc.start()
    best = recommend._best_of(np.arange(3000), users, np.arange(20_000)[::-1].copy(), items, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(best) == 60_000 and best.groupby("user_id")["item_id"].agg(sorted).map(lambda x: x == list(range(20))).all()
    assert peak < 400 << 20


def _brute_force(model, k, allowed=None):
    users = {r["id"]: np.array(r["features"], "float32") for r in model.userFactors.collect()}
    items = {r["id"]: np.array(r["features"], "float32") for r in model.itemFactors.collect()}
    out = {}
    for u, x in users.items():
        scores = sorted(((-float(x @ y), i) for i, y in items.items() if allowed is None or i in allowed))
        out[u] = [i for _, i in scores[:k]]
    return out


def _lists(best):
    out = {}
    for r in best.orderBy("user_id", "rank").collect():
        out.setdefault(r["user_id"], []).append(r["item_id"])
    return out


def test_top_k_against_brute_force_on_both_routes(spark, model):
    want = _brute_force(model, 5)
    assert _lists(recommend.recommend_top_k(model, k=5)) == want
    assert _lists(recommend.recommend_top_k(model, k=5, item_matrix_bytes=200)) == want
    allowed = spark.createDataFrame([(i,) for i in (1, 5, 9)], "item_id int")
    few = recommend.recommend_top_k(model, k=5, allowed=allowed)
    assert _lists(few) == _brute_force(model, 5, {1, 5, 9})
    assert few.agg(F.max("rank")).first()[0] == 3
    assert recommend.recommend_top_k(model, k=5, allowed=allowed.where("false")).count() == 0


def test_best_of_with_ties_and_early_stop():
    source = np.random.default_rng(1)
    users = source.normal(size=(7, 3)).astype("float32")
    base = source.normal(size=(50, 3)).astype("float32")
    base[40:] *= 0.001
    items = np.concatenate([base] * 200)  # equal items tie, more than one step
    got = recommend._best_of(np.arange(7), users, np.arange(len(items)), items, 9)
    for u in range(7):
        scores = items @ users[u]
        exact = np.sort(scores)[::-1][:9]
        mine = got[got.user_id == u]
        assert len(mine) == 9
        np.testing.assert_allclose(np.sort(mine.prediction)[::-1], exact, rtol=1e-5, atol=1e-6)


def test_users_leave_the_visit_one_by_one(monkeypatch):
    """A user whose list never closes does not keep the others of its slice: before, all rows were partitioned at each step."""
    source = np.random.default_rng(2)
    items = source.random((40_000, 6)).astype("float32") * np.linspace(2, 0.01, 40_000, dtype="float32")[:, None]
    users = source.random((1000, 6)).astype("float32")
    users[7] *= -1  # all scores are negative, so the best items come last
    rows, plain = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *p, **k: rows.append(len(a)) or plain(a, *p, **k))
    got = recommend._best_of(np.arange(1000), users, np.arange(40_000), items, 5)
    assert len(rows) == 10 and rows[0] == 1000 and sum(rows[2:]) < 500
    for u in (0, 7, 999):
        want = np.lexsort((np.arange(40_000), -(items @ users[u])))[:5]
        assert got[got.user_id == u].item_id.tolist() == want.tolist()


def test_large_catalogue_meets_few_chunks(spark, model, monkeypatch):
    """Every chunk of users is sent all items: the items of 500,000 users are sent once, not 25 times."""
    sent = []
    plain = recommend.F.sequence
    monkeypatch.setattr(recommend.F, "sequence", lambda a, b: sent.append(b) or plain(a, b))
    monkeypatch.setattr(type(model.userFactors), "count", lambda df, plain=type(model.userFactors).count: 500_000 if "user_id" in df.columns else plain(df))
    recommend.recommend_top_k(model, k=5, item_matrix_bytes=200)
    assert recommend.math.ceil(500_000 / recommend._USER_CHUNK) == 1 and len(sent) == 2


def test_rank_items_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 9, 5.0), (1, 2, 5.0), (1, 3, 4.0), (2, 1, 1.0)], "user_id int, item_id int, prediction double")
    assert rows(recommend.rank_items(df, 2)) == [(1, 2, 5.0, 1), (1, 9, 5.0, 2), (2, 1, 1.0, 1)]


def test_look_up(spark):
    stored = spark.createDataFrame([(1, 1, 7.5)], "user_id int, item_id int, prediction double")
    asked = spark.createDataFrame([(1, 1), (1, 2)], "user_id int, item_id int")
    assert rows(recommend.look_up(stored, asked)) == [(1, 1, 7.5), (1, 2, None)]
    assert rows(recommend.look_up(stored, asked, missing_as_zero=True)) == [(1, 1, 7.5), (1, 2, 0.0)]


def test_score_catalogue(model, parts):
    items = parts[0].select("item_id").distinct()
    got = recommend.score_catalogue(model, items, [0, 1])
    assert got.count() == 2 * items.count()


def test_latent_ranks_are_permutations(model):
    got = recommend.latent_ranks(model.itemFactors, 4, key="id").collect()
    for i in range(1, 5):
        assert sorted(r[f"l{i}_rank"] for r in got) == list(range(1, len(got) + 1))
    best = max(model.itemFactors.collect(), key=lambda r: (r["features"][1], -r["id"]))["id"]
    assert [r["id"] for r in got if r["l2_rank"] == 1] == [best]


def test_retrain_stores_and_ranks(spark, planted, tmp_path):
    named = planted.withColumns(
        {"user_name": F.concat(F.lit("u"), "user_id"), "item": F.concat(F.lit("i"), "item_id"), "taste": F.col("taste")}
    )
    path = str(tmp_path / "scores")
    got = recommendations.retrain_and_rank(named, min_count=1, k=3, store=path)
    assert got.count() == 60 * 3
    from ratelens.sources.readers import user_predictions

    assert user_predictions(spark, path, 5).count() == 3
    some = spark.createDataFrame([("u1",), ("u2",), ("nobody",)], "user_name string")
    ranked = recommendations.retrain_and_rank(named, min_count=1, k=3, only_users=some)
    assert rows(ranked.select("user_name").distinct()) == [("u1",), ("u2",)]


SCORED = [(6.0, 6.5), (6.0, 7.0), (9.0, 4.0), (5.0, 5.0), (5.0, 5.5), (2.0, 4.9), (5.5, 5.9)]


def test_match_rules(spark):
    df = spark.createDataFrame(SCORED, "actual double, prediction double")
    biased = [r[0] for r in df.select(evaluate.is_match("biased")).collect()]
    assert biased == [True, False, False, True, False, True, True]
    both = [r[0] for r in df.select(evaluate.is_match("both_low")).collect()]
    assert both == [True, False, False, True, True, True, True]
    with pytest.raises(ValueError):
        evaluate.is_match("other")


def test_quality_and_errors(spark):
    df = spark.createDataFrame(SCORED, "actual double, prediction double")
    got = evaluate.quality(df, "biased").first()
    errors = [p - a for a, p in SCORED]
    assert (got["n"], got["matches"]) == (7, 4)
    assert got["class_rate"] == pytest.approx(4 / 7)
    assert got["rmse"] == pytest.approx(math.sqrt(sum(e * e for e in errors) / 7))
    assert [r["act"] for r in evaluate.error_rows(df).collect()] == sorted(a for a, _ in SCORED)
    five = evaluate.error_breakdown(df).where("act = 5").first()
    assert (five["n"], five["mean_error"]) == (2, pytest.approx(0.25))
    assert evaluate.absolute_errors(df).agg(F.min("error")).first()[0] == 0.0


def test_best_point_is_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "point_no int, class_rate double")
    assert rows(evaluate.best_by_class_rate(df)) == [(1, 0.7)]


def test_score_pairs(spark):
    truth = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0)], "user_id int, item_id int, actual double")
    guess = spark.createDataFrame([(1, 1, 4.0)], "user_id int, item_id int, prediction double")
    assert rows(evaluate.score_pairs(truth, guess)) == [(1, 1, 5.0, 4.0)]


def test_sweep(parts):
    got = search.sweep(*parts, ranks=(2, 3), regs=(0.01, 0.1), iterations=4, parallelism=2)
    assert [(r["rank"], r["reg"]) for r in got.orderBy("point_no").collect()] == [(2, 0.01), (2, 0.1), (3, 0.01), (3, 0.1)]
    assert got.where("rmse is null or class_rate not between 0 and 1").count() == 0
    assert len(search.GRID_RANKS) * len(search.GRID_REGS) == 15


def test_random_search(parts):
    got = search.random_search(*parts, nmf=[True, False], max_iterations=[3], num_factors=[2, 3], num_models=4)
    assert got.count() == 4
    assert got.where("nmf and lin_reg is not null").count() == 0
    assert search.draw_parameters({"a": [1, 2, 3]}, 5, seed=1) == search.draw_parameters({"a": [1, 2, 3]}, 5, seed=1)


def _pairs(vectors, limit):
    ids = sorted(vectors)
    kept, star = {}, set()
    for i in ids:
        key = tuple(vectors[i])
        if not any(key):
            continue
        if key in kept:
            star.add((kept[key], i))
        else:
            kept[key] = i
    out = dict.fromkeys(star, 0.0)
    reps = sorted(kept.values())
    for n, a in enumerate(reps):
        for b in reps[n + 1 :]:
            x, y = np.array(vectors[a]), np.array(vectors[b])
            d = 1 - x @ y / (np.linalg.norm(x) * np.linalg.norm(y))
            if d <= limit:
                out[(a, b)] = d
    return out


@pytest.mark.parametrize("limit, block_rows", [(0.02, 20), (0.2, 16), (2.0, 40), (0.1, 2048)])
def test_similar_items_against_brute_force(spark, limit, block_rows):
    source = np.random.default_rng(5)
    centres = source.normal(size=(6, 5))
    vectors = {i: [float(x) for x in centres[i % 6] + 0.2 * source.normal(size=5)] for i in range(150)}
    for i in range(150, 200):  # a group of copies
        vectors[i] = vectors[7]
    vectors[200] = [0.0] * 5
    df = spark.createDataFrame(list(vectors.items()), "item_id long, vector array<double>")
    got = similarity.similar_items(df, "item_id", "vector", limit, block_rows=block_rows).collect()
    found = {(r["item_id1"], r["item_id2"]): r["distance"] for r in got}
    want = _pairs(vectors, limit)
    assert len(got) == len(found)
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], rel=1e-4, abs=1e-9) for k in want)


def test_similar_items_of_nothing(spark):
    df = spark.createDataFrame([], "item_id long, vector array<double>")
    assert similarity.similar_items(df, "item_id", "vector", 0.1).count() == 0


def test_random_search_with_side_data(parts):
    train, test = (p.withColumn("style", (F.col("item_id") % 3).cast("string")) for p in parts)
    got = search.random_search(
        train, test, max_iterations=[2], num_factors=[2], side_data_factorization=[True], side_columns=["style"], num_models=1
    ).first()
    assert got["side_data_factorization"] and got["lin_reg"] is not None and got["test_rmse"] is not None


def test_blocks_follow_the_ratings_and_not_the_shuffle_partitions(spark, monkeypatch):
    asked = []
    own = models.ALS.setNumBlocks
    monkeypatch.setattr(models.ALS, "setNumBlocks", lambda self, n: (asked.append(n), own(self, n))[1])
    ratings = spark.createDataFrame([(u, i, float((u * i) % 10)) for u in range(20) for i in range(10)], "user_id int, item_id int, taste double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        model = models.fit_als(ratings, rank=2, iterations=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert asked == [models.LEAST_BLOCKS]
    assert models.predict_pairs(model, ratings).count() == 200
    assert models.als_blocks(100 * models.BLOCK_RATINGS) == 100


def test_similar_items_sends_an_item_to_no_cell_after_its_own(spark, monkeypatch):
    source = np.random.default_rng(4)
    vectors = source.normal(size=(240, 6))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    met = []
    compare = similarity._compare

    def watched(max_distance):
        inner = compare(max_distance)

        def counted(key, home, near):
            assert (near["home"] >= key[0]).all()
            return inner(key, home, near)

        return counted

    monkeypatch.setattr(similarity, "_compare", watched)
    for bound in (0.4, 0.9):
        found = {(r[0], r[1]) for r in similarity.similar_items(frame, "id", "v", bound, block_rows=20).collect()}
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        distance = 1 - unit @ unit.T
        met.append(len(found))
        assert found == {(i, j) for i in range(240) for j in range(i + 1, 240) if distance[i, j] <= bound}
    assert met[0] > 0
