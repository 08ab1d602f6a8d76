import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelens.operators import sparse_similarity as sparse


def vectors(seed=6, n=160):
    """Vectors of a few of 300 terms around 25 centres; the terms 0 to 2 are in nearly all of them."""
    rng = np.random.default_rng(seed)
    centres = [rng.choice(np.arange(3, 300), 7, replace=False) for _ in range(25)]
    out = {}
    for i in range(n):
        own = {int(t): float(rng.integers(1, 4)) for t in centres[i % 25] if rng.random() < 0.9}
        own |= {int(t): float(rng.integers(1, 3)) for t in range(3) if rng.random() < 0.9}
        out[i] = own or {0: 1.0}
    for i in range(n, n + 30):  # a group of copies
        out[i] = dict(out[4])
    return out


def plain(given, limit):
    kept, found = {}, {}
    for i in sorted(given):
        key = tuple(sorted(given[i].items()))
        if key in kept:
            found[kept[key], i] = 0.0
        kept.setdefault(key, i)
    ids = sorted(kept.values())
    norm = {i: np.sqrt(sum(w * w for w in given[i].values())) for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            d = 1 - sum(w * given[b].get(t, 0.0) for t, w in given[a].items()) / (norm[a] * norm[b])
            if d <= limit:
                found[a, b] = d
    return found


def table(spark, given):
    rows = [(i, f"t{t}", w) for i, v in given.items() for t, w in v.items()]
    return spark.createDataFrame(rows, "item long, term string, weight double").repartition(3)


@pytest.mark.parametrize("limit, block_rows", [(0.05, 2048), (0.3, 2048), (0.3, 16), (0.8, 50)])
def test_equals_brute_force(spark, limit, block_rows):
    given = vectors()
    got = sparse.similar_sparse_items(table(spark, given), "item", "term", "weight", limit, block_rows=block_rows).collect()
    found, want = {(r["item_id1"], r["item_id2"]): r["distance"] for r in got}, plain(given, limit)
    assert len(got) == len(found) and found.keys() == want.keys() and len(found) > 30
    assert all(found[k] == pytest.approx(want[k], rel=1e-4, abs=1e-9) for k in want)


def test_few_candidates_although_most_vectors_share_terms(spark):
    given = {i: v for i, v in vectors().items() if i < 160}
    rows = [(i, [(f"t{t}", w / float(np.sqrt(sum(x * x for x in v.values())))) for t, w in sorted(v.items())]) for i, v in given.items()]
    units = spark.createDataFrame(rows, "id long, vector array<struct<term:string,weight:double>>")
    whole = sparse.candidate_pairs(units, 0.9)
    assert whole.count() < 0.1 * (160 * 159 // 2)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sparse.candidate_pairs(units, 0.9, block_rows=7).collect()))


def test_missing_values_zeros_and_nothing(spark):
    odd = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", 0.0), (3, None, 1.0), (4, "a", None), (None, "a", 1.0)], "item long, term string, weight double")
    got = sparse.similar_sparse_items(odd, "item", "term", "weight", 0.1).collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.0)]
    assert sparse.similar_sparse_items(odd.where(F.lit(False)), "item", "term", "weight", 0.1).count() == 0
    with pytest.raises(ValueError):
        sparse.similar_sparse_items(odd, "item", "term", "weight", 1.0)
