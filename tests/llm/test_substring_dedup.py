import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from frames import clashing, frame, odd_rows, row, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.llm import queries, substring_dedup


def plain(rows, words=50):
    """Windows as tuples of words, the smallest document of each, and what is left of every row."""
    split = [[] if r[1] is None else r[1].encode().split() for r in rows]
    first = {}
    for r, own in zip(rows, split):
        if r[0] is not None:
            for i in range(len(own) - words + 1):
                window = tuple(own[i : i + words])
                first[window] = min(first.get(window, r[0]), r[0])
    out = []
    for r, own in zip(rows, split):
        gone = set()
        for i in range(len(own) - words + 1 if r[0] is not None else 0):
            if first[tuple(own[i : i + words])] < r[0]:
                gone |= set(range(i, i + words))
        out.append((r[0], len(own), len(gone), b" ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=repr)


def digest(rows):
    return sorted(((key, n, k, hashlib.sha256(text).hexdigest()) for key, n, k, text in rows), key=repr)


def texts(seed=4):
    rng = random.Random(seed)
    passages = [sentence(rng, n=n) for n in (49, 50, 51, 60, 75, 130, 230, 420)]
    rows = []
    for key in rng.sample(range(1000), 160):
        parts = [sentence(rng, n=rng.randrange(30)) for _ in range(3)]
        for p in rng.sample(passages, rng.randrange(4)):
            own = p.split()
            cut = rng.randrange(len(own)) if rng.random() < 0.3 else 0
            parts.insert(rng.randrange(len(parts)), "\n".join(own[cut:]) if rng.random() < 0.5 else " ".join(own[: len(own) - cut]))
        rows.append(row(key, "  ".join(parts)))
    rows += [row(2000 + i, rows[5][1]) for i in range(20)] + [row(3000 - i, "again and " * 60 + f"x{i}") for i in range(9)]
    edited = rows[7][1].split()
    edited[len(edited) // 2] = "edited"
    return rows + [row(1500, " ".join(edited)), row(rows[3][0], rows[8][1]), rows[2], row(1600, " ".join(["one"] * 500))]


def run(spark, folder, rows):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    got = queries.queries()["op11_substring_dedup"](spark, str(folder))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    rows = texts() + [r for r in odd_rows() if r[0] != 7]
    expected = digest(plain(rows))
    assert run(spark, tmp_path, rows) == expected
    assert sum(r[2] > 0 for r in expected) > 60 and any(0 < r[2] < r[1] for r in expected)


def test_query_over_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    expected = digest(plain(rows))
    got = queries.queries()["op11_substring_dedup"](spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected
    assert sum(r[2] > 0 for r in expected) > 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30).map(" ".join), min_size=1, max_size=4), st.integers(2, 9))
def test_anchors_depend_on_the_window_alone(given_texts, size):
    windows = substring_dedup._Windows(pd.Series(given_texts, dtype=object))
    start, anchor, value = windows.anchors(size)
    words = [w for t in given_texts for w in t.split()]
    owner = np.repeat(np.arange(len(given_texts)), windows.sizes)
    expected = [i for i in range(len(words) - size + 1) if owner[i] == owner[i + size - 1]]
    assert start.tolist() == expected
    seen = {}
    for i, at in zip(start, anchor):
        assert 0 <= at - i <= size - size // 2
        assert seen.setdefault(tuple(words[i : i + size]), at - i) == at - i
    by_words = defaultdict(set)
    for i in expected:
        by_words[tuple(words[i : i + size])].add(int(windows.hashes(size, 1)[i]))
    assert all(len(x) == 1 for x in by_words.values()) and len(set.union(set(), *by_words.values())) == len(by_words)


def test_levels_double_until_no_candidate_survives(spark):
    rows = texts()
    _, levels = substring_dedup.repeated_windows(frame(spark, rows), longest=None)
    assert [n for n, _ in levels] == [50, 100, 200, 400, 800][: len(levels)] and len(levels) >= 4
    for size, level in levels:
        first = defaultdict(set)
        for r in rows:
            own = r[1].split()
            for i in range(len(own) - size + 1):
                first[tuple(own[i : i + size])].add(r[0])
        texts_of = defaultdict(set)
        for r in rows:
            texts_of[r[1]].add(r[0])
        expected = set()
        for r in rows:
            own = r[1].split()
            if r[0] == min(texts_of[r[1]]):
                # Copies of one text alone are no candidates: they are repeats as a whole.
                others = lambda w: {k for k in first[w] if k == min(texts_of[r[1]]) or k not in texts_of[r[1]]}
                expected |= {(r[0], i) for i in range(len(own) - size + 1) if len(others(tuple(own[i : i + size]))) > 1}
        got = {(r["doc"], at) for r in level.collect() for at in r["at"]}
        assert got == expected


def test_operator_on_odd_rows_and_clashes(spark):
    rows = odd_rows() + [row(9, odd_rows()[10][1]), (10, "some " * 60, None, None, None)]
    docs = clashing(frame(spark, rows)).selectExpr("*", "1 AS doc", "2 AS mark", "3 AS places", "4 AS copy", "5 AS Kept", "6 AS other_doc", "7 AS at", "8 AS first")
    got = substring_dedup.remove_repeated_windows(docs)
    assert got.columns == [c for c in docs.columns if c != "Kept"] + ["n_words", "n_removed", "kept"]
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], (r["kept"] or "").encode()) for r in got.collect()), key=repr)
    assert found == plain(rows)
    assert {r["kept"] for r in got.where("text IS NULL").collect()} == {None}
    assert {r["n_removed"] for r in got.where("doc_id = 9").collect()} == {60_000}


def test_other_lengths_and_empty_table(spark):
    rows = [row(1, "a b c d e f g"), row(2, "x b c d e y"), row(3, "f g a b"), row(None, "b c d e")]
    for words in (2, 3, 4):
        got = substring_dedup.remove_repeated_windows(frame(spark, rows), words=words)
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"].encode()) for r in got.collect()), key=repr) == plain(rows, words)
    assert substring_dedup.remove_repeated_windows(frame(spark, rows).where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_windows(frame(spark, rows), words=1)


def test_removal_uses_every_level_until_no_candidate_survives(spark, monkeypatch):
    rng = random.Random(8)
    passage = sentence(rng, n=430)
    rows = [row(i, f"{sentence(rng, n=20)} {passage if i < 3 else sentence(rng, n=90)} {sentence(rng, n=20)}") for i in range(5)]
    found = []

    def kept(*args, given=substring_dedup.repeated_windows, **more):
        found.append(given(*args, **more))
        return found[-1]

    monkeypatch.setattr(substring_dedup, "repeated_windows", kept)
    got = substring_dedup.remove_repeated_windows(frame(spark, rows))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"].encode()) for r in got.collect()), key=repr) == plain(rows)
    assert [size for size, _ in found[0][1]] == [50, 100, 200, 400]
    assert {r["doc_id"] for r in got.where("n_removed >= 430").collect()} == {1, 2}
