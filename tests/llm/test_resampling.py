import hashlib
import math
import random
import re
import zlib

import numpy as np
from frames import clashing, frame, odd_rows, row, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratelens.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def plain(rows, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    found = [(r[0], *plain_features(r[1])) for r in rows]
    for _, _, f in found:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, plain_features(text)[1], 1)
    all_s, all_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + 10000) / ((a + 1) * (all_t + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for key, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 5 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def texts(seed=5):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice(["en", "de", "es"]), rng.randrange(1, 9)) for _ in range(30)] + ["One", "two Words", "?!", "", "  "]
    return [row(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for k in range(300)]


def target(seed=6):
    rng = random.Random(seed)
    return [sentence(rng, "en", 30) + "\n" + sentence(rng, "en", 3) for _ in range(12)] + [None, ""]


def tables(spark, folder, rows, wanted):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(wanted)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return sorted((tuple(r) for r in queries.queries()["op12_importance_resampling"](spark, str(folder)).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 \n?é\x7f", max_size=40))
def test_features_of_lines_and_across_lines_are_those_of_the_text(text):
    n, crossing = resampling._crossing(text, 10000)
    inside, sizes, words = resampling._line_buckets(text.split("\n"), 10000)
    expected = plain_features(text)
    assert n == expected[0] == words.sum() and len(inside) == sizes.sum()
    assert sorted([*inside.tolist(), *crossing]) == sorted(expected[1])


def test_query_equals_brute_force(spark, tmp_path):
    rows = texts() + odd_rows()
    got = tables(spark, tmp_path, rows, target())
    assert got == plain(rows, target())
    assert sum(r[4] is not None for r in got) > 5


def test_query_over_the_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = queries.queries()["op12_importance_resampling"](spark, folder).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, wanted)


def test_ties_go_to_the_smaller_key_and_repeated_rows_stay(spark, tmp_path):
    text = " ".join(["same"] * 25)
    rows = [row(7, text)] * 40 + [row(k, "few words") for k in range(30)]
    got = tables(spark, tmp_path, rows, [])
    assert got == plain(rows, [])
    assert sorted(r[4] for r in got if r[4]) == [1, 2]


def test_a_common_line_counts_as_often_as_it_occurs(spark):
    docs = frame(spark, [row(k, f"shared line of words\nown{k}") for k in range(500)])
    found = resampling.features(docs.select("doc_id", "text"))
    times = {r["times"]: r["n_features"] for r in found.lines.collect()}
    assert times[500] == 9 and found.lines.count() == 501
    assert resampling.histogram(found).sum() == 500 * (9 + 1 + 2)


def test_odd_rows_clashes_and_empty_tables(spark):
    docs = clashing(frame(spark, odd_rows())).selectExpr("*", "1 AS row", "2 AS marks", "3 AS Weight", "4 AS found", "5 AS place", "6 AS n", "7 AS gain", "8 AS other")
    wanted = spark.createDataFrame([("one two three",)], "text string")
    got = resampling.resample(docs, wanted)
    assert got.count() == docs.count()
    assert got.columns == [c for c in docs.columns if c not in ("text", "Weight")] + ["n_features", "weight", "score", "rank"]
    assert resampling.resample(docs.where(F.lit(False)), wanted).count() == 0
    assert resampling.resample(docs, wanted.where(F.lit(False))).count() == docs.count()
