import random

import numpy as np
from frames import clashing, frame, odd_rows, row, sentence
from pyspark.sql import functions as F

from ratelens.llm import langid


def labelled(n=240):
    rng = random.Random(3)
    return [row(i, sentence(rng, lang, 8), lang) for i in range(n) for lang in ("en", "de", "es")]


def test_held_out_accuracy(spark):
    docs = frame(spark, labelled())
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    found = langid.with_language(docs.where("doc_id % 3 = 1"), model).toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_counts_equal_a_plain_loop():
    texts = ["Ab, c", "", "éa", "zz  z"]
    got = {}
    for owner, position in langid._grams(texts, 1 << 16):
        for o, p in zip(owner, position):
            got.setdefault(int(o), []).append(int(p))
    for i, t in enumerate(texts):
        alone = [int(p) for _, positions in langid._grams([t], 1 << 16) for p in positions]
        assert sorted(got.get(i, [])) == sorted(alone)
    # " zz z " has 3 letters, 5 pairs, 4 triples and 3 of four.
    assert len(got[3]) == 15


def test_blocks_do_not_change_the_score(monkeypatch):
    rng = random.Random(5)
    texts = [sentence(rng, "de", 300), "", "x", sentence(rng, "en", 500)]
    gather = lambda: sorted((int(o), int(p)) for owner, pos in langid._grams(texts, 1 << 14) for o, p in zip(owner, pos))
    whole = gather()
    monkeypatch.setattr(langid, "BLOCK", 97)
    cut = gather()
    assert cut == whole


def test_odd_rows(spark):
    model = langid.fit(frame(spark, labelled(40) + odd_rows()))
    docs = clashing(frame(spark, odd_rows())).withColumn("Lang_Pred", F.lit("old"))
    found = {(r["doc_id"], r["text"]): r for r in langid.with_language(docs, model).collect()}
    for key, r in found.items():
        if key[1] in (None, "", "12 345 !!"):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de", "es") and 0 <= r["score"] <= 1
    assert langid.with_language(docs.where(F.lit(False)), model).count() == 0


def test_no_labels_and_sample_bound(spark):
    docs = frame(spark, labelled(20))
    empty = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert [r["lang_pred"] for r in langid.with_language(docs.limit(2), empty).collect()] == ["und", "und"]
    few = langid.fit(docs, rows_per_language=5)
    assert few.languages == ["de", "en", "es"] and np.isfinite(few.log_gram).all()


def test_copies_do_not_pass_the_bound(spark):
    rng = random.Random(11)
    copies = [(i, "the same text in many copies", "en") for i in range(6000)]
    docs = spark.createDataFrame(copies + [(10**6 + i, sentence(rng, "en", 6), "en") for i in range(6000)], "doc_id long, text string, lang string")
    drawn = langid.fitting_sample(docs, "text", "lang", {"en": 12_000}, 600).groupBy(F.col("text") == copies[0][1]).count().collect()
    assert len(drawn) == 2 and all(220 < r["count"] < 380 for r in drawn)
    # Without an id the copies are one row, drawn once or not at all.
    assert langid.fitting_sample(docs.select("text", "lang"), "text", "lang", {"en": 12_000}, 12_000).where(F.col("text") == copies[0][1]).count() == 1


def test_prediction_is_plain_naive_bayes(spark):
    docs = frame(spark, labelled(30))
    model = langid.fit(docs)
    texts = ["the house of the", "und der die das", "x"]
    names, scores = model.predict(texts)
    total = {k: sum(r["lang"] == k for r in docs.collect()) for k in model.languages}
    counts = {k: np.full(langid.MOST_POSITIONS, langid.SMOOTHING) for k in model.languages}
    for r in docs.collect():
        for _, places in langid._grams([r["text"]], langid.MOST_POSITIONS):
            np.add.at(counts[r["lang"]], places, 1)
    for text, name, score in zip(texts, names, scores):
        logs = {k: np.log(total[k] / sum(total.values())) for k in model.languages}
        for k in logs:
            for _, places in langid._grams([text], langid.MOST_POSITIONS):
                logs[k] += sum(np.log(counts[k][p] / counts[k].sum()) for p in places)
        best = max(logs, key=logs.get)
        assert name == best and abs(score - 1 / sum(np.exp(v - logs[best]) for v in logs.values())) < 1e-3
