import math
import random
import re
from collections import Counter

import numpy as np
from frames import clashing, frame, odd_rows, row, sentence
from pyspark.sql import functions as F

from ratelens.llm import lm


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def prose(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(("en", "de", "es"))
        out.append(row(i, sentence(rng, lang, rng.randrange(5, 40)) + f" Rare{rng.randrange(10**6)}"))
    return out


def test_counts_and_base_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 64)  # so that tokens outside the head occur
    rows = prose(n=80) + odd_rows()[:-1]
    train = [r for i, r in enumerate(rows) if i % 7 != 2]
    count = Counter(t for r in train for t in tokens(r[1]))
    total, types = sum(count.values()), len(count)
    model, counts = lm.statistics(frame(spark, train))
    assert 0 < len(model.head) <= 64 and (model.tokens, model.types) == (total, types)
    found = lm.score_texts(clashing(frame(spark, rows)), model, counts).collect()
    expected = sorted(
        (repr(r[0]), len(tokens(r[1])), sum(count[t] > 0 for t in tokens(r[1])), round(sum(math.log10((count[t] + 1) / (total + types + 1)) for t in tokens(r[1])), 5))
        for r in rows
    )
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in found) == expected
    # Before any gradient step the model is the unigram model.
    assert all(abs(r["score"] - r["base_score"]) < 1e-3 * max(1, abs(r["base_score"])) for r in found)


def test_training_beats_the_base_on_held_out_texts(spark):
    rows = prose(n=600)
    held = lm.lm_scores(frame(spark, rows[500:]), frame(spark, rows[:500])).toPandas()
    assert held["score"].sum() > held["base_score"].sum() + 0.05 * abs(held["base_score"].sum())


def drawn_model(rng, rare=20_000):
    """A model of 1,500 frequent tokens and of rare ones in 256 leaves, and a text of its tokens."""
    head = np.sort(rng.integers(-(2**62), 2**62, 1500))
    count = rng.integers(5, 90, len(head))
    leaves = rng.integers(1, 200, 256).astype(float)
    return lm.Model.start(head, count, int(count.sum()) + 3 * rare, len(head) + rare, leaves), head


def every_target(model):
    groups = [np.full(lm.WAYS**d, k) for k, d in enumerate(model.depths)]
    return np.concatenate(groups), np.concatenate([np.arange(len(g)) for g in groups])


def test_the_model_is_a_distribution():
    rng = np.random.default_rng(3)
    model, head = drawn_model(rng)
    learner = lm._Learner(model)
    text = rng.choice(np.r_[head[:40], rng.integers(-(2**62), 2**62, 40)], 4000)
    learner.learn(text, np.zeros(4000, np.int64))
    trained = learner.model
    _, hit = trained.look_up(text[:3])
    hashed = trained.features(text[:3], hit, np.zeros(3, np.int64))[:, 2:3]
    group, place = every_target(trained)
    every = 10 ** trained.log10(np.repeat(hashed, len(group), axis=1), group, place)
    assert abs(every.sum() - 1) < 1e-4
    # Each frequent token has a target of its own, which no rare token shares.
    at, hit = trained.look_up(head)
    targets = list(zip(*trained.targets(head, at, hit)))
    assert hit.all() and len(set(targets)) == len(head) and all(g != lm.RARE for g, _ in targets)


def plain_log10(model, hashed, group, place):
    """Logarithm of a target's probability, by a plain loop over its softmaxes."""
    out, path = 0.0, [(0, group)]
    for j in range(model.depths[group]):
        digits = model.depths[group] - j
        path.append((int(model.first_node[group]) + (16**j - 1) // 15 + (place >> 4 * digits), place >> 4 * (digits - 1) & 15))
    for i, (node, answer) in enumerate(path):
        logits = [float(x) for x in model.bias[node]]
        for feature in range(3 if i == 0 else lm.LOWER_FEATURES):
            mixed = int(hashed[feature]) + int(node) * lm._BASE & 2**64 - 1
            mixed = (mixed ^ mixed >> 29) * 0xBF58476D1CE4E5B9 & 2**64 - 1
            row = (mixed ^ mixed >> 32) >> 33 & len(model.rows) - 1
            logits = [x + float(w) for x, w in zip(logits, model.rows[row])]
        out += logits[answer] - math.log(sum(map(math.exp, logits)))
    return out / math.log(10)


def test_scores_and_steps_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    model, head = drawn_model(rng)
    model.rows += rng.normal(0, 0.2, model.rows.shape).astype(np.float32)
    text = rng.choice(np.r_[head, rng.integers(-(2**62), 2**62, 300)], 200)
    at, hit = model.look_up(text)
    group, place = model.targets(text, at, hit)
    hashed = model.features(text, hit, np.zeros(len(text), np.int64))
    expected = [plain_log10(model, hashed[:, i], int(group[i]), int(place[i])) for i in range(len(text))]
    assert np.abs(model.log10(hashed, group, place) - expected).max() < 1e-4
    # Slopes against finite differences.
    slopes, rows = lm._Learner(model).slopes(hashed, group, place)
    for row, way in ((rows[0], 3), (rows[-1], 7), (rows[250], 0)):
        own = slopes[way, rows == row].sum()
        ends = []
        for step in (0.02, -0.02):
            model.rows[row, way] += step
            ends.append(model.log10(hashed, group, place).sum() * math.log(10))
            model.rows[row, way] -= step
        assert abs((ends[0] - ends[1]) / 0.04 - own) < 0.02


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_PER_LEARNER", 1000)
    monkeypatch.setattr(lm, "HEAD", 512)  # so that rare tokens occur
    docs = frame(spark, prose(n=300))
    scores = []
    for parts in (1, 8, 64):
        found = lm.lm_scores(docs.repartition(parts, "text"), docs.repartition(parts)).collect()
        scores.append(dict((r["doc_id"], r["score"]) for r in found))
    assert all(abs(s[k] - v) <= 1e-6 * abs(v) for s in scores[1:] for k, v in scores[0].items())


def test_names_of_its_own_do_not_clash(spark):
    docs = frame(spark, prose(n=30)).selectExpr("*", "1 AS row", "2 AS scored", "3 AS logs", "4 AS seen", "5 AS _row", "6 AS _s", "7 AS learner", "8 AS token")
    found = lm.lm_scores(docs, docs)
    assert found.columns[-5:] == ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {(r["row"], r["scored"], r["logs"], r["seen"], r["_row"], r["_s"], r["learner"], r["token"]) for r in found.collect()} == {tuple(range(1, 9))}


def test_empty_tables(spark):
    docs = frame(spark, prose(n=20))
    none = docs.where(F.lit(False))
    assert lm.lm_scores(none, docs).count() == 0
    alone = lm.lm_scores(docs, none).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in alone)


def test_more_tasks_than_texts(spark):
    docs = spark.createDataFrame([(i, f"a few plain words {i}") for i in range(6)], "doc_id long, text string").repartition(32)
    assert lm.lm_scores(docs, docs).where("score < 0").count() == 6


def test_tokens_equal_the_definition():
    import pandas as pd

    texts = ["A b\tC", "", " x\u00a0y \x0b\x0cz\r\n", "ÀB é 日本 🙂", "a", "b c a", "aa a", "  "]
    flat, first, lengths = lm._flat(pd.Series(texts))
    expected = [tokens(t) for t in texts]
    assert list(lengths) == [len(t) for t in expected]
    names = [w for t in expected for w in t]
    assert len({(n, h) for n, h in zip(names, flat.tolist())}) == len(set(names)) == len(set(flat.tolist()))
    assert list(first) == [sum(lengths[:i]) for i, n in enumerate(lengths) for _ in range(n)]
    alone = np.concatenate([lm._flat(pd.Series([t]))[0] for t in texts])
    assert (alone == flat).all()
