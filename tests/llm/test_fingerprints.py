import hashlib
import random

from frames import clashing, frame, odd_rows, row, sentence
from pyspark.sql import functions as F

from ratelens.llm import fingerprints as fp


def rows(seed=4, n=60):
    rng = random.Random(seed)
    return [row(i, sentence(rng, rng.choice(("en", "de", "es")), rng.randrange(1, 120))) for i in range(n)]


def edits(spark, given):
    return fp.half_edits(frame(spark, given)).collect()


def expected_edits(given):
    """Distinct documents in falling order of ids; each row's edited text."""
    distinct = sorted({(k, t or "") for k, t, *_ in given}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (k, t) in enumerate(distinct):
        after = distinct[(i + 1) % len(distinct)][1]
        half = len(t) // 2
        out[k, t] = t[: len(t) - half] + after[:half]
    return sorted(((k, out[k, t or ""]) for k, t, *_ in given), key=repr)


def test_edited_texts(spark):
    given = rows() + [row(1000, ""), row(1001, None), row(None, "no id at all"), row(2000, "é日🙂" * 9)]
    assert sorted(((r["doc_id"], r["edited"]) for r in edits(spark, given)), key=repr) == expected_edits(given)


def test_one_document_repeated_rows_and_empty_table(spark):
    assert [r["edited"] for r in edits(spark, [row(1, "abcde")])] == ["abcab"]
    twice = [row(5, "abcd"), row(5, "abcd"), row(3, "xyz")]
    assert sorted((r["doc_id"], r["edited"]) for r in edits(spark, twice)) == [(3, "xya"), (5, "abxy"), (5, "abxy")]
    assert fp.half_edits(frame(spark, rows()).where(F.lit(False))).count() == 0


def test_odd_rows_and_clashing_columns(spark):
    found = fp.half_edits(clashing(frame(spark, odd_rows()))).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        assert r["marks"] and r["edited_marks"] and r["next_hashes"]


def test_anchors_are_closed_syncmers_of_their_own_words(spark):
    text = sentence(random.Random(8), "en", 300)
    alone, moved = [
        [tuple(a) for a in r["anchors"]]
        for r in spark.createDataFrame([(0, text), (1, "some other words come first here now " + text)], "i int, text string")
        .select("i", fp.anchors(F.col("text")).alias("anchors")).orderBy("i").collect()
    ]
    words = text.split()
    pairs = spark.createDataFrame([(i, words[i], words[i + 1]) for i in range(299)], "i int, a string, b string")
    h = [r["h"] for r in pairs.select("i", F.hash("a", "b").alias("h")).orderBy("i").collect()]
    closed = [i for i in range(296) if min(h[i], h[i + 3]) <= min(h[i + 1], h[i + 2])]
    assert [a[0] for a in alone] == closed
    assert {(at + 7, x) for at, x in alone} <= set(moved)


def test_likeness(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = {"same": words, "half": words[:1000] + [f"x{i}" for i in range(1000)], "none": [f"y{i}" for i in range(2000)]}
    made = spark.createDataFrame([(k, " ".join(v), " ".join(words)) for k, v in texts.items()], "k string, a string, b string")
    near = {r["k"]: r["n"] for r in made.select("k", fp.likeness(fp.hashes(fp.fingerprint(F.col("a"))), fp.hashes(fp.fingerprint(F.col("b")))).alias("n")).collect()}
    assert near["same"] == 1 and near["none"] == 0
    marks = {r["k"]: {m["hash"] for m in r["m"]} for r in made.select("k", fp.fingerprint(F.col("a")).alias("m")).collect()}
    assert len(marks["same"]) > 700  # every anchor of the 2,000 words
    assert near["half"] == len(marks["half"] & marks["same"]) / len(marks["half"] | marks["same"])


def test_a_short_passage_of_long_texts_is_seen(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = words(60)
    a, b = words(9000) + passage + words(9000), passage + words(15000)
    pair = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(*[fp.fingerprint(F.col(c)).alias(c) for c in "ab"])
    got = pair.select("a", "b", fp.likeness(fp.hashes(F.col("a")), fp.hashes(F.col("b"))).alias("n")).first()
    shared = {m["hash"]: m["at"] for m in got["b"]}
    places = [(m["at"], shared[m["hash"]]) for m in got["a"] if m["hash"] in shared]
    assert len(places) > 15 and all(x - y == 9000 for x, y in places) and got["n"] > 0


def test_positional_matching(spark):
    text = sentence(random.Random(9), "en", 60)
    pairs = spark.createDataFrame([(text, "one two three " + text), (None, text), ("", ""), (text, "q r s t u v w")], "a string, b string")
    found = [(r["shift"], r["matched"]) for r in fp.shared_passages(pairs, "a", "b").collect()]
    assert found[0][0] == 3 and found[0][1] > 15
    assert found[1:] == [(None, 0)] * 3


def test_fingerprint_text_and_hash_of_equal_texts(spark):
    made = spark.createDataFrame([("a b c",), ("a b c",), ("",), (None,)], "t string").select(fp.as_text(fp.fingerprint(F.col("t"))).alias("f"))
    one, two, empty, null = [r["f"] for r in made.collect()]
    assert one == two and one.endswith(":-1") and len(empty) == 11 and null is None
    assert hashlib.sha256(b"").hexdigest()  # the query hashes the edited text with sha2
