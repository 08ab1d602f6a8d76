import math
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ratelens.operators import features, pages
from ratelens.operators import text as TX


@pytest.fixture(scope="module")
def reviews(spark):
    """Item "hot" has a third of all texts."""
    data = [(f"r{i:03d}", "hot" if i % 3 == 0 else f"item{i % 7}", f"word{i} hops malt. ") for i in range(90)]
    return spark.createDataFrame(data, "review_id string, item string, review string")


def test_text_by_item_is_whole_and_ordered(reviews):
    parts = TX.text_by_item(reviews, "item", "review", ["review_id"], texts_per_row=4).collect()
    want = {}
    for r in sorted(reviews.collect(), key=lambda r: r["review_id"]):
        want[r["item"]] = want.get(r["item"], "") + r["review"]
    got = {}
    for r in sorted(parts, key=lambda r: (r["item"], r["part"])):
        got[r["item"]] = got.get(r["item"], "") + r["review"]
    assert got == want
    assert max(r["review"].count("malt") for r in parts) == 4
    assert max(r["part"] for r in parts if r["item"] == "hot") == 7


def test_text_by_item_gives_one_row_to_ordinary_items(reviews):
    parts = TX.text_by_item(reviews, "item", "review", ["review_id"])
    assert parts.where("part > 0").count() == 0
    assert parts.count() == 8


def test_clean_text(spark):
    df = spark.createDataFrame([(1, "The Beans, and THE notes of it"), (2, "")], "id int, text string")
    cleaned = TX.clean_text(df, "text", ["the", "and", "of"], {"beans": "bean"})
    assert rows(cleaned.select("id", "clean")) == [(1, "bean notes it"), (2, "")]
    default = TX.clean_text(df, "text").select("id", "clean")
    assert rows(default)[0] == (1, "beans notes")


def test_lemmatize_by_table_keeps_order(spark):
    df = spark.createDataFrame([(1, ["beans", "zz", "beans", "aa"]), (2, [])], "id int, words array<string>")
    table = spark.createDataFrame([("beans", "bean"), ("aa", "a")], "token string, lemma string")
    got = TX.lemmatize_by_table(df, "id", "words", table).select("id", "words")
    assert rows(got) == [(1, ["bean", "zz", "bean", "a"]), (2, [])]


def _expected_tf(texts, size):
    counts, totals = {}, Counter()
    for key, text in texts:
        words = [w for w in text.lower().split() if w not in ("10", "12") and len(w) > 1]
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        counts.setdefault(key, Counter()).update(terms)
        totals.update(terms)
    listed = [t for t, _ in sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:size]]
    out = {}
    for key, c in counts.items():
        length = math.sqrt(sum(c[t] ** 2 for t in listed))
        out.update({(key, t): c[t] / length for t in listed if c[t]})
    return out


def test_term_frequency_against_brute_force(spark):
    texts = [("a", "hop malt hop 10 malt"), ("a", "hop hop"), ("b", "malt 12 hop sweet"), ("c", "dry x sweet dry")]
    df = spark.createDataFrame(texts, "item string, text string")
    got = {(r["item"], r["term"]): r["tf"] for r in TX.term_frequency(df, "item", "text", size=5).collect()}
    want = _expected_tf(texts, 5)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    lengths = Counter()
    for (item, _), tf in got.items():
        lengths[item] += tf * tf
    assert all(v == pytest.approx(1.0) for v in lengths.values())


def test_term_table_and_vectors(spark):
    df = spark.createDataFrame([("a", "hop malt"), ("b", "zz")], "item string, text string")
    tf = TX.term_frequency(df, "item", "text", size=2)
    wide = TX.term_table(tf, "item", ["hop", "hop malt"], keys=df)
    assert [(r[0], round(r[1], 4), round(r[2], 4)) for r in wide.orderBy("item").collect()] == [
        ("a", 0.7071, 0.7071),
        ("b", 0.0, 0.0),
    ]
    table, terms = TX.term_features(df, "item", "text", size=2)
    assert terms == ["hop", "hop malt"] and rows(table) == rows(wide)
    model, vectors = TX.term_vector_model(df, "text", size=10)
    assert len(model.stages[0].vocabulary) == 4
    for r in vectors.collect():
        assert r["term_vector"].norm(2) == pytest.approx(1.0)


def test_review_texts_to_tokens(reviews):
    got = TX.review_texts_to_tokens(reviews, "item", "review", ["review_id"], ["malt"], texts_per_row=10)
    hot = got.where("item = 'hot'").orderBy("part").first()["clean"]
    assert hot.startswith("word0 hops word3 hops")


def test_one_hot_columns(spark):
    df = spark.createDataFrame([(1, "Bräu"), (2, "Zed"), (3, None)], "id int, maker string")
    wide = features.one_hot_columns(df, "maker", ["Bräu", "Zed"], "maker")
    assert wide.columns == ["id", "maker_Bru", "maker_Zed"]
    assert rows(wide) == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    assert rows(features.one_hot_flags(df, "id", "maker")) == [(1, "Bräu", 1), (2, "Zed", 1)]


def test_one_hot_names_that_collide_stay_apart(spark):
    df = spark.createDataFrame([(1, "Bräu"), (2, "Bru"), (3, "é"), (4, None), (5, "BRU")], "id int, maker string")
    wide = features.one_hot_columns(df, "maker", ["BRU", "Bru", "Bräu", "é"], "maker")
    assert len(set(c.lower() for c in wide.columns)) == 5
    assert rows(wide) == [(1, 0, 0, 1, 0), (2, 0, 1, 0, 0), (3, 0, 0, 0, 1), (4, 0, 0, 0, 0), (5, 1, 0, 0, 0)]


def test_anchors_and_placed_fields(spark):
    html = '<a class="x" href="/i/1"> <b>Pale</b> Ale</a><p>one</p><a href="/i/2">Stout</a><p>two</p><a name="n">no</a><p>three</p>'
    df = spark.createDataFrame([(1, html), (2, "<p>only</p>"), (3, None)], "page_id int, html string")
    assert rows(pages.anchors(df)) == [(1, 0, "/i/1", "Pale Ale"), (1, 1, "/i/2", "Stout")]
    wanted = {"first": "<p>(.*?)</p>", "second": "<p>(.*?)</p>", "last": "<p>(.*?)</p>"}
    found = pages.page_fields(df, wanted, places={"second": 2, "last": -1})
    assert rows(found) == [(1, "one", "two", "three"), (2, "only", None, "only"), (3, None, None, None)]


def test_one_hot_vectors(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "id int, maker string")
    got = {r["id"]: list(r["maker_vector"].indices) for r in features.one_hot_vectors(df, ["maker"]).collect()}
    assert got == {1: [1], 2: [0], 3: [1]}


def test_links(spark):
    html = '<a href="/item/1">x</a><a href="/rate/1">y</a><a href="http://else/item/2">z</a><a href="/item/top-50/">t</a>'
    df = spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string")
    found = pages.links(df)
    assert rows(found) == [(1, 0, "/item/1"), (1, 1, "/rate/1"), (1, 2, "http://else/item/2"), (1, 3, "/item/top-50/")]
    kept = pages.keep_links(found, prefix="/item/", excluding=("/top-50",))
    assert rows(pages.absolute(kept, "http://site").select("url")) == [("http://site/item/1",)]
    assert pages.keep_links(found, containing="/item/").count() == 3


def test_page_fields(spark):
    data = [(1, "<title>T\nx</title><b>5%</b>"), (2, "<b>6%</b>"), (3, "<title>U</title>")]
    df = spark.createDataFrame(data, "page_id long, html string")
    patterns = {"title": pages.TITLE_PATTERN, "abv": r"<b>([^<]*%)</b>"}
    got = pages.page_fields(df, patterns, required=("title",), defaults={"abv": "NA"})
    assert rows(got) == [(1, "T\nx", "5%"), (3, "U", "NA")]


def test_review_fields(spark):
    data = [("AROMA 7/10 LOOK 4/5 TASTE 15/20 PALATE 3/5 OVERALL 10/10", "ann - Graz - May 1"), ("AROMA 7/0", "bob")]
    df = spark.createDataFrame(data, "scores string, author string")
    got = rows(pages.review_fields(df, "scores", "author").drop("scores", "author"))
    assert got == [
        (0.7, 0.8, 0.75, 0.6, 1.0, "ann", "Graz", "May 1"),
        (None, None, None, None, None, "bob", None, None),
    ]


def test_placeholders(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item string")
    found = spark.createDataFrame([("a", "u", "0.5")], "item string, user_name string, taste string")
    assert rows(pages.with_placeholders(items, found)) == [("a", "u", "0.5"), ("b", None, None)]
