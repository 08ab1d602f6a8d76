import pytest
from conftest import rows
from pyspark.sql import functions as F

from ratelens.functions import scalars as S
from ratelens.functions import text as T
from ratelens.functions import vectors as V


def one(spark, column, **values):
    names = list(values) or ["x"]
    types = ", ".join(f"{n} {values[n][1]}" for n in values) or "x int"
    data = [tuple(v[0] for v in values.values())] if values else [(1,)]
    return spark.createDataFrame(data, types).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected", [("3.5", 3.5), ("NA", None), (None, None), ("nan", None), ("", None), ("1e2", 100.0)]
)
def test_number(spark, text, expected):
    assert one(spark, S.number("c"), c=(text, "string")) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("7/10", 0.7), ("10/10", 1.0), ("15/20", 0.75), ("5/", None), ("5/0", None), ("none", None), (None, None)],
)
def test_fraction_value(spark, text, expected):
    assert one(spark, S.fraction_value("c"), c=(text, "string")) == expected


def test_fractions_keep_two_digit_numerators(spark):
    text = "AROMA 10/10 TASTE 15/20 PALATE x/5"
    assert one(spark, S.fractions("c"), c=(text, "string")) == ["10/10", "15/20"]
    assert one(spark, S.nth_fraction("c", 2), c=(text, "string")) == 0.75
    assert one(spark, S.nth_fraction("c", 3), c=(text, "string")) is None


def test_rating_scale_and_truncation(spark):
    assert one(spark, S.rating_out_of_ten("c"), c=("0.7", "string")) == pytest.approx(7.0)
    assert one(spark, S.truncated("c"), c=(7.9, "double")) == 7
    assert one(spark, S.truncated("c"), c=(-7.9, "double")) == -7


def test_text_fields(spark):
    assert one(spark, S.leading_number("c"), c=("3.9/5 stars", "string")) == 3.9
    assert one(spark, S.leading_number("c"), c=("none", "string")) is None
    assert one(spark, S.without_percent("c"), c=("5.5%", "string")) == "5.5"
    assert one(spark, S.has_percent("c"), c=("5.5%", "string")) is True
    assert one(spark, S.ascii_only("c"), c=("Bräu 🍻 x", "string")) == "Bru  x"
    assert one(spark, S.null_if_missing("c"), c=("NA", "string")) is None
    assert one(spark, S.missing_as("c", F.lit("5%")), c=("NA", "string")) == "5%"
    assert one(spark, S.review_key("a", "b"), a=("item", "string"), b=("user", "string")) == "item_user"


def test_user_info_with_missing_parts(spark):
    full, short = "ann - Graz - May 1", "ann - Graz"
    assert [one(spark, S.user_info("c", i), c=(full, "string")) for i in (1, 2, 3)] == ["ann", "Graz", "May 1"]
    assert one(spark, S.user_info("c", 3), c=(short, "string")) is None


@pytest.mark.parametrize(
    "value, expected", [(0.123456, 0.12346), (123456.0, 123460.0), (0.0, 0.0), (-1.999999, -2.0), (1e-7, 1e-7)]
)
def test_significant(spark, value, expected):
    assert one(spark, S.significant("c"), c=(value, "double")) == pytest.approx(expected, rel=1e-12)


def test_one_decimal_rounds_half_up(spark):
    assert one(spark, S.one_decimal("c"), c=(7.25, "double")) == "7.3"


def test_ordered_pair(spark):
    low, high = S.ordered_pair("a", "b")
    assert one(spark, F.array(low, high), a=(5, "int"), b=(2, "int")) == [2, 5]


def test_grids():
    assert S.linear_grid(0.05, 0.2, 5) == pytest.approx([0.05, 0.0875, 0.125, 0.1625, 0.2])
    grid = S.log_grid(0, -10, 50)
    assert len(grid) == 50 and grid[0] == 1.0 and grid[-1] == pytest.approx(1e-10)


def test_cosine_distance(spark):
    def distance(a, b):
        return one(spark, V.cosine_distance("a", "b"), a=(a, "array<double>"), b=(b, "array<double>"))

    assert distance([1.0, 0.0], [0.0, 2.0]) == pytest.approx(1.0)
    assert distance([1.0, 2.0], [2.0, 4.0]) == pytest.approx(0.0, abs=1e-12)
    assert distance([1.0, 0.0], [-1.0, 0.0]) == pytest.approx(2.0)
    assert distance([0.0, 0.0], [1.0, 0.0]) is None


def test_tokens_keep_all_scripts(spark):
    words = T.tokens("c")
    assert one(spark, words, c=("Die Überraschung: a 10/10 été!", "string")) == ["die", "überraschung", "10", "10", "été"]
    assert one(spark, T.without_words(words, ["10", "12"]), c=("10 hop 12 malt", "string")) == ["hop", "malt"]


def test_bigrams_of_short_texts(spark):
    for text, expected in [("", []), ("hop", []), ("hop malt", ["hop malt"]), ("aa bb cc", ["aa bb", "bb cc"])]:
        assert one(spark, T.bigrams(T.tokens("c")), c=(text, "string")) == expected
    assert one(spark, T.unigrams_and_bigrams(T.tokens("c")), c=("aa bb", "string")) == ["aa", "bb", "aa bb"]


def test_lemmas(spark):
    lemma = T.joined(T.lemmas(T.tokens("c"), {"beans": "bean", "notes": "note"}))
    assert one(spark, lemma, c=("Beans and notes", "string")) == "bean and note"
