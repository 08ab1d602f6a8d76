"""Small tables that the tests of this folder share."""

import random

#: Names that operators use, or once used, for columns of their own.
OWN_NAMES = (
    "_ca _cb _class class_a class_b class_of key_a key_b _doc _mark _covered doc mark covered _found found _jumped jumped _sure sure "
    "first before row scored logs seen _row _s learner"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and that with this from river stone light water house under night morning thought through three".split(),
    "de": "der die und das nicht mit einer schule strasse freund zwischen licht wasser haus nacht morgen durch drei".split(),
    "es": "el la los que con una calle amigo entre luz agua casa noche siempre nunca por cuando tres".split(),
}


def sentence(rng, lang="en", n=12):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def row(key, text, lang="en", source="s"):
    return (key, text, lang, source, None if text is None else len(text))


def odd_rows():
    """Nulls in any column, empty texts, repeated rows, no letters, one very long text."""
    rng = random.Random(1)
    long_text = "\n".join(sentence(rng, n=15) for _ in range(4000))
    return [
        row(1, None), row(2, ""), row(3, ""), row(None, "a river under the stone"), row(None, None),
        (4, "night and water", None, None, None), row(5, "12 345 !!"), row(6, "x"), row(6, "x"), row(6, "y"),
        row(7, long_text), row(8, "naïve 日本語 🙂 text with\nthree\nlines\n"),
    ]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def clashing(docs):
    """More columns, with names that operators use themselves."""
    from pyspark.sql import functions as F

    more = {name: F.lit(i) for i, name in enumerate(OWN_NAMES)}
    return docs.selectExpr("*", "'kept' AS shard", "1 AS bucket", "2 AS a", "3 AS b", "'v' AS id").withColumns({"class_id": F.lit("old"), **more})
