"""Review text per item, cleaned text and term frequencies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, Normalizer, StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions import text as T
from ratelens.operators.ordinals import group_rank

# Tokens left out of the term frequencies, and the vocabulary size.
RATING_WORDS = ("10", "12")
VOCABULARY_SIZE = 100


def text_by_item(
    df: DataFrame, item: str, text: str, order: list[str], texts_per_row: int = 1000
) -> DataFrame:
    """Texts of an item joined in order, as (item, part, text) rows.

    An item with up to `texts_per_row` texts gives one row, part 0. A larger one goes on in
    parts 1, 2, ..., so that no row and no task has to hold an unbounded item; nothing is
    left out. `order` must identify a text within its item. Only the keys are ranked; the
    texts move once, to their part.
    """
    keys = df.select(item, *order)
    placed = group_rank(keys, [item], [F.col(c) for c in order], name="_place")
    parts = placed.withColumn("part", F.floor((F.col("_place") - 1) / texts_per_row).cast("int"))
    return (
        df.select(item, *order, F.col(text).alias("_text"))
        .join(parts, [item, *order])
        .groupBy(item, "part")
        .agg(F.expr("listagg(_text, '') WITHIN GROUP (ORDER BY _place)").alias(text))
    )


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def clean_text(
    df: DataFrame,
    text: str,
    stop_words: Iterable[str] | None = None,
    dictionary: dict[str, str] | None = None,
    pattern: str = T.WORD_PATTERN,
    name: str = "clean",
) -> DataFrame:
    """Lower-case, tokenize, drop stop words, replace by lemma, join with spaces; row by row."""
    words = english_stop_words() if stop_words is None else stop_words
    kept = T.without_words(T.tokens(text, pattern), words)
    return df.withColumn(name, T.joined(T.lemmas(kept, dictionary or {})))


def lemmatize_by_table(df: DataFrame, key: str, token_array: str, dictionary: DataFrame) -> DataFrame:
    """Replace tokens by a dictionary table (token, lemma) of any size, keeping their order.

    The regrouping holds one text at a time.
    """
    exploded = df.select(key, F.posexplode(token_array).alias("_pos", "token"))
    replaced = exploded.join(dictionary, "token", "left").select(
        key, "_pos", F.coalesce("lemma", "token").alias("_word")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_word")))
    regrouped = replaced.groupBy(key).agg(F.transform(ordered, lambda s: s["_word"]).alias("_lemmas"))
    empty = F.array().cast("array<string>")
    return (
        df.join(regrouped, key, "left")
        .withColumn(token_array, F.coalesce("_lemmas", empty))
        .drop("_lemmas")
    )


def term_occurrences(df: DataFrame, key: str, text: str, drop_words: Iterable[str], pattern: str) -> DataFrame:
    """One row per one- or two-word term in reading order, over whole texts."""
    words = T.without_words(T.tokens(text, pattern), drop_words)
    return df.select(key, words.alias("_words")).select(
        key, F.explode(T.unigrams_and_bigrams(F.col("_words"))).alias("term")
    )


def vocabulary(occurrences: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The most frequent terms, by total count and then by term."""
    counts = occurrences.groupBy("term").agg(F.count("*").alias("total"))
    return counts.orderBy(F.desc("total"), "term").limit(size)


def term_frequency(
    df: DataFrame,
    key: str,
    text: str,
    size: int = VOCABULARY_SIZE,
    drop_words: Iterable[str] = RATING_WORDS,
    pattern: str = T.WORD_PATTERN,
) -> DataFrame:
    """(key, term, tf) over the top terms; the tf of a key have Euclidean length 1.

    Several rows may share a key: their counts add up, so an item's reviews need not be
    joined into one text first. The texts are read twice: counting by term alone and then
    only the listed terms by key moves far less than all counts by key and term.
    """
    occurrences = term_occurrences(df, key, text, drop_words, pattern)
    listed = F.broadcast(vocabulary(occurrences, size).select("term"))  # at most `size` rows
    counts = occurrences.join(listed, "term").groupBy(key, "term").agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))  # at most `size` rows each
    return counts.select(key, "term", (F.col("n") / length).alias("tf"))


def term_table(frequencies: DataFrame, key: str, terms: list[str], keys: DataFrame | None = None) -> DataFrame:
    """One column per term; with `keys`, keys without any listed term get zeros."""
    wide = frequencies.groupBy(key).pivot("term", terms).agg(F.first("tf"))
    if keys is not None:
        wide = keys.select(key).distinct().join(wide, key, "left")
    return wide.na.fill(0.0, terms)


def term_features(
    df: DataFrame,
    key: str,
    text: str,
    size: int = VOCABULARY_SIZE,
    drop_words: Iterable[str] = RATING_WORDS,
    pattern: str = T.WORD_PATTERN,
) -> tuple[DataFrame, list[str]]:
    """The term frequencies as one row per key and one column per listed term, with the term names."""
    listed = vocabulary(term_occurrences(df, key, text, drop_words, pattern), size).select("term")
    terms = [r["term"] for r in listed.orderBy("term").collect()]  # at most `size` names
    return term_table(term_frequency(df, key, text, size, drop_words, pattern), key, terms, df), terms


def term_vector_model(
    df: DataFrame,
    text: str,
    size: int = VOCABULARY_SIZE,
    drop_words: Iterable[str] = RATING_WORDS,
    pattern: str = T.WORD_PATTERN,
) -> tuple[PipelineModel, DataFrame]:
    """Sparse unit-length term vectors for Spark ML, with the model that names their positions."""
    words = T.without_words(T.tokens(text, pattern), drop_words)
    prepared = df.withColumn("terms", T.unigrams_and_bigrams(words))
    model = Pipeline(
        stages=[
            CountVectorizer(inputCol="terms", outputCol="term_counts", vocabSize=size),
            Normalizer(inputCol="term_counts", outputCol="term_vector", p=2.0),
        ]
    ).fit(prepared)
    return model, model.transform(prepared).drop("terms", "term_counts")


def review_texts_to_tokens(
    reviews: DataFrame,
    item: str,
    text: str,
    order: list[str],
    stop_words: Iterable[str] | None = None,
    dictionary: dict[str, str] | None = None,
    texts_per_row: int = 1000,
) -> DataFrame:
    """Text per item, then cleaned."""
    joined = text_by_item(reviews, item, text, order, texts_per_row)
    return clean_text(joined, text, stop_words, dictionary)
