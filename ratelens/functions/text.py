"""Token expressions; a text is always read whole."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of two or more word characters, in any script.
WORD_PATTERN = r"(?U)\w\w+"


def tokens(c: Column | str, pattern: str = WORD_PATTERN) -> Column:
    """Lower-case tokens in reading order."""
    text = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def without_words(token_array: Column, words: Iterable[str]) -> Column:
    listed = sorted(set(words))
    if not listed:
        return token_array
    return F.filter(token_array, lambda t: ~t.isin(listed))


def bigrams(token_array: Column) -> Column:
    """Neighbouring tokens joined by a space."""
    length = F.greatest(F.size(token_array) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(token_array, F.lit(1), length),
        F.slice(token_array, F.lit(2), length),
        lambda left, right: F.concat_ws(" ", left, right),
    )
    return pairs


def unigrams_and_bigrams(token_array: Column) -> Column:
    return F.concat(token_array, bigrams(token_array))


def lemmas(token_array: Column, dictionary: dict[str, str]) -> Column:
    """Replace tokens by a small literal dictionary; a table-sized one goes through a join."""
    if not dictionary:
        return token_array
    lookup = F.create_map(*[F.lit(x) for pair in sorted(dictionary.items()) for x in pair])
    return F.transform(token_array, lambda t: F.coalesce(F.try_element_at(lookup, t), t))


def joined(token_array: Column) -> Column:
    return F.array_join(token_array, " ")
