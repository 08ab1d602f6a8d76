"""Language of a text: multinomial naive Bayes over hashed character n-grams.

The classifier is fitted on at most about `rows_per_language` labelled texts of each language (a documented
bound; the class priors count all labelled rows). Its matrix of log probabilities, at most 2^24 numbers, is
broadcast. Whole texts are scored in numpy, batch by batch: the places of a batch's n-grams in the
matrix are looked up and summed per text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, replaced

#: Texts of each language that the classifier is fitted on, in expectation.
ROWS_PER_LANGUAGE = 5_000
#: Lengths of the n-grams.
ORDERS = (1, 2, 3, 4)
#: Entries of the matrix at most (languages x positions); more languages get fewer positions.
MATRIX_ENTRIES = 1 << 24
MOST_POSITIONS = 1 << 16
SMOOTHING = 0.05
#: Texts that a task counts in fitting, about.
ROWS_PER_TASK = 2_500
UNKNOWN = "und"
#: Code points handled at a time, so that very long texts need no more memory than others.
BLOCK = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str], positions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of the texts: the number of each n-gram's text (rising) and its hashed position.

    Letters are in lower case; every run of other characters counts as one blank, as do both ends of a text.
    What a text gives does not depend on the texts beside it.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.cumsum([0, *map(len, lowered)])
    begin = 0
    while begin < len(lowered):
        upto = max(begin + 1, int(np.searchsorted(sizes, sizes[begin] + BLOCK, side="right")) - 1)
        for owner, position in _grams_of(lowered[begin:upto], positions):
            yield owner + begin, position
        begin = upto


def _grams_of(lowered: list[str], positions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 2 for t in lowered])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of blanks, the one after a letter stays
    keep[np.r_[0, ends[:-1]]] = True  # and the blank before a text
    at = np.flatnonzero(keep)
    codes = np.where(letter[at], codes[at], np.uint32(32))
    owners = np.searchsorted(ends, at, side="right")
    longest = max(ORDERS)
    for first in range(0, len(codes), BLOCK):
        part, owner = codes[first : first + BLOCK + longest - 1], owners[first : first + BLOCK + longest - 1]
        hashed = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if len(part) < n:
                break
            hashed = (hashed[: len(part) - n + 1] ^ part[n - 1 :]) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
            if n not in ORDERS:
                continue
            own = slice(0, min(BLOCK, len(hashed)))  # those that begin in this block
            whole = (owner[: len(hashed)] == owner[n - 1 :])[own]
            if n == 1:
                whole &= part[own] != 32
            mixed = (hashed[own] * np.uint32(0x85EBCA6B)) >> np.uint32(16)
            yield owner[own][whole], mixed[whole] & np.uint32(positions - 1)


@dataclass
class LanguageModel:
    """Log probability of each hashed n-gram (languages x positions) and of each language."""

    languages: list[str]
    log_gram: np.ndarray
    log_prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior probability."""
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = np.tile(self.log_prior, (len(texts), 1))
        for owner, position in _grams(texts, self.log_gram.shape[1]):
            if not len(owner):
                continue
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for i, row in enumerate(self.log_gram):
                total[owner[first], i] += np.add.reduceat(row[position], first, dtype=np.float64)
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        return [self.languages[i] for i in best], 1.0 / share.sum(1)


def fitting_sample(labelled: DataFrame, text: str, lang: str, counted: dict[str, int], rows_per_language: int) -> DataFrame:
    """(lang, text) of about `rows_per_language` rows of each language, of which `counted` has the number of rows."""
    shares = F.create_map(*[F.lit(x) for k, n in counted.items() for x in (k, min(1.0, rows_per_language / n))])
    others = [F.col(f"`{c}`") for c, kind in labelled.dtypes if kind in ("bigint", "int", "string")]
    drawn = F.pmod(F.xxhash64(F.lit("sample"), *others), F.lit(1 << 30)) / float(1 << 30)
    kept = labelled.where(drawn < F.element_at(shares, F.col(lang)))
    # Drawn rows are few; those of one key are a row and its repetitions.
    keyed = kept.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.lit("row"), *others).alias("key"))
    return keyed.dropDuplicates(["lang", "key"]).select("lang", "text")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on labelled texts: rows whose text or language is missing are left out.

    Priors count all labelled rows. Of a language with more than `rows_per_language` rows, a sample by a
    hash of the row is taken: of its columns of whole numbers and texts. Give an id beside the text, so that copies of a
    text are drawn one by one. Rows that agree in all of these columns cannot be told apart: they count once, so that no
    group of them can exceed the bound. No labelled row at all gives a model that answers `und`.
    """
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counted = {r[0]: r[1] for r in labelled.groupBy(F.col(lang)).count().collect()}  # one row per language
    languages = sorted(counted)
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.float32), np.zeros(0))
    positions = MOST_POSITIONS
    while positions * len(languages) > MATRIX_ENTRIES:
        positions //= 2
    if positions < 1024:
        raise ValueError(f"{len(languages)} languages are too many labels for a classifier")
    sample = fitting_sample(labelled, text, lang, counted, rows_per_language)
    tasks = math.ceil(sum(min(n, rows_per_language) for n in counted.values()) / ROWS_PER_TASK)
    index = {k: i for i, k in enumerate(languages)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for name, rows in frame.groupby("lang"):
                own = sums.setdefault(index[name], np.zeros(positions, np.int64))
                for _, position in _grams(list(rows["text"]), positions):
                    own += np.bincount(position, minlength=positions)
        for i, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": np.int32(i), "position": at.astype(np.int32), "n": own[at]})

    parts = sample.repartition(tasks).mapInPandas(count, "lang int, position int, n long")
    # At most languages x positions rows, whatever the size of the corpus.
    sums = parts.groupBy("lang", "position").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(languages), positions), SMOOTHING)
    counts[sums["lang"], sums["position"]] += sums["n"]
    prior = np.array([counted[k] for k in languages], float)
    return LanguageModel(
        languages,
        np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32),
        np.log(prior / prior.sum()),
    )


def language_column(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Struct (lang_pred, score) from the text alone. A null text, or one without a letter, is `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(series: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in series]
        names, score = shared.value.predict(texts)
        return pd.DataFrame({"lang_pred": names, "score": score})

    found = predict(F.col(text))
    lettered = F.col(text).isNotNull() & F.col(text).rlike("\\p{L}")
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(lettered, found).otherwise(nothing)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns, plus `lang_pred` and `score` (columns of these names are replaced).

    An empty table gives an empty one; repeated rows get equal answers; ties go to the first language by name.
    """
    (found,) = fresh(docs, "found")
    marked = docs.withColumn(found, language_column(docs, model, text))
    return replaced(marked, lang_pred=F.col(f"{found}.lang_pred"), score=F.col(f"{found}.score")).drop(found)
