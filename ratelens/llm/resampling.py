"""Importance resampling towards a target distribution: hashed n-gram weights and Gumbel top-k, with lines counted once.

Features are all runs of 1 to 3 consecutive words of a text, hashed into buckets. A bucket's gain is the log of its share in
the target against its share in the corpus (add-one), a text's weight the sum of its features' gains; the
highest of weight + Gumbel noise are drawn, which is sampling without replacement in proportion to exp(weight).

Line feeds part words, so a text is cut into lines and every feature lies within one line or crosses lines. Equal lines of the
whole corpus are gathered; the buckets of a distinct line are worked out and written once, and count as often
as the line occurs. Features across lines, at most three for each line, are found text by text and added. Weights
take the same way back: the sum of gains of a distinct line is worked out once and joined to the line's occurrences.

Nothing grows with the corpus on the driver or in a broadcast: the histogram and the gains have one number for each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, replaced, text_key, text_or_empty, told_apart
from ratelens.llm.words import per_slice, slices, split_by
from ratelens.operators.ordinals import with_ordinal
from ratelens.session import materialize

BUCKETS = 10_000
LONGEST = 3
#: Texts with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 5

#: A to Z in lower case; what is no digit, letter or byte of a longer character becomes a blank, but line feeds stay.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256)
)


def _prepared(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)


def _line_buckets(lines: pd.Series, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all features inside each line, line by line; the lines' numbers of features and of words."""
    split = [_prepared(x).split() for x in lines]
    sizes = np.array([len(w) for w in split], np.int64)
    words = list(chain.from_iterable(split))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    going_on = [b" " + w for w in words]
    values, owners = [], []
    crc = np.fromiter(map(crc32, words), np.int64, len(words))
    for n in range(1, LONGEST + 1):
        if n > 1:  # the crc of an n-gram goes on from that of its first n - 1 words
            crc = np.fromiter(map(crc32, going_on[n - 1 :], crc.tolist()), np.int64, max(0, len(words) - n + 1))
        inside = owner[n - 1 :] == owner[: len(crc)]
        values.append(crc[inside] % buckets)
        owners.append(owner[: len(crc)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(values)[order], np.bincount(owner, minlength=len(sizes)), sizes


def _crossing(text: str, buckets: int) -> tuple[int, list[int]]:
    """Number of words of the text, and the buckets of its features that begin in one line and end in a later one."""
    found, before, n = [], [], 0
    for line in _prepared(text).split(b"\n"):
        words = line.split()
        if not words:
            continue
        n += len(words)
        if before:
            pair = crc32(b" " + words[0], crc32(before[-1]))
            found.append(pair % buckets)
            if len(words) > 1:
                found.append(crc32(b" " + words[1], pair) % buckets)
            if len(before) > 1:
                found.append(crc32(b" " + words[0], crc32(b" " + before[-1], crc32(before[-2]))) % buckets)
        before = (before + words)[-2:] if len(words) < 2 else words[-2:]
    return n, found


@dataclass
class Features:
    """Written tables. `texts`: all rows and columns but the text, with the names below; `lines`: (a, b, times, n_features, buckets)."""

    texts: DataFrame
    lines: DataFrame
    buckets: int
    #: Names in `texts`: row number, words, buckets of features across lines, keys of the lines.
    row: str
    words: str
    crossing: str
    marks: str


def features(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> Features:
    """Both tables of the texts; a null text has no features."""
    if not 0 < buckets <= 1 << 15:
        raise ValueError("buckets are kept in two bytes: at most 32768")

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        found = [_crossing(t, buckets) for t in frame["c0"]]
        return pd.DataFrame({"n": [n for n, _ in found], "crossing": pd.Series([c for _, c in found], dtype=object)})

    row, words, crossing, marks, found = fresh(docs, "row", "words", "crossing", "marks", "found")
    split = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda line: line != "")

    def keys(line: Column) -> Column:
        a, b = text_key(line)
        return F.struct(a.alias("a"), b.alias("b"))

    own = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text],
        F.monotonically_increasing_id().alias(row),
        F.coalesce(F.transform(split, keys), F.array().cast("array<struct<a:bigint,b:bigint>>")).alias(marks),
        per_slice(edges, "n long, crossing array<smallint>", text_or_empty(text)).alias(found),
    )
    texts = materialize(replaced(own, **{words: F.col(f"{found}.n"), crossing: F.col(f"{found}.crossing")}).drop(found))

    def inside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in slices(frame, "line"):
                values, n_features, _ = _line_buckets(part["line"], buckets)
                kept = part[["a", "b", "times"]].reset_index(drop=True)
                yield kept.assign(n_features=n_features, buckets=split_by(values.astype(np.int16), n_features))

    a, b = text_key(F.col("line"))
    distinct = docs.select(F.explode(split).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    keyed = distinct.select(a.alias("a"), b.alias("b"), "times", "line")
    lines = keyed.mapInPandas(inside, "a long, b long, times long, n_features long, buckets array<smallint>")
    return Features(texts, materialize(lines), buckets, row, words, crossing, marks)


def histogram(given: Features) -> np.ndarray:
    """How many features of all texts fall into each bucket: lines' buckets times their occurrences, and those across lines."""
    buckets = given.buckets

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for frame in frames:
            if len(frame):
                # Whole numbers throughout: lines that occur equally often are counted together.
                for times, own in frame.groupby("times")["buckets"]:
                    total += int(times) * np.bincount(np.concatenate(own.to_list()).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    once = given.texts.select(F.lit(1).cast("long").alias("times"), F.col(given.crossing).alias("buckets"))
    parts = given.lines.select("times", "buckets").unionAll(once).where(F.size("buckets") > 0)
    sums = parts.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # one row a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths: floor(1000 ln of the add-one share in the target over that in the corpus)."""
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def weigh(given: Features, gain: np.ndarray, n_features: str = "n_features", weight: str = "weight") -> DataFrame:
    """`given.texts` without the arrays, plus the number of features of each text and the sum of their gains."""
    shared = given.texts.sparkSession.sparkContext.broadcast(gain)

    def total(parts: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in parts], np.int64)
        if not sizes.sum():
            return pd.Series(np.zeros(len(sizes), np.int64))
        values = shared.value[np.concatenate(parts.to_list()).astype(np.int64)]
        return pd.Series(np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(sizes)])]))

    total.__annotations__ = {"parts": pd.Series, "return": pd.Series}
    summed = F.pandas_udf(total, "long")
    own = materialize(given.lines.where("n_features > 0").select("a", "b", "n_features", summed("buckets").alias("gain")))
    # Written tables on both sides: a line that a third of all texts hold is split over tasks in the join.
    at = given.texts.select(F.col(given.row).alias("row"), F.explode(given.marks).alias("m")).select("row", "m.a", "m.b")
    sums = at.join(own, ["a", "b"]).groupBy("row").agg(F.sum("n_features").alias("n"), F.sum("gain").alias("gain"))
    names = dict(zip(("n", "gain", "other"), fresh(given.texts, "n", "gain", "other")))
    sums = sums.select(F.col("row").alias(names["other"]), F.col("n").alias(names["n"]), F.col("gain").alias(names["gain"]))
    joined = given.texts.join(sums, F.col(given.row) == F.col(names["other"]), "left")
    none = F.lit(0).cast("long")
    out = replaced(
        joined,
        **{
            n_features: F.coalesce(F.col(names["n"]), none) + F.size(given.crossing),
            weight: F.coalesce(F.col(names["gain"]), none) + summed(F.col(given.crossing)),
        },
    )
    return out.drop(given.crossing, given.marks, *names.values())


def gumbel_noise(key: str, seed: int = 42) -> Column:
    """floor(-1000 ln(-ln u)) as long, u from the first 32 bits of sha256(`seed:key`); a missing key counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = 42,
) -> DataFrame:
    """All rows and columns but the text, plus `n_features`, `weight`, `score` and `rank` (longs).

    Of the N texts with at least `least_words` words the floor(percent N / 100) of highest score get the ranks 1, 2, 3, ...; ties go to the smaller key,
    a missing key first. All others have a null rank. A null or empty text, or one without words, has no features and weight 0 and is
    never drawn. Rows that repeat are drawn one by one, and as their noise depends on the key alone they have the same score. An empty table gives an
    empty one; an empty target leaves all gains to the corpus. Columns of the new names are replaced. The words and
    features of a text of any length are one task's work; its lines are spread out.
    """
    if text.lower() == key.lower():
        raise ValueError("key and text are two columns")
    docs, old = told_apart(docs, key, text)
    given = features(docs, text, buckets)
    gain = gains(histogram(given), histogram(features(target.select(target_text), target_text, buckets)))
    weighed = weigh(given, gain)
    scored = replaced(weighed, score=F.col("weight") + gumbel_noise(key, seed))
    fit = F.col(given.words) >= least_words
    place, able = fresh(scored, "place", "able")
    placed = with_ordinal(
        scored.withColumn(able, fit), F.col(able).desc(), F.col("score").desc(), F.col(f"`{key}`").asc_nulls_first(), given.row, name=place
    )
    n = placed.where(able).count() * percent // 100
    rank = F.when(F.col(able) & (F.col(place) < n), F.col(place) + 1)
    out = replaced(placed, rank=rank).drop(place, able, given.row, given.words)
    return out.toDF(*[old.get(c, c) for c in out.columns])
