"""Periodic runs in texts, found with a dictionary of basic factors, and texts with each run collapsed to one period.

The basic factors are the stretches of 1, 2, 4, ... words. Factors of one length with the same words of the same text
get the same name; those of twice the length are named by the pair of names of their halves, and only positions
whose two halves both occur again in the text are looked at, so a text without repetition ends after a few
lengths. At length L the next occurrence of a factor at a distance d of L/2 < d <= L proposes the period d: both
occurrences lie within twice the length and overlap or touch, so the words of both have period d, and since the
occurrence is the next one, no smaller period. Positions that follow each other with the same d are an
arithmetic progression of occurrences; a progression from i to j extends to the stretch from i to j + L + d,
and no further: the word beyond would have given one more position. A period lies in (L/2, L] for one L
only, and a run of at least three periods gives one progression there, so each run is proposed once.
"""

from __future__ import annotations

from itertools import chain, compress, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import replaced, text_or_empty
from ratelens.llm.words import per_slice, split_by, split_words

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3

_KIND = "starts array<long>, lengths array<long>, periods array<long>, n_words long, collapsed string"


def find_runs(words: list[bytes], sizes: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start in `words`, length, period) of all runs, by start and period, in consecutive texts of `sizes` words.

    No run reaches from one text into the next. `least_periods` is 3 at least: three periods hold two factors of
    a power of two up to twice the period.
    """
    n = len(words)
    ids = np.fromiter(map({}.setdefault, words, count()), np.int64, n)  # the place of a word's first occurrence
    text = np.repeat(np.arange(len(sizes)), sizes)
    end, own = np.repeat(np.cumsum(sizes), sizes), np.repeat(sizes, sizes)
    at, key = np.arange(n), text * n + ids
    name = np.full(n, -1, np.int64)
    length, found = 1, [np.empty((0, 3), np.int64)]
    while len(at):
        order = np.argsort(key, kind="stable")
        place, same = at[order], np.diff(key[order]) == 0
        distance = np.diff(place)
        near = same & (distance > length // 2) & (distance <= length)
        period = np.zeros(n, np.int64)
        period[place[:-1][near]] = distance[near]
        edge = np.flatnonzero(np.diff(period, prepend=0, append=0))
        first, last = edge[:-1], edge[1:] - 1  # stretches of the same period; those of 0 lie between them
        d = period[first]
        size = last - first + d + length
        long_enough = (d > 0) & (size >= np.maximum(least_words, least_periods * d))
        found.append(np.stack([first, size, d], axis=1)[long_enough])
        # Factors of twice the length: both halves occur again, and a period that they may show fits into the text.
        again = np.append(same, False) | np.insert(same, 0, False)
        name[:] = -1
        name[place[again]] = np.cumsum(np.insert(~same, 0, False))[again]
        at = np.sort(place[again])
        at = at[(at + 2 * length <= end[at]) & (least_periods * (length + 1) <= own[at])]
        at = at[name[at + length] >= 0]
        key = name[at] * n + name[at + length]
        length *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(frame: pd.DataFrame) -> pd.DataFrame:
    split = [split_words(t) for t in frame["c0"]]
    sizes = np.array([len(w) for w in split], np.int64)
    words = list(chain.from_iterable(split))
    least = (int(frame[c].iloc[0]) for c in ("c1", "c2")) if len(frame) else ()
    runs = find_runs(words, sizes, *least)
    begin = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begin, runs[:, 0], side="right") - 1
    per_text = np.bincount(owner, minlength=len(sizes))
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(depth)[:-1] == 0
    texts = [
        b" ".join(compress(own, keep[a : a + len(own)].tolist()) if k else own).decode("utf-8", "surrogatepass")
        for own, a, k in zip(split, begin, per_text)
    ]
    columns = [runs[:, 0] - begin[owner], runs[:, 1], runs[:, 2]]
    named = dict(zip(("starts", "lengths", "periods"), (split_by(c, per_text) for c in columns)))
    return pd.DataFrame({**named, "n_words": sizes, "collapsed": pd.Series(texts, dtype=object)})


def with_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """All rows and columns, plus `n_words`, `runs` and `collapsed`.

    Words are what lies between blanks (space, tab, line feed, vertical tab, form feed, carriage return). `runs` is an array of (start,
    length, period), by start and period: stretches of words with that smallest period, at least `least_words` words and
    `least_periods` (3 or more) periods long, which no neighbouring word continues. `collapsed` is the text's words that
    no run holds after its first period, joined by one space.

    A null text has no words, no run and null as `collapsed`; an empty text or one of blanks alone has an empty one. Rows are
    looked at one by one, so repeated rows are treated alike, nulls in other columns do not matter, and an empty table
    gives an empty one. A text of any length is one task's work, n log n in its words. Columns named like the new ones are replaced.
    """
    if least_periods < 3:
        raise ValueError("a run has three periods at least")
    found = per_slice(_collapse, _KIND, text_or_empty(text), F.lit(least_words), F.lit(least_periods))
    held = replaced(docs, runs=found)
    parts = F.transform(
        F.arrays_zip("runs.starts", "runs.lengths", "runs.periods"),
        lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")),
    )
    collapsed = F.when(F.col(f"`{text}`").isNotNull(), F.col("runs.collapsed"))
    return replaced(held, n_words=F.col("runs.n_words"), runs=parts, collapsed=collapsed)


def by_exponent(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period. Null without a run."""

    def compare(x: Column, y: Column) -> Column:
        one, other = x["length"] * y["period"], y["length"] * x["period"]
        later = (x["start"] > y["start"]) | ((x["start"] == y["start"]) & (x["period"] > y["period"]))
        same = (x["start"] == y["start"]) & (x["period"] == y["period"])
        return F.when(one != other, F.when(one > other, -1).otherwise(1)).otherwise(F.when(same, 0).when(later, 1).otherwise(-1))

    return F.get(F.array_sort(runs, compare), 0)


def with_tail_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of which a tenth, by the crc32 of the id, end in a stretch that repeats with a period: test material.

    With h the unsigned crc32 of the id as text (null: an empty one) and g = h div 10, a text of n > 0 words with h mod 10 = 0 has from
    word a = g mod n on the words a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8), and single spaces. Others stay as they are.
    """
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    split = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def repeated(s: Column) -> Column:
        words, n, g = s["words"], F.size(s["words"]), s["g"]
        a = g % n

        def one(i: Column) -> Column:
            p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
            return F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))

        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), " ")

    given = F.array(F.struct(split.alias("words"), F.floor(h / 10).alias("g")))
    changed = F.get(F.transform(given, lambda s: F.when(F.size(s["words"]) > 0, repeated(s)).otherwise(F.col(text))), 0)
    return replaced(docs, **{text: F.when((h % 10 == 0) & F.col(text).isNotNull(), changed).otherwise(F.col(text))})
