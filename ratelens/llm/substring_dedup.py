"""Repeated word sequences, found by level-wise doubling, and texts without their later occurrences.

A window is so many consecutive words of one text. A window can only be repeated if both its halves are, so the levels double: windows
that are repeated at one length alone are extended to twice that length, until no candidates survive or the asked
length is decided.

* First level, half the asked length (25 words for 50): one window stands for many. Of the 26 windows of 25 words inside 50 words the
  one with the smallest hash is the anchor; it depends on those 50 words alone, so equal stretches of 50 words have
  equal anchors. Only anchors are counted, about one position in 13.
* Asked length: windows whose anchor is repeated are hashed (128 bits) and counted over all texts.
* Further levels: two repeated windows that follow each other make a candidate of twice the length, until no candidate survives.

What is removed is decided by the repeated windows of all levels, from the asked length to the longest repeated one.

Counting is a map-side combined minimum and maximum of the document id for each hash, never a list of a window's places; a window
that a third of all texts hold is one row of it. Texts that equal one with a smaller id are whole repeats, so only the first of equal texts
goes through the levels.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, replaced, text_key, text_or_empty, told_apart
from ratelens.llm.words import per_slice, split_by, split_words
from ratelens.session import drop_materialized, materialize

#: Words of a window that counts as a repeat.
WINDOW = 50

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Windows:
    """Hashes of the windows of several texts that lie one behind the other."""

    def __init__(self, texts: pd.Series):
        split = [split_words(t) for t in texts]
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.token = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, n)
        self.end = np.repeat(self.begin + self.sizes, self.sizes)

    def hashes(self, size: int, way: int) -> np.ndarray:
        """The hash of the window at each place where one of `size` words begins, also of those that leave their text."""
        n = len(self.token)
        power = np.full(n + 1, _BASES[way], np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        inverse = np.full(n + 1, pow(int(_BASES[way]), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        token = self.token if way == 0 else _mix(self.token + np.uint64(way))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token * power[:n])])
        return _mix(_mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1]))

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows of `size` words inside their texts, the place of each one's anchor, and the anchors' hashes by place."""
        half = size // 2
        if len(self.token) < size:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        value = self.hashes(half, 0)
        best, width, wanted = np.arange(len(value)), 1, size - half + 1
        while width < wanted:  # the leftmost smallest of the first `width` places from each one on
            step = min(width, wanted - width)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(value[left] <= value[right], left, right)
            width += step
        start = np.flatnonzero(np.arange(len(best)) + size <= self.end[: len(best)])
        return start, best[start], value


def _anchors(size: int):
    """Work on slices of texts: the distinct anchors of each text, as (place in the text, hash)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        windows = _Windows(frame["c0"])
        _, anchor, value = windows.anchors(size)
        place = np.unique(anchor)
        owner = np.searchsorted(windows.begin, place, side="right") - 1
        sizes = np.bincount(owner, minlength=len(windows.sizes))
        at, h = place - windows.begin[owner], value[place].view(np.int64)
        return pd.DataFrame({"at": split_by(at.astype(np.int32), sizes), "h": split_by(h, sizes)})

    return work


def _candidates(size: int):
    """Work on slices of texts and their surviving anchors: the windows with such an anchor, as (place in the text, 128-bit hash)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        windows = _Windows(frame["c0"])
        start, anchor, _ = windows.anchors(size)
        survives = np.zeros(len(windows.token) + 1, bool)
        for begin, places in zip(windows.begin, frame["c1"]):
            survives[begin + np.asarray(places, np.int64)] = True
        start = start[survives[anchor]]
        owner = np.searchsorted(windows.begin, start, side="right") - 1
        sizes = np.bincount(owner, minlength=len(windows.sizes))
        found = {"at": split_by((start - windows.begin[owner]).astype(np.int32), sizes)}
        for way, name in enumerate(("a", "b")):
            h = windows.hashes(size, way)[start] if len(start) else np.empty(0, np.uint64)
            found[name] = split_by(h.view(np.int64), sizes)
        return pd.DataFrame(found)

    return work


def _doubled(size: int):
    """Work on texts' repeated windows of `size` words: candidates of twice the size, from two that follow each other."""

    def one(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(at)
        at, a, b = at[order], a[order].view(np.uint64), b[order].view(np.uint64)
        next_at = np.searchsorted(at, at + size).clip(max=len(at) - 1)
        first = np.flatnonzero(at[next_at] == at + size)
        joined = [_mix(_mix(h[first]) * _BASES[way] + h[next_at[first]]).view(np.int64) for way, h in enumerate((a, b))]
        return at[first], *joined

    def work(frames: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [one(np.asarray(x, np.int32), np.asarray(y, np.int64), np.asarray(z, np.int64)) for x, y, z in zip(frames, a, b)]
        return pd.DataFrame({name: pd.Series([f[i] for f in found], dtype=object) for i, name in enumerate(("at", "a", "b"))})

    work.__annotations__ = {"frames": pd.Series, "a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(work, "at array<int>, a array<long>, b array<long>")


def _first_copies(keyed: DataFrame) -> DataFrame:
    """(mark, first): the smallest document of each text that several documents hold.

    Two texts with one 64-bit mark are told apart by the second and then are no copies of each other here.
    """
    grouped = keyed.groupBy("mark").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("other"), F.max("other"))
    alike = F.col("min(other)") == F.col("max(other)")
    return materialize(grouped.where((F.col("first") < F.col("last")) & alike).select("mark", "first"))


def _survivors(windows: DataFrame, texts_differ: bool = False) -> DataFrame:
    """(keys, first) as a written table: the windows (doc, keys) that start in more than one document, and the smallest of these."""
    keys = [c for c in windows.columns if c not in ("doc", "mark", "at")]
    ends = [F.min("doc").alias("first"), F.max("doc").alias("last")]
    marks = [F.min("mark").alias("low"), F.max("mark").alias("high")] if texts_differ else []
    grouped = windows.groupBy(*keys).agg(*ends, *marks).where(F.col("first") < F.col("last"))
    if texts_differ:
        grouped = grouped.where(F.col("low") < F.col("high"))
    return materialize(grouped.select(*keys, "first"))


def repeated_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WINDOW, longest: int | None = WINDOW) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """The first copies, as (mark, first), and for each level from `words` on its length and its table (doc, mark, at, a, b, later).

    A level's table has one row for each text with repeated windows of that length: their places, hashes, and
    whether a smaller document has the same window. Levels double until no candidate survives, or until
    `longest` words are decided. `words` is 2 at least.
    """
    if words < 2:
        raise ValueError("a window has two words at least")
    mark, other = text_key(F.col(f"`{text}`"))
    keyed = docs.where(F.col(f"`{id}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{id}`").alias("doc"), mark.alias("mark"), other.alias("other"), F.col(f"`{text}`").alias("text")
    )
    copies = _first_copies(keyed)
    found = per_slice(_anchors(words), "at array<int>, h array<long>", F.col("text"))
    listed = keyed.select("doc", "mark", found.alias("w"))
    anchors = materialize(listed.select("doc", "mark", F.explode(F.arrays_zip("w.h", "w.at")).alias("w")).select("doc", "mark", "w.h", "w.at"))
    # Copies of one text alone do not make its anchors candidates.
    repeated = _survivors(anchors, texts_differ=True)
    places = anchors.join(repeated.select("h"), "h").join(copies, "mark", "left").where(F.col("first").isNull() | (F.col("doc") == F.col("first")))
    places = places.groupBy("doc", "mark").agg(F.collect_set("at").alias("places"))
    met = keyed.select("doc", "mark", "text").join(places, ["doc", "mark"])
    kind = "at array<int>, a array<long>, b array<long>"
    candidates = materialize(met.select("doc", "mark", per_slice(_candidates(words), kind, F.col("text"), F.col("places")).alias("w")))
    drop_materialized(anchors)
    levels, size = [], words
    while True:
        windows = candidates.select("doc", "mark", F.explode(F.arrays_zip("w.at", "w.a", "w.b")).alias("w")).select("doc", "mark", "w.at", "w.a", "w.b")
        known = _survivors(windows.drop("at"))
        row = F.collect_set(F.struct("at", "a", "b", (F.col("first") < F.col("doc")).alias("later")))
        level = windows.join(known, ["a", "b"]).groupBy("doc", "mark").agg(row.alias("w"))
        level = materialize(level.select("doc", "mark", "w.at", "w.a", "w.b", "w.later"))
        levels.append((size, level))
        if longest is not None and size >= longest:
            break
        drop_materialized(candidates)
        candidates = materialize(level.select("doc", "mark", _doubled(size)("at", "a", "b").alias("w")).where(F.size("w.at") > 0))
        size *= 2
        if candidates.isEmpty():
            break
    drop_materialized(candidates)
    return copies, levels


def _without(words: int):
    """Work on texts, the places of their later windows by length (null: none) and whether they are later copies: number of words, and the words kept."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        sizes, gone, texts = [], [], []
        for text, levels, copy in zip(frame["c0"], frame["c1"], frame["c2"]):
            own = split_words(text)
            if copy and len(own) >= words:
                kept = []
            elif levels is not None and len(levels):
                depth = np.zeros(len(own) + 1, np.int32)
                for level in levels:
                    at = np.asarray(level["places"], np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + level["size"], -1)
                kept = list(compress(own, (np.cumsum(depth)[:-1] == 0).tolist()))
            else:
                kept = own
            sizes.append(len(own))
            gone.append(len(own) - len(kept))
            texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"n_words": np.array(sizes, np.int64), "n_removed": np.array(gone, np.int64), "kept": pd.Series(texts, dtype=object)})

    return work


def remove_repeated_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WINDOW) -> DataFrame:
    """All rows and columns, plus `n_words`, `n_removed` and `kept`: the words, joined by one space, that no later window covers.

    A window is later if its word sequence also starts in a document with a smaller id. Windows have `words` words and, level by level, twice as
    many until no longer one is repeated. They are judged on the texts as given. Words are
    what lies between blanks (space, tab, line feed, vertical tab, form feed, carriage return). Texts of fewer words have no window and keep all.
    A null text has no words and null as `kept`. A row without id loses nothing and makes no other row lose anything. Rows with the
    same id are one document in the comparison: none of them is later than another, whatever its text. An
    empty table gives an empty one. Columns named like the new ones are replaced. A text of any length is one task's work.
    """
    docs, old = told_apart(docs, id, text)
    copies, levels = repeated_windows(docs, id, text, words, longest=None)
    places = F.transform(F.filter(F.arrays_zip("at", "later"), lambda w: w["later"]), lambda w: w["at"])
    found = [level.select("doc", "mark", F.struct(F.lit(size).alias("size"), places.alias("places")).alias("w")).where(F.size("w.places") > 0) for size, level in levels]
    later = reduce(DataFrame.unionByName, found).groupBy("doc", "mark").agg(F.collect_list("w").alias("places"))
    mark = text_key(F.col(f"`{text}`"))[0]
    copied = docs.select(F.col(f"`{id}`").alias("doc"), mark.alias("mark")).join(copies, "mark").where(F.col("doc") > F.col("first"))
    gone = later.select("doc", "mark", "places", F.lit(False).alias("copy"))
    nothing = F.lit(None).cast("array<struct<size:int,places:array<int>>>")
    gone = gone.unionByName(copied.distinct().select("doc", "mark", nothing.alias("places"), F.lit(True).alias("copy")))
    names = fresh(docs, "other_doc", "other_mark", "places", "copy")
    gone = materialize(gone).toDF(*names)
    # Merged at every size: the removals grow with the corpus, so they are never broadcast.
    joined = docs.join(gone.hint("merge"), (F.col(f"`{id}`") == F.col(names[0])) & (mark == F.col(names[1])), "left")
    done = per_slice(_without(words), "n_words long, n_removed long, kept string", text_or_empty(text), F.col(names[2]), F.coalesce(F.col(names[3]), F.lit(False)))
    out = replaced(joined, kept=done).drop(*names)
    kept: Column = F.when(F.col(f"`{text}`").isNotNull(), F.col("kept.kept"))
    out = replaced(out, n_words=F.col("kept.n_words"), n_removed=F.col("kept.n_removed"), kept=kept)
    return out.toDF(*[old.get(c, c) for c in out.columns])
