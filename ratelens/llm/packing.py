"""Token sequences of fixed length: Martello-Toth reduction, then best fit, over the histogram of lengths.

Which lengths share a sequence is decided on the histogram of piece lengths, which has at most `capacity`
entries however many pieces there are. The plan it yields is a short list of patterns: "so many sequences
hold these lengths". The pieces of one length are then numbered in Spark, and the numbers are dealt out to the
patterns. Only the histogram and the plan pass through the driver.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import number_within, replaced, text_or_empty
from ratelens.session import materialize

CAPACITY = 2048
END_ID = 0

# --------------------------------------------------------------------------- the plan


class _Lengths:
    """Counts by length, with the largest remaining length up to a bound."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {k: n for k, n in histogram.items() if n > 0}
        self.sorted = sorted(self.count)

    def upto(self, bound: int, taken: dict[int, int] | None = None) -> int | None:
        """Largest length at most `bound` of which more than `taken` are left."""
        i = bisect_right(self.sorted, bound) - 1
        while i >= 0 and self.count[self.sorted[i]] <= (taken or {}).get(self.sorted[i], 0):
            i -= 1
        return self.sorted[i] if i >= 0 else None

    def least(self, n: int, taken: dict[int, int]) -> list[int]:
        """The n smallest lengths left (fewer if there are not so many)."""
        found: list[int] = []
        for length in self.sorted:
            found += [length] * min(n - len(found), self.count[length] - taken.get(length, 0))
            if len(found) >= n:
                break
        return found

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.count[length] -= times
        self.sorted = [x for x in self.sorted if self.count[x]]


def _dominating(left: _Lengths, item: int, capacity: int) -> tuple[int, ...] | None:
    """A set with `item` that dominates every other feasible set with it, or None if none is found.

    A set dominates another one if the other's members can be put into groups, each no longer than a
    member of its own of the first set. Sets of up to three members are looked at.
    """
    room = capacity - item
    partner = left.upto(room, {item: 1})
    if partner is None:
        return (item,)  # nothing fits beside it
    two = left.least(2, {item: 1})
    if partner == room or len(two) < 2 or sum(two) > room:
        return (item, partner)  # it fills up exactly, or a set holds two at most: the longest partner dominates
    three = left.least(3, {item: 1})
    if len(three) == 3 and sum(three) <= room:
        return None  # sets of four are feasible; they are not looked at
    # Sets hold three at most. The pair of partners dominates if its longer member is the longest that fits at all and its shorter one the longest beside it.
    rest = left.upto(room - partner, {item: 1, partner: 1 + (item == partner)} if item != partner else {item: 2})
    if rest is not None and partner + rest == room:
        longest_short = max((min(x, y) for x in left.sorted if (y := left.upto(room - x, _plus(item, x))) is not None), default=0)
        if longest_short <= rest:
            return (item, partner, rest)
    return None


def _plus(*lengths: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for x in lengths:
        out[x] = out.get(x, 0) + 1
    return out


def reduce_lengths(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences fixed for good as (lengths, times), and the histogram that remains.

    Lengths are visited from the longest; a set that dominates is fixed as often as its members last, as what
    made it dominate (the lengths that exist) stays true meanwhile: removing members only takes rivals away.
    """
    left = _Lengths(histogram)
    fixed: list[tuple[tuple[int, ...], int]] = []
    for item in sorted(left.count, reverse=True):
        while left.count[item]:
            found = _dominating(left, item, capacity)
            if found is None:
                break
            uses = _plus(*found)
            times = min(left.count[x] // n for x, n in uses.items())
            fixed.append((found, times))
            left.take(found, times)
    return fixed, {x: left.count[x] for x in left.sorted}


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: sequences of the same content are filled together."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(content: tuple[int, ...], times: int) -> None:
        room = capacity - sum(content)
        if room not in open_by_room:
            open_by_room[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_by_room[room].append((content, times))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count:
            i = bisect_right(rooms, length - 1)
            if i < len(rooms):  # the fullest sequences with room for it
                room = rooms[i]
                content, times = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[i]
                used = min(times, count)
                if times > used:
                    put(content, times - used)
                put((*content, length), used)
                count -= used
            else:  # new sequences, each filled with this length as far as it goes
                each = capacity // length
                full, over = divmod(count, each)
                if full:
                    put((length,) * each, full)
                if over:
                    put((length,) * over, 1)
                count = 0
    return [x for group in open_by_room.values() for x in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """All sequences as (lengths, times): those fixed by the reduction, then best fit for the rest."""
    fixed, rest = reduce_lengths(histogram, capacity)
    return fixed + best_fit(rest, capacity)


# --------------------------------------------------------------------------- placing pieces


def _dealt(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of its numbers: first number, sequence of the first, place in the sequence."""
    used: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            runs.setdefault(length, []).append((at, first, offset))
            used[length] = at + times
            offset += length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def place(pieces: DataFrame, key: str, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`key` (which identifies a piece), `sequence_id` and `offset` of every piece.

    Lengths run from 1 to `capacity`; others raise an error. An empty table gives an empty one. Which of
    the pieces of one length goes where is arbitrary but the same in every run.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most `capacity` rows
    if any(x is None or not 0 < x <= capacity for x in histogram):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    runs = pieces.sparkSession.sparkContext.broadcast(_dealt(plan(histogram, capacity)))
    numbered = number_within(pieces.select(key, length), [length], [key], "_number", rows=sum(histogram.values()))

    @F.pandas_udf("sequence_id long, offset long")
    def locate(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        sizes, wanted = lengths.to_numpy(), numbers.to_numpy()
        for x in np.unique(sizes):
            own = sizes == x
            starts, first, at = runs.value[int(x)]
            i = np.searchsorted(starts, wanted[own], side="right") - 1
            sequence[own], offset[own] = first[i] + wanted[own] - starts[i], at[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = numbered.withColumn("_at", locate(F.col(length).cast("long"), F.col("_number")))
    return at.select(key, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


# --------------------------------------------------------------------------- documents


@cache
def _encoding(name: str):
    """The vocabulary `name` as tiktoken holds it: the ids are those of the tokenizers file of the same name,
    at a fifth of its time (compared on the test documents)."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def _plain_tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(f"{name}.json")))


def _token_ids(text: str, vocabulary: str) -> list[int]:
    """The ids of a text. Runs of very many blanks are more than the pattern matching of tiktoken can go back over, which it says
    by a ValueError; such a text is left to the tokenizers library whole."""
    try:
        return _encoding(vocabulary).encode(text, allowed_special="all")
    except ValueError:
        return _plain_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids


def token_pieces(
    docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", width: int = 4
) -> DataFrame:
    """One row per piece: id, piece (from 0), start (tokens before it), length, and its token ids as
    little-endian unsigned numbers of `width` bytes (binary `ids`).

    A document is its text's ids and an end id (0); a null text counts as empty, so every document has a
    token. Only a document longer than `capacity` is cut, into full pieces after a shorter first one.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {"id": [], "piece": [], "start": [], "length": [], "ids": []}
            for key, words in zip(frame["id"], frame["text"]):
                ids = np.array([*_token_ids(words, vocabulary), END_ID], f"<u{width}")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for name, value in zip(out, (key, k, a, b - a, ids[a:b].tobytes())):
                        out[name].append(value)
            yield pd.DataFrame(out)

    kind = dict(docs.dtypes)[id]
    given = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    return given.mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id)


def _widened(ids: Column) -> Column:
    """Ids of two bytes each as ids of four."""

    @F.pandas_udf("binary")
    def widen(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(p, "<u2").astype("<u4").tobytes() for p in parts], dtype=object)

    return widen(ids)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their `sequence_id` and `offset`: `token_pieces` placed by `place`.

    The ids of the vocabulary fit two bytes, in which they are stored and shuffled; `ids` has four bytes each.
    Repeated rows are packed once each; a null id is carried along. Other columns of `docs` play no part.
    """
    made = materialize(token_pieces(docs, id, text, capacity, width=2).withColumn("_piece", F.monotonically_increasing_id()))
    placed = place(made.select("_piece", "length"), "_piece", "length", capacity)
    return replaced(made.join(placed, "_piece").drop("_piece"), ids=_widened(F.col("ids")))


def packed_tokens(packed: DataFrame) -> DataFrame:
    """One row per sequence: `sequence_id`, `length` and all its token ids in order (binary `ids`)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["length"]).alias("length"), joined.alias("ids"))
