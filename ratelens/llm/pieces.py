"""SentencePiece ids by an Aho-Corasick automaton and a single-pass Viterbi, and back to text.

The automaton holds all pieces of a model. One pass over a text meets, at every position, all pieces that end there (the
automaton's output links); each extends the best path to where it begins, and the best of them stays.

Two kinds of models differ in which paths count. In a unigram model any two pieces may follow each other and a
path's score is the sum of its pieces' log probabilities. In a BPE model a path counts only if BPE would leave
each two neighbours as they are: then exactly one path reaches each position, the one that merging pairs by rank
arrives at, so the ids are those of the sentencepiece library. Characters that no piece holds become byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, replaced, text_or_empty

BLANK = "▁"
#: Stretches that a worker remembers at most, and pairs of pieces.
REMEMBERED = 1 << 19
#: Rows that a worker gives back at a time.
SLICE = 1_000
#: Characters of a segment that is remembered, at most.
LONGEST = 64
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class _Memory:
    """Ids of texts met before. Half of the room is for those met lately: when it is full, those not met since then go."""

    def __init__(self, room: int):
        self.half, self.new, self.old = room // 2, {}, {}

    def get(self, text: str) -> tuple[int, ...] | None:
        found = self.new.get(text)
        if found is None:
            found = self.old.get(text)
            if found is not None:
                self.put(text, found)
        return found

    def put(self, text: str, ids: tuple[int, ...]) -> None:
        if len(text) <= LONGEST:
            if len(self.new) >= self.half:
                self.new, self.old = {}, self.new
            self.new[text] = ids


class Pieces:
    """Pieces with scores: `kind` is "unigram" or "bpe". `pieces[i]` has id i; those named in `special` are no text."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, special: tuple[int, ...] = (0, 1, 2)):
        self.kind, self.scores = kind, scores
        self.pieces = pieces
        self.bytes = {int(m[1], 16): i for i, p in enumerate(pieces) if (m := _BYTE.match(p))}
        marked = {*special, *self.bytes.values()}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in marked and p}
        self.sizes = list(map(len, pieces))
        self.raw = [b"" if i in special else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        # If no piece holds a blank after another character, no path needs to cross such a place.
        self.split = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        # Nor one between two characters that stand side by side in no piece.
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self._segments, self._stretches = _Memory(REMEMBERED), _Memory(REMEMBERED // 2)
        self._pairs: dict[int, bool] = {}
        self._firsts = [i * len(pieces) for i in (*range(len(pieces)), -1)]  # a left piece's first key of `_pairs`
        self._histories: dict[str, tuple[list, list] | None] = {}  # one entry a piece at most

    @classmethod
    @cache
    def load(cls, name: str = "piece_bpe_32k.model") -> Pieces:
        """The public model `name`; its scores are ranks of merges, so it is a BPE model."""
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        ids = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], "bpe")

    pattern = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def _merged(self, text: str, down_to: int = 1) -> list[str]:
        """BPE by definition, for the few characters of a piece or two: merge the pair of the best score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > down_to:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _history(self, text: str) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """What stands at the first and at the last character of a piece while BPE makes it, each with the score of the
        merge that put it there. None if BPE does not arrive at the piece, or makes a part by a merge of a score that
        is no better than the whole's: then the merges of two neighbours need not take turns by their scores."""
        if text not in self._histories:
            found = None
            if len(text) == 1:
                found = ([(0.0, text)], [(0.0, text)])
            elif self._merged(text) == [text]:
                left, right = self._merged(text, 2)
                before, after, own = self._history(left), self._history(right), self.scores[self.ids[text]]
                if before and after and all(len(p) == 1 or self.scores[self.ids[p]] > own for p in (left, right)):
                    found = ([*before[0], (own, text)], [*after[1], (own, text)])
            self._histories[text] = found
        return self._histories[text]

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether BPE of the two pieces' text gives these two. Both grow by merges of falling score, so their merges take
        turns by score; at each turn the parts that touch must not have a better merge with each other."""
        before, after = self._history(left), self._history(right)
        if before is None or after is None:
            return self._merged(left + right) == [left, right]
        ends, starts = before[1], after[0]
        i = j = 0
        never = float("-inf")
        while True:
            next_left = ends[i + 1][0] if i + 1 < len(ends) else never
            next_right = starts[j + 1][0] if j + 1 < len(starts) else never
            across = self.ids.get(ends[i][1] + starts[j][1])
            # Of equal scores the leftmost pair comes first.
            if across is not None and self.scores[across] > next_left and self.scores[across] >= next_right:
                return False
            if next_left == never and next_right == never:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two pieces as they are; left is -1 at the beginning."""
        if self.kind != "bpe":
            return True
        if len(self._pairs) >= REMEMBERED:
            self._pairs.clear()
        piece = self.pieces[right]
        known = self._merged(piece) == [piece] if left < 0 else self._stay_apart(self.pieces[left], piece)
        self._pairs[left * len(self.pieces) + right] = known
        return known

    def _best_path(self, text: str) -> list[int]:
        """Single pass: at each position the best path, from the pieces that end there or from byte pieces."""
        return (self._only_path(text) if self.kind == "bpe" else None) or self._scored_path(text)

    def _only_path(self, text: str) -> list[int] | None:
        """The single pass in a BPE model: one path reaches each position, so that no scores need be kept and no other piece
        tried once it is found. None if no path reaches the end, as where a character has no piece."""
        sizes, firsts, known = self.sizes, self._firsts, self._pairs.get
        # By the position of a piece's last character; the one before the first character is -1, the last entry.
        last: list[int | None] = [None] * len(text) + [-1]
        for end, piece in self.automaton.iter(text):
            if last[end] is None:
                left = last[end - sizes[piece]]
                if left is not None:
                    follows = known(firsts[left] + piece)
                    if follows is None:
                        follows = self._may_follow(left, piece)
                    if follows:
                        last[end] = piece
        out: list[int] = []
        at = len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                return None
            out.append(piece)
            at -= sizes[piece]
        return out[::-1]

    def _scored_path(self, text: str) -> list[int]:
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        last, start = [-1] * (n + 1), [0] * (n + 1)
        sizes, scores, ids, known, count = self.sizes, self.scores, self.ids, self._pairs.get, len(self.pieces)
        at = 0  # up to here, characters without a piece are dealt with
        for end, piece in self.automaton.iter(text):
            end += 1
            while at < end - 1:
                at += 1
                if score[at] is None and text[at - 1] not in ids and score[at - 1] is not None:
                    score[at], start[at] = score[at - 1], at - 1
            begin = end - sizes[piece]
            before = score[begin]
            if before is not None:
                left = last[begin]
                follows = known(left * count + piece)
                if follows is None:
                    follows = self._may_follow(left, piece)
                if follows:
                    reached = before + scores[piece]
                    if score[end] is None or reached > score[end]:
                        score[end], last[end], start[end] = reached, piece, begin
        for at in range(at + 1, n + 1):
            if score[at] is None and text[at - 1] not in ids and score[at - 1] is not None:
                score[at], start[at] = score[at - 1], at - 1
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.bytes.get(b, 0) for b in reversed(text[at - 1].encode())]
            at = start[at]
        return out[::-1]

    def _ids_of(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment: a short one of a BPE model by one pass, else from those of its stretches, cut where no piece can lie across."""
        if self.kind == "bpe" and len(segment) <= LONGEST:
            whole = self._only_path(segment)
            if whole is not None:
                return tuple(whole)
        neighbours, known = self.neighbours, self._stretches
        ends = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in neighbours]
        out: list[int] = []
        for begin, end in zip((0, *ends), (*ends, len(segment))):
            stretch = segment[begin:end]
            ids = known.get(stretch)
            if ids is None:
                ids = tuple(self._best_path(stretch))
                known.put(stretch, ids)
            out.extend(ids)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text; blanks count as piece characters and one blank is put in front. An empty text has none."""
        if not text:
            return []
        marked = BLANK + text.replace(" ", BLANK)
        parts = self.pattern.findall(marked) if self.split else [marked]
        known = self._segments
        found = list(map(known.new.get, parts))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            part = parts[i]
            found[i] = known.get(part)
            if found[i] is None:
                found[i] = self._ids_of(part)
                known.put(part, found[i])
        return list(chain.from_iterable(found))

    def decode(self, ids) -> str:
        """Text of ids without the blank in front; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def ids_column(text: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Array of piece ids; null texts give null."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces.load(model)
        for series in batches:
            # Arrays, as a batch of lists of Python numbers would take many times their size.
            yield pd.Series([None if t is None else np.array(pieces.encode(t), np.int32) for t in series], dtype=object)

    return encode(text)


def text_column(ids: Column, model: str = "piece_bpe_32k.model") -> Column:
    """Text of an array of piece ids; null gives null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces.load(model)
        for series in batches:
            yield pd.Series([None if i is None else pieces.decode(i) for i in series], dtype=object)

    return decode(ids)


def _both_ways(text: Column, model: str) -> Column:
    """Ids and the text they give back, in one worker a task: two would hold the automaton and their batches twice."""

    @F.pandas_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.load(model)
        for series in batches:
            for first in range(0, len(series), SLICE):
                found = [pieces.encode(t) for t in series.iloc[first : first + SLICE]]
                decoded = [pieces.decode(i) for i in found]  # from lists, as numbers of an array are slower to look up
                ids = [np.array(i, np.int32) for i in found]
                del found
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

    return both(text)


def with_pieces(docs: DataFrame, text: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """All rows and columns plus `ids`, their number `n_ids`, and `decoded`, the text that the ids give back.

    Columns of these names are replaced. A null text counts as empty: no ids, an empty text. The text comes back
    to the character unless it holds the blank sign U+2581 itself, which comes back as a blank. Each row is
    worked on alone, whole texts of any length in time proportional to it; an empty table gives an empty one.
    """
    (held,) = fresh(docs, "held_pieces")
    coded = docs.withColumn(held, _both_ways(text_or_empty(text), model))
    ids = F.col(held)["ids"]
    return replaced(coded, ids=ids, n_ids=F.size(ids), decoded=F.col(held)["decoded"]).drop(held)
