"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

p(word | before) = p(class | before) p(next part | class, before) ... Every factor is a softmax over `WAYS` outcomes whose
logits are the node's bias plus one hashed weight row for each feature: the word before, the skip word two before and, for
the class, the pair of both. Classes follow the frequency: the root tells 15 classes of frequent tokens and the rare ones
apart; a class of 16^d tokens is told apart by d more softmaxes, so each of its tokens is predicted by itself. Rare tokens
go on by digits of their hash, down to leaves of about `TYPES_PER_LEAF` types, in which a token has the add-one share of its
count. So the context predicts every token of the training vocabulary, and the number of softmaxes grows with the
vocabulary's logarithm. Each leaf has an equal part of the add-one mass of unseen tokens.

Training: token counts cover all training texts. The softmaxes start as the unigram model (biases from the counts)
and are trained by distributed gradient updates: texts are dealt into rounds and learners by a hash of their row; in each
round every learner runs mini-batch steps over its texts, in the order of the hash, from the shared weights, and
the weight rows are averaged over the learners by how often each touched them. Number of learners and order of texts follow from
the data alone, so the scores do not depend on how the table is split, nor on a task that runs twice.

Counts of frequent tokens are broadcast. By the pigeonhole principle at most `HEAD` tokens can make up one part in
`HEAD` of the corpus each, so this table is bounded at any corpus size. The other tokens of a text meet their
counts in a join, in which no key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, text_or_empty
from ratelens.session import materialize

HEAD = 1 << 20
#: Bits of a token's hash before those that name its leaf.
LEAF_SHIFT = 20
#: Outcomes of a softmax.
WAYS = 16
#: Digits below each of the root's first 15 outcomes: together they hold more than HEAD tokens, by falling frequency.
CLASS_DEPTHS = (1,) * 8 + (2,) * 4 + (3, 4, 5)
RARE = WAYS - 1
#: Types in a leaf of rare tokens, about; leaves are at most WAYS ** MOST_RARE_DIGITS.
TYPES_PER_LEAF = 1024
MOST_RARE_DIGITS = 5
#: Features, the first ones, of the softmaxes below the root.
LOWER_FEATURES = 2
#: Rows of the hashed weight table: it doubles whenever the training tokens grow fourfold beyond TOKENS_AT_LEAST.
LEAST_ROWS, MOST_ROWS = 1 << 16, 1 << 19
TOKENS_AT_LEAST = 1 << 27
ROUNDS = 2
#: Tokens that one learner goes through in a round, about.
TOKENS_PER_LEARNER = 1 << 21
BATCH = 1 << 15
RATE = 0.25
#: Tokens scored together.
BLOCK = 1 << 12
#: Bytes of text that a task looks at together; a longer text is looked at whole.
BYTES_AT_ONCE = 1 << 20

_BEGIN, _TAIL, _END = 0x51ED270B35AC41F7, 0x2545F4914F6CDD1D, 0x71C9B2D4A3E85F60
_LOG10 = float(np.log(10))
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n): how often each token, named by a 64-bit hash, occurs in the texts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _slices(frame["text"]):
                token, n = np.unique(_flat(part)[0], return_counts=True)
                yield pd.DataFrame({"token": token, "n": n})

    parts = docs.select(text_or_empty(text).alias("text")).mapInPandas(count, "token long, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------- numpy side


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _leaf_first(depth: int) -> int:
    """Number of nodes above the digit `depth` of a tree."""
    return (WAYS**depth - 1) // (WAYS - 1)


@dataclass
class Model:
    """Vocabulary statistics and weights. `head` is sorted; `group` and `place` say where each head token is among the classes."""

    head: np.ndarray
    count: np.ndarray
    group: np.ndarray
    place: np.ndarray
    tokens: int
    types: int
    leaf_log: np.ndarray
    depths: np.ndarray
    first_node: np.ndarray
    bias: np.ndarray
    rows: np.ndarray

    @classmethod
    def start(cls, head: np.ndarray, count: np.ndarray, tokens: int, types: int, leaves: np.ndarray | None = None) -> Model:
        """The unigram model. `leaves`: the add-one mass of the seen rare tokens of each leaf (none: one leaf, and all other types in it)."""
        if leaves is None:
            leaves = np.array([float(tokens - count.sum() + types - len(head))])
        leaves = leaves + 1 / len(leaves)
        depths = np.array([*CLASS_DEPTHS, round(math.log(len(leaves), WAYS))])
        first_node = 1 + np.cumsum([0, *[_leaf_first(d) for d in depths[:-1]]])
        rank = np.empty(len(head), np.int64)
        rank[np.lexsort((head, -count))] = np.arange(len(head))
        begins = np.cumsum([0, *[WAYS**d for d in CLASS_DEPTHS]])
        group = np.searchsorted(begins, rank, side="right") - 1
        place = rank - begins[group]
        bias = np.zeros((first_node[-1] + _leaf_first(depths[-1]), WAYS))
        for k, depth in enumerate(depths):
            if k == RARE:
                mass = leaves
            else:
                mass = np.zeros(WAYS**depth)
                mass[place[group == k]] = count[group == k] + 1
            for j in range(depth):
                sums = mass.reshape(WAYS ** (j + 1), -1).sum(1)
                bias[first_node[k] + _leaf_first(j) : first_node[k] + _leaf_first(j + 1)] = sums.reshape(-1, WAYS)
            bias[0, k] = mass.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            bias = np.log(bias / bias.sum(1, keepdims=True))
        bias = np.nan_to_num(bias, nan=-30, neginf=-30).clip(-30).astype(np.float32)  # outcomes that no token has
        growth = max(0, math.ceil(math.log(max(1, tokens) / TOKENS_AT_LEAST, 4)))
        rows = np.zeros((min(MOST_ROWS, LEAST_ROWS << growth), WAYS), np.float32)
        return cls(head, count, group, place, tokens, types, np.log10(leaves), depths, first_node, bias, rows)

    def look_up(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token in the head, and whether it is there."""
        if not len(self.head):
            return np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
        at = np.searchsorted(self.head, flat).clip(max=len(self.head) - 1)
        return at, self.head[at] == flat

    def targets(self, flat: np.ndarray, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token and its place there: for rare ones the leaf."""
        leaf = ((flat.view(np.uint64) >> np.uint64(LEAF_SHIFT)) & np.uint64(len(self.leaf_log) - 1)).astype(np.int64)
        if not len(self.head):
            return np.full(len(flat), RARE), leaf
        return np.where(hit, self.group[at], RARE), np.where(hit, self.place[at], leaf)

    def features(self, flat: np.ndarray, hit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Feature hashes (3 x tokens). `first`: place of each token's text in `flat`. Tokens outside the head count as one."""
        known = np.where(hit, flat.view(np.uint64), np.uint64(_TAIL))
        at = np.arange(len(flat))

        def back(n: int) -> np.ndarray:
            return np.where(at - n >= first, known[(at - n).clip(min=0)], np.uint64(_BEGIN))

        one, two = _mix(back(1) + np.uint64(1)), _mix(back(2) + np.uint64(2))
        return np.stack([one, two, _mix(one * np.uint64(3) + two)])

    def decisions(self, hashed: np.ndarray, group: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        """(token, node, answer, rows): first the root's decision on every token, then all those below it.

        `rows` (features x decisions) are places in the weight table.
        """
        every = np.arange(len(group))
        yield every, np.zeros(len(group), np.int64), group, self._rows_at(hashed, np.zeros(1, np.int64))
        depth = self.depths[group]
        tokens, nodes, answers = [], [], []
        for j in range(int(depth.max()) if len(depth) else 0):
            own = np.flatnonzero(depth > j)
            g, shift = group[own], 4 * (depth[own] - j)
            tokens.append(own)
            nodes.append(self.first_node[g] + _leaf_first(j) + (place[own] >> shift))
            answers.append((place[own] >> (shift - 4)) & (WAYS - 1))
        if tokens:
            token, node = np.concatenate(tokens), np.concatenate(nodes)
            yield token, node, np.concatenate(answers), self._rows_at(hashed[:LOWER_FEATURES][:, token], node)

    def _rows_at(self, hashed: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (_mix(hashed + node.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(33)).astype(np.int64) & (len(self.rows) - 1)

    def forward(self, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their exponentials and the sums of these, of each decision."""
        logits = np.take(self.rows, rows[0], axis=0)
        for at in rows[1:]:
            logits += np.take(self.rows, at, axis=0)
        logits += self.bias[0] if not node.any() else np.take(self.bias, node, axis=0)
        np.clip(logits, -40, 40, out=logits)
        power = np.exp(logits)
        return logits, power, np.einsum("ij->i", power)

    def log10(self, hashed: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of each target: of a token of a class, or of a leaf."""
        out = np.zeros(len(group))
        for token, node, answer, rows in self.decisions(hashed, group, place):
            logits, _, total = self.forward(node, rows)
            own = logits.ravel()[np.arange(len(node)) * WAYS + answer]
            out += np.bincount(token, own - np.log(total), minlength=len(group))
        return out / _LOG10


class _Learner:
    """Mini-batch gradient steps on a copy of the shared weights; a weight's rate falls with the squares of its slopes so far."""

    def __init__(self, shared: Model):
        self.model = replace(shared, rows=shared.rows.copy())
        self.touched = np.zeros(len(shared.rows), np.int64)
        self.squares = np.zeros((WAYS, len(shared.rows)), np.float32)

    def learn(self, flat: np.ndarray, first: np.ndarray) -> None:
        at, hit = self.model.look_up(flat)
        group, place = self.model.targets(flat, at, hit)
        hashed = self.model.features(flat, hit, first)
        for a in range(0, len(flat), BATCH):
            own = slice(a, a + BATCH)
            self._step(hashed[:, own], group[own], place[own])

    def slopes(self, hashed: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the log likelihood (outcomes x decisions of each feature), and the weight rows that they belong to."""
        found = list(self.model.decisions(hashed, group, place))
        slopes = np.empty((WAYS, sum(rows.size for *_, rows in found)))
        begin = 0
        for _, node, answer, rows in found:
            _, power, total = self.model.forward(node, rows)
            end = begin + len(node)
            np.multiply(power.T, -1 / total, out=slopes[:, begin:end])
            slopes[answer, np.arange(begin, end)] += 1
            for k in range(1, len(rows)):
                slopes[:, begin + k * len(node) : end + k * len(node)] = slopes[:, begin:end]
            begin += rows.size
        return slopes, np.concatenate([rows.ravel() for *_, rows in found])

    def _step(self, hashed: np.ndarray, group: np.ndarray, place: np.ndarray) -> None:
        slope, at = self.slopes(hashed, group, place)
        size = len(self.model.rows)
        self.touched += np.bincount(at, minlength=size)
        for way in range(WAYS):
            sums = np.bincount(at, slope[way], minlength=size).astype(np.float32)
            self.squares[way] += sums * sums
            self.model.rows[:, way] += RATE * sums / np.sqrt(self.squares[way] + 1)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * BYTES_AT_ONCE), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _flat(texts: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of the texts as hashes, for each token the place of its text's first, and the texts' numbers of tokens.

    Tokens are the words between white space, A to Z in lower case, and then the end token.
    """
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"".join(x + b" " for x in coded).translate(_LOWER), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in coded])
    blank = np.concatenate([[True], _BLANK[joined]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begin, stop = edges[::2], edges[1::2]  # every text ends in a blank
    power, inverse = _powers_upto(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)])])
    words = _mix(_mix((sums[stop] - sums[begin]) * inverse[begin]) + (stop - begin).astype(np.uint64))
    owner = np.searchsorted(ends, begin, side="right")
    lengths = np.bincount(owner, minlength=len(coded)).astype(np.int64) + 1
    flat = np.full(lengths.sum(), _END, np.int64)
    flat[np.arange(len(words)) + owner] = words.view(np.int64)
    return flat, np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


def _slices(texts: pd.Series) -> Iterator[pd.Series]:
    """The texts in order, in groups of about BYTES_AT_ONCE characters."""
    ends = np.cumsum([0, *map(len, texts)])
    first = 0
    while first < len(texts):
        upto = max(first + 1, int(np.searchsorted(ends, ends[first] + BYTES_AT_ONCE, side="right")) - 1)
        yield texts.iloc[first:upto]
        first = upto


# --------------------------------------------------------------------------- training


def statistics(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The unigram model of the training texts, and the counts (token, n) of all its tokens as a written table."""
    counts = materialize(token_counts(docs, text))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).head()
    frequent = counts.where(F.col("n") * HEAD >= total["tokens"]).toPandas()  # at most HEAD rows
    frequent = frequent.sort_values("token")
    rare = max(1, total["types"] - len(frequent))
    leaves = np.zeros(WAYS ** min(MOST_RARE_DIGITS, max(0, math.ceil(math.log(rare / TYPES_PER_LEAF, WAYS)))))
    leaf = F.shiftrightunsigned("token", LEAF_SHIFT).bitwiseAND(F.lit(len(leaves) - 1))
    masses = counts.where(F.col("n") * HEAD < total["tokens"]).groupBy(leaf.alias("leaf")).agg(F.sum(F.col("n") + 1).alias("mass"))
    found = masses.toPandas()  # at most one row for each leaf
    leaves[found["leaf"].to_numpy(np.int64)] = found["mass"]
    model = Model.start(frequent["token"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64), total["tokens"], total["types"], leaves)
    return model, counts


def _learning(shared):
    def learn(own: pd.DataFrame) -> pd.DataFrame:
        learner = _Learner(shared.value)
        for part in _slices(own.sort_values(["row", "text"])["text"]):
            flat, first, _ = _flat(part)
            learner.learn(flat, first)
        at = np.flatnonzero(learner.touched)
        weights = learner.model.rows[at] * learner.touched[at, None].astype(np.float32)
        return pd.DataFrame({"at": at.astype(np.int32), "n": learner.touched[at], "w": pd.Series(list(weights), dtype=object)})

    return learn


def train(docs: DataFrame, model: Model, text: str = "text", rounds: int = ROUNDS) -> Model:
    """Gradient updates over all texts, each in one round; returns the model with new weights.

    Rows are dealt to learners by a hash of all their columns of plain types: give an id besides the text, so that
    copies of a text that many rows bear are spread over the learners.
    """
    context = docs.sparkSession.sparkContext
    plain = [c for c, kind in docs.dtypes if kind in ("bigint", "int", "string")]
    row = F.xxhash64(F.lit("learner"), *[F.col(f"`{c}`") for c in plain])
    learners = math.ceil(max(1, model.tokens) / rounds / TOKENS_PER_LEARNER)
    dealt = docs.select(text_or_empty(text).alias("text"), row.alias("row"))
    turn_of, learner_of = F.pmod("row", F.lit(rounds)), F.pmod(F.shiftright("row", 8), F.lit(learners)).cast("int")
    for turn in range(rounds):
        shared = context.broadcast(model)
        given = dealt.where(turn_of == turn).withColumn("learner", learner_of)
        parts = given.groupBy("learner").applyInPandas(_learning(shared), "at int, n long, w array<float>")
        sums = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("w")[i].cast("double")).alias(f"w{i}") for i in range(WAYS)])
        found = sums.toPandas()  # at most one row for each row of the weight table
        rows = model.rows.copy()
        rows[found["at"].to_numpy()] = found[[f"w{i}" for i in range(WAYS)]].to_numpy() / found["n"].to_numpy()[:, None]
        model = replace(model, rows=rows)
        shared.unpersist()
    return model


# --------------------------------------------------------------------------- scoring


def _score_slice(model: Model, texts: pd.Series) -> pd.DataFrame:
    flat, first, lengths = _flat(texts)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at, hit = model.look_up(flat)
    group, place = model.targets(flat, at, hit)
    logs = np.where(hit, np.log10((model.count[at] if len(model.head) else np.zeros(len(flat))) + 1.0), 0.0)
    hashed = model.features(flat, hit, first)
    fitted = np.zeros(len(flat))
    for a in range(0, len(flat), BLOCK):
        own = slice(a, a + BLOCK)
        fitted[own] = model.log10(hashed[:, own], group[own], place[own])
    # A rare token has its share of its leaf's mass; its count follows later.
    fitted[~hit] -= model.leaf_log[place[~hit]]
    per_text = lambda x: np.bincount(owner, x, minlength=len(lengths))
    ends = np.cumsum(np.bincount(owner[~hit], minlength=len(lengths)))
    return pd.DataFrame({
        "n": lengths, "known": per_text(hit.astype(float)).astype(np.int64), "base": per_text(logs), "fitted": per_text(fitted),
        "tail": pd.Series(np.split(flat[~hit], ends[:-1]), dtype=object),
    })


def _score_batches(shared):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            parts = [_score_slice(shared.value, part) for part in _slices(series)]
            yield pd.concat(parts, ignore_index=True) if parts else _score_slice(shared.value, series.iloc[:0]).iloc[:0]

    return score


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns but the text, plus n_tokens, n_known, train_tokens, base_score and score (log10).

    A null or empty text is its end token alone. Repeated rows are scored alike; an empty table gives an empty
    one; a model without training texts gives every token the same base. Columns of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "n long, known long, base double, fitted double, tail array<long>"
    scored = F.pandas_udf(_typed(_score_batches(shared)), kind)
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    others = [c for c in docs.columns if c != text and c.lower() not in new]
    own, row, logs, seen = fresh(docs, "scored", "row", "logs", "seen")
    kept = [F.col(f"`{c}`") for c in others]
    first = materialize(docs.select(*kept, scored(text_or_empty(text)).alias(own), F.monotonically_increasing_id().alias(row)))
    rare = counts.where(F.col("n") * HEAD < model.tokens).withColumnRenamed("n", "c")
    tail = first.select(row, F.explode(f"{own}.tail").alias("token")).join(rare, "token")
    sums = tail.groupBy(row).agg(F.sum(F.log10(F.col("c") + 1.0)).alias(logs), F.count("*").alias(seen))
    joined = first.join(sums, row, "left")
    some, met = F.coalesce(logs, F.lit(0.0)), F.coalesce(seen, F.lit(0).cast("long"))
    bottom = float(np.log10(model.tokens + model.types + 1))
    unseen = -float(np.log10(len(model.leaf_log)))  # of the part of a leaf's mass that unseen tokens have
    n, known = F.col(f"{own}.n"), F.col(f"{own}.known") + met
    return joined.select(
        *kept,
        n.alias("n_tokens"),
        known.alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col(f"{own}.base") + some - n * bottom).alias("base_score"),
        (F.col(f"{own}.fitted") + some + (n - known) * unseen).alias("score"),
    )


def _typed(score):
    def batches(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from score(series)

    batches.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return batches


def lm_scores(docs: DataFrame, training: DataFrame, text: str = "text") -> DataFrame:
    """Train on the texts of `training` and score those of `docs`; see `score_texts`."""
    model, counts = statistics(training, text)
    return score_texts(docs, train(training, model, text), counts, text)
