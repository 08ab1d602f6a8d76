"""Near copies by ProbMinHash: sketches of weighted shingles, banding, and verification of every link.

Words are runs of letters, marks and digits in lower case; a shingle is five consecutive words (a text of one
to four words is one shingle). A shingle's weight is how often it occurs in the text. Every shingle fires a
Poisson process whose rate is its weight; each arrival falls into a random register, a register keeps its earliest
arrival, and a shingle stops once its next arrival is later than the latest register. The chance that two
texts agree in a register is their probability Jaccard similarity. Texts that repeat shingles are also sketched
with all weights one, for which that similarity is the plain Jaccard similarity of their shingle sets.

Texts whose sketches agree in all registers of a band meet in a bucket. A link is two different texts of a bucket
whose plain Jaccard similarity, worked out from their shingles, is at least the threshold. Classes are the
connected components of links and equal texts. A text too many of whose shingles no other candidate has is left out
first, as it can have no link. Then all are compared with up to three hubs, members that share the most bands, and
only members that lie in another component than the main hub are compared with the rest: only where the
triangle inequality of the Jaccard distance, and the shingles they share with anyone, leave a link possible. So a
group of thousands of near copies costs a few comparisons each, and no link of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, text_key
from ratelens.session import drop_materialized, materialize

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: 24 bands of 6 registers: two texts of similarity 0.8 meet with probability 0.9993, of 0.5 with 0.31.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Cells that the shingles of a text are dealt to, to tell by how much two texts differ at least.
CELL_BITS = 9
CELLS = 1 << CELL_BITS
#: Words sketched at a time.
BLOCK_WORDS = 400_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, occurrences), sorted by text number and shingle. Texts without a word have none."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = (np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)).astype(np.int64).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    begins = np.cumsum(lengths) - lengths
    owners, found = [], []

    def fold(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = _mix(h * _GOLDEN + flat[at + j])
        return h

    for n in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(lengths == n)
        owners.append(short)
        found.append(fold(begins[short], n))
    if len(flat) >= SHINGLE_WORDS:
        last = len(flat) - SHINGLE_WORDS + 1
        at = np.flatnonzero(owner[:last] == owner[SHINGLE_WORDS - 1 :])
        owners.append(owner[at])
        found.append(fold(at, SHINGLE_WORDS))
    who, what = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((what, who))
    who, what = who[order], what[order]
    new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (what[1:] != what[:-1])]) if len(who) else np.zeros(0, np.int64)
    return who[new], what[new], np.diff(np.r_[new, len(who)])


def sketch(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash registers (n texts x REGISTERS) of weighted elements; a text without elements has zeros."""
    earliest = np.full(n * REGISTERS, np.inf)
    holder = np.zeros(n * REGISTERS, np.uint64)
    time = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        drawn = _mix(element + np.uint64(turn * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        slot = owner * REGISTERS + (((_mix(drawn) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(time < earliest[slot])
        np.minimum.at(earliest, slot[better], time[better])
        won = better[time[better] == earliest[slot[better]]]
        holder[slot[won]] = element[won]
        # Early end: an arrival after a text's latest register changes nothing any more, nor do those after it.
        texts = owner[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])]
        latest = np.zeros(n)
        latest[texts] = earliest.reshape(n, REGISTERS)[texts].max(1)
        alive = time < latest[owner]
        owner, element, weight, time = owner[alive], element[alive], weight[alive], time[alive]
    return holder.reshape(n, REGISTERS)


def _band_hashes(registers: np.ndarray) -> np.ndarray:
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), 1))
    for j in range(ROWS):
        h = _mix(h * _GOLDEN + registers[:, j::ROWS][:, :BANDS])
    return h.view(np.int64)


def band_column(words: Column) -> Column:
    """Array of band hashes of a text's word hashes: BANDS, or twice as many for a text that repeats a shingle, or none."""

    @F.pandas_udf("array<long>")
    def bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = [np.asarray(t, np.int64) for t in series]
            out: list[np.ndarray] = []
            ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0)
            cut = 0
            while cut < len(texts):
                done = ends[cut - 1] if cut else 0
                upto = max(cut + 1, int(np.searchsorted(ends, done + BLOCK_WORDS, side="right")))
                out += _bands_of(texts[cut:upto])
                cut = upto
            yield pd.Series(out, dtype=object)

    return bands(words)


def _bands_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    owner, element, times = shingles(texts)
    weighted = _band_hashes(sketch(owner, element, times.astype(float), len(texts)))
    has = np.bincount(owner, minlength=len(texts)) > 0
    repeats = np.zeros(len(texts), bool)
    repeats[owner[times > 1]] = True
    own = repeats[owner]
    plain = _band_hashes(sketch(owner[own], element[own], np.ones(own.sum()), len(texts))) if own.any() else weighted
    none = np.zeros(0, np.int64)
    return [np.r_[weighted[i], plain[i]] if repeats[i] else weighted[i] if has[i] else none for i in range(len(texts))]


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Plain and probability Jaccard similarity of each pair of texts, given as word hashes; 0 where neither has a word."""
    n = len(left)
    a_owner, a_what, a_times = shingles(left)
    b_owner, b_what, b_times = shingles(right)
    owner, what = np.r_[a_owner, b_owner], np.r_[a_what, b_what]
    a = np.r_[a_times, np.zeros(len(b_owner))]
    b = np.r_[np.zeros(len(a_owner)), b_times]
    order = np.lexsort((what, owner))
    owner, what, a, b = owner[order], what[order], a[order], b[order]
    if not len(owner):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (what[1:] != what[:-1])])
    a, b, owner = np.add.reduceat(a, new), np.add.reduceat(b, new), owner[new]
    both = (a > 0) & (b > 0)
    union = np.bincount(owner, minlength=n)
    plain = np.bincount(owner[both], minlength=n) / np.maximum(union, 1)
    # Of shingle i: sum over j of max(a_j / a_i, b_j / b_i). With j sorted by a_j / b_j, the first is the larger from i on.
    ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.lexsort((ratio, owner))
    owner, a, b, both = owner[order], a[order], b[order], both[order]
    first = np.searchsorted(owner, owner, side="left")
    sum_a, sum_b = np.r_[0, np.cumsum(a)], np.r_[0, np.cumsum(b)]
    end = np.searchsorted(owner, owner, side="right")
    at = np.arange(len(owner))
    low = (sum_b[at] - sum_b[first]) / np.where(b > 0, b, 1)
    high = (sum_a[end] - sum_a[at]) / np.where(a > 0, a, 1)
    share = np.where(both, 1 / np.where(both, low + high, 1), 0)
    return plain, np.bincount(owner, share, minlength=n)


# --------------------------------------------------------------------------- pairs of texts


def plain_similarity(left: Column, right: Column) -> Column:
    """Plain Jaccard similarity of the shingle sets of two texts, given as word hashes."""

    @F.pandas_udf("double")
    def alike(one: pd.Series, two: pd.Series) -> pd.Series:
        sides = [[np.asarray(t, np.int64) for t in s] for s in (one, two)]
        out = [similarities(sides[0][i : i + 256], sides[1][i : i + 256])[0] for i in range(0, len(one), 256)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return alike(left, right)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`pairs` (xa, xb, ya, yb) with `distance`, one minus the plain Jaccard similarity of their texts."""
    one = texts.select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("text").alias("x_text"))
    two = texts.select(F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("text").alias("y_text"))
    met = pairs.join(one, ["xa", "xb"]).join(two, ["ya", "yb"])
    alike = plain_similarity(word_hashes(F.col("x_text")), word_hashes(F.col("y_text")))
    return met.select("xa", "xb", "ya", "yb", (1 - alike).alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b, ra, rb): the smallest node of the component of every node of `edges` (xa, xb, ya, yb).

    Every node takes the smallest label among its neighbours', and then that label's own label; rounds go on until
    nothing changes. Each round is written, so that a lost executor costs no more than a task.
    """
    there = edges.select("xa", "xb", "ya", "yb")
    back = edges.select(F.col("ya").alias("xa"), F.col("yb").alias("xb"), F.col("xa").alias("ya"), F.col("xb").alias("yb"))
    both = materialize(there.union(back).distinct())
    label = F.struct(F.col("ya").alias("a"), F.col("yb").alias("b"))
    own = F.struct(F.col("xa").alias("a"), F.col("xb").alias("b"))
    labels = materialize(both.groupBy("xa", "xb").agg(F.least(F.min(label), F.first(own)).alias("r")))
    while True:
        seen = labels.select(F.col("xa").alias("ya"), F.col("xb").alias("yb"), F.col("r").alias("s"))
        near = both.join(seen, ["ya", "yb"]).groupBy("xa", "xb").agg(F.min("s").alias("s"))
        lower = labels.join(near, ["xa", "xb"]).select("xa", "xb", "r", F.least("r", "s").alias("m"))
        jumped = lower.join(seen.withColumnRenamed("s", "far"), (lower["m.a"] == seen["ya"]) & (lower["m.b"] == seen["yb"]))
        found = materialize(jumped.select("xa", "xb", F.least("m", "far").alias("r"), (F.least("m", "far") != F.col("r")).alias("changed")))
        drop_materialized(labels)
        labels = found.select("xa", "xb", "r")
        if not found.where("changed").head(1):
            break
    drop_materialized(both)
    return labels.select(F.col("xa").alias("a"), F.col("xb").alias("b"), F.col("r.a").alias("ra"), F.col("r.b").alias("rb"))


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.drop("ra", "rb").join(roots, ["a", "b"], "left").withColumns(
        {"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")}
    )


def _joined(members: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """`members` whose components `edges` have joined; `roots` are those of the components."""
    for x in "xy":
        known = roots.select(F.col("a").alias(f"{x}a"), F.col("b").alias(f"{x}b"), "ra", "rb")
        found = edges.join(known, [f"{x}a", f"{x}b"], "left")
        edges = found.withColumns({f"{x}a": F.coalesce("ra", f"{x}a"), f"{x}b": F.coalesce("rb", f"{x}b")}).drop("ra", "rb")
    over = components(edges.where((F.col("xa") != F.col("ya")) | (F.col("xb") != F.col("yb"))))
    over = over.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("ra").alias("oa"), F.col("rb").alias("ob"))
    return members.join(over, ["ra", "rb"], "left").withColumns({"ra": F.coalesce("oa", "ra"), "rb": F.coalesce("ob", "rb")}).drop("oa", "ob")


def shingle_column(words: Column) -> Column:
    """Array of the different shingles of a text's word hashes."""

    @F.pandas_udf("array<long>")
    def distinct(series: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for i in range(0, len(series), 256):
            part = [np.asarray(t, np.int64) for t in series[i : i + 256]]
            owner, what, _ = shingles(part)
            out += np.split(what.view(np.int64), np.searchsorted(owner, np.arange(1, len(part))))
        return pd.Series(out, dtype=object)

    return distinct(words)


def _cells(shingles: Column) -> Column:
    """Which of CELLS cells hold an odd number of a text's shingles, as bits of numbers.

    Two texts differ in at least as many shingles as there are cells that are odd in one of them alone.
    """

    @F.pandas_udf("array<long>")
    def odd(series: pd.Series) -> pd.Series:
        counts = [np.bincount(np.asarray(s, np.int64).view(np.uint64) >> np.uint64(64 - CELL_BITS), minlength=CELLS) for s in series]
        return pd.Series([np.packbits((c % 2).astype(np.uint8)).view(np.int64) for c in counts], dtype=object)

    return odd(shingles)


def _differ(x: Column, y: Column) -> Column:
    """The number of shingles, at least, that only one of two texts has."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)


def _shared_shingles(texts: DataFrame) -> DataFrame:
    """(a, b, size, shared, cells): the number of a text's shingles, and of those that another of the texts has too; see `_cells`."""
    held = materialize(texts.select("a", "b", shingle_column(word_hashes(F.col("text"))).alias("s")))
    single = held.select("a", "b", F.explode("s").alias("shingle")).groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("a").alias("a"), F.min("b").alias("b")
    )
    own = single.where("n = 1").groupBy("a", "b").agg(F.count("*").alias("own"))
    sized = held.select("a", "b", F.size("s").alias("size"), _cells(F.col("s")).alias("cells"))
    return materialize(sized.join(own, ["a", "b"], "left").select("a", "b", "size", "cells", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared")))


def _hub_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of every member with its bucket's hubs, and (bucket, ha, hb): the main hub.

    Hubs are the members whose buckets hold the most texts, one of each third of the texts; the busiest is the main one.
    """
    busy = materialize(members.groupBy("a", "b").agg(F.sum("n").alias("busy")))
    ranked = members.join(busy, ["a", "b"])
    one = F.struct("busy", "a", "b")
    thirds = [F.max(F.when(F.pmod("a", F.lit(3)) == k, one)).alias(f"h{k}") for k in range(3)]
    hubs = materialize(ranked.groupBy("bucket").agg(*thirds).select("bucket", F.array_compact(F.array("h0", "h1", "h2")).alias("hubs")))
    met = members.join(hubs, "bucket").select("a", "b", F.explode("hubs").alias("h"))
    pairs = met.where((F.col("a") != F.col("h.a")) | (F.col("b") != F.col("h.b")))
    main = hubs.select("bucket", F.array_max("hubs").alias("h"))
    return _ordered(pairs.select(F.struct("a", "b").alias("x"), F.struct(F.col("h.a").alias("a"), F.col("h.b").alias("b")).alias("y"))), main.select(
        "bucket", F.col("h.a").alias("ha"), F.col("h.b").alias("hb")
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    """Different pairs (xa, xb, ya, yb) from structs x and y, the smaller first."""
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return pairs.select(low["a"].alias("xa"), low["b"].alias("xb"), high["a"].alias("ya"), high["b"].alias("yb")).distinct()


def links(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(xa, xb, ya, yb, distance): links between different texts, given by the keys of `text_key`.

    Every component of near copies is connected by the links returned; links between members that are already
    known to be connected need not be among them.
    """
    to_hubs, _, others = _links(docs, text, threshold)
    return to_hubs.union(others)


def _links(docs: DataFrame, text: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with hubs, the components that they make, and links between these components; the last two are written."""
    keyed = docs.where(F.col(text).isNotNull()).select(*[k.alias(n) for k, n in zip(text_key(F.col(text)), "ab")], F.col(text).alias("text"))
    bands = F.array_distinct(band_column(word_hashes(F.col("text"))))
    sketched = materialize(keyed.select("a", "b", bands.alias("bands")).distinct())
    spread_out = sketched.select("a", "b", F.explode("bands").alias("bucket"))
    shared = materialize(spread_out.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = materialize(spread_out.join(shared, "bucket").select("bucket", "a", "b", "n"))
    wanted = materialize(members.select("a", "b").distinct())
    # Copies meet before the shuffle; always merged, as the texts wanted grow with the corpus.
    texts = materialize(keyed.groupBy("a", "b").agg(F.first("text").alias("text")).join(wanted.hint("merge"), ["a", "b"]))
    drop_materialized(sketched)
    reach = 1 - threshold + 1e-12
    # A text too many of whose shingles are its own has no link.
    known = _shared_shingles(texts).where(F.col("shared") >= (threshold - 1e-9) * F.col("size"))
    members = materialize(members.join(known.drop("cells"), ["a", "b"]))
    to_hub, main = _hub_pairs(members)
    checked = materialize(_verified(materialize(to_hub), texts))
    found = checked.where(F.col("distance") <= reach)
    roots = materialize(components(found))
    placed = materialize(_beside_hub(members, main, checked, roots))
    rest = materialize(_possible_pairs(placed, known.select("a", "b", "cells"), reach))
    # Written, as the components read the links several times.
    return found, roots, materialize(_verified(rest, texts).where(F.col("distance") <= reach))


def _beside_hub(members: DataFrame, main: DataFrame, checked: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their component, their distance to the main hub, and whether they lie outside its component."""
    x, y = F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")), F.struct(F.col("ya").alias("a"), F.col("yb").alias("b"))
    either = checked.select(F.explode(F.array(F.struct(x.alias("m"), y.alias("h")), F.struct(y.alias("m"), x.alias("h")))).alias("p"), "distance")
    to_hub = either.select(F.col("p.m.a").alias("a"), F.col("p.m.b").alias("b"), F.col("p.h.a").alias("ha"), F.col("p.h.b").alias("hb"), "distance")
    # The hubs meet their components by bucket: one hub serves many buckets, whose members would all meet under its key.
    hub_roots = roots.select(F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("ra").alias("hra"), F.col("rb").alias("hrb"))
    rooted_main = materialize(main.join(hub_roots, ["ha", "hb"], "left").withColumns({"hra": F.coalesce("hra", "ha"), "hrb": F.coalesce("hrb", "hb")}))
    with_hub = members.join(rooted_main, "bucket")
    rooted = _with_roots(with_hub, roots).join(to_hub, ["a", "b", "ha", "hb"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    apart = (F.col("ra") != F.col("hra")) | (F.col("rb") != F.col("hrb"))
    return rooted.select("bucket", "a", "b", "ra", "rb", "size", "shared", "distance", apart.alias("outside"))


def _possible_pairs(placed: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """Pairs of a bucket in different components that may still be linked.

    One of the two lies outside the main hub's component. Their distances to the main hub must differ by `reach` at most
    (triangle inequality; the distances are cut into steps of `reach`, so that only neighbouring steps meet), and the shingles that they share with anyone must suffice for the similarity.
    Their cells must not tell that they differ in more shingles than a link may: only the few pairs left have their texts compared.
    """
    step = F.floor(F.col("distance") / reach).cast("int")
    columns = ("a", "b", "ra", "rb", "size", "shared", "distance", "outside", "cells")
    met = placed.join(materialize(placed.where("outside").select("bucket").distinct()), "bucket")
    met = materialize(met.join(cells, ["a", "b"]))
    x = met.where("outside").select("bucket", F.explode(F.array(step - 1, step, step + 1)).alias("step"), *[F.col(c).alias(f"x{c}") for c in columns])
    y = met.select("bucket", step.alias("step"), *[F.col(c).alias(f"y{c}") for c in columns])
    apart = (F.col("xra") != F.col("yra")) | (F.col("xrb") != F.col("yrb"))
    once = ~F.col("youtside") | (F.col("xa") < F.col("ya")) | ((F.col("xa") == F.col("ya")) & (F.col("xb") < F.col("yb")))
    near = F.abs(F.col("xdistance") - F.col("ydistance")) <= reach + 1e-9
    common = F.least("xshared", "yshared")
    enough = common >= (1 - reach - 1e-9) * (F.col("xsize") + F.col("ysize") - common)
    # Of a union of u shingles two texts at distance d differ in d u, and their sizes add up to (2 - d) u.
    alike = _differ(F.col("xcells"), F.col("ycells")) <= (reach / (2 - reach) + 1e-9) * (F.col("xsize") + F.col("ysize"))
    pairs = x.join(y, ["bucket", "step"]).where(apart & once & near & enough & alike)
    return _ordered(pairs.select(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")).alias("x"), F.struct(F.col("ya").alias("a"), F.col("yb").alias("b")).alias("y")))


# --------------------------------------------------------------------------- documents


def text_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, class_id, ka, kb): for every text that is not null its class, named by the smallest id in it, and the key
    of a text that bears this id."""
    keyed = docs.where(F.col(text).isNotNull()).select(*[k.alias(n) for k, n in zip(text_key(F.col(text)), "ab")], F.col(id).alias("id"))
    smallest = materialize(keyed.groupBy("a", "b").agg(F.min("id").alias("id")))
    _, roots, others = _links(docs, text, threshold)
    placed = _joined(_with_roots(smallest.withColumns({"ra": F.lit(0), "rb": F.lit(0)}), roots), roots, others)
    named = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a", "b"))
    heads = materialize(placed.groupBy("ra", "rb").agg(named.alias("head")))
    return placed.join(heads, ["ra", "rb"]).select(
        "a", "b", F.col("head.id").alias("class_id"), F.col("head.a").alias("ka"), F.col("head.b").alias("kb")
    )


def near_duplicate_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns plus `class_id`, the smallest id of the row's class (a column of this name is replaced).

    Equal texts, also empty ones, share a class; a null text is a class of its own, named by the row's id. A class
    without any id has a null class id. An empty table gives an empty one; very long texts are compared whole.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "class_id"])
    ca, cb, own = fresh(docs, "class_a", "class_b", "class_of")
    classes = materialize(text_classes(docs, id, text, threshold)).select(F.col("a").alias(ca), F.col("b").alias(cb), F.col("class_id").alias(own))
    a, b = text_key(F.col(text))
    found = docs.join(classes, F.col(text).isNotNull() & (a == F.col(ca)) & (b == F.col(cb)), "left")
    name = F.when(F.col(text).isNull(), F.col(id)).otherwise(F.col(own))
    return found.withColumn("class_id", name).drop(ca, cb, own)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class: the one with the smallest id (of rows that repeat id and text, any one). Null texts stay."""
    classes = text_classes(docs, id, text, threshold)
    ka, kb, ca, cb, own = fresh(docs, "key_a", "key_b", "class_a", "class_b", "class_of")
    kept = materialize(classes.where((F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb"))).select(
        F.col("a").alias(ca), F.col("b").alias(cb), F.col("class_id").alias(own)
    ))
    a, b = text_key(F.col(text))
    keyed = docs.where(F.col(text).isNotNull()).withColumns({ka: a, kb: b})
    same = (F.col(ka) == F.col(ca)) & (F.col(kb) == F.col(cb)) & F.col(id).eqNullSafe(F.col(own))
    met = keyed.join(kept, same).dropDuplicates([ka, kb, id])
    return met.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(F.col(text).isNull()))
