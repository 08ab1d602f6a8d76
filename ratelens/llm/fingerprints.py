"""Document fingerprints from closed syncmers over words, in Spark's own functions only.

A text is a row of words (runs of characters other than white space). Every run of five words is a k-mer with
four inner pairs of words; it is a closed syncmer, and so an anchor, if the smallest pair by hash is its
first or its last. Whether a k-mer is an anchor depends on its own words alone, so two texts that share
a passage share its anchors, wherever the passage lies. About half of all k-mers are anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import let, text_or_empty
from ratelens.operators.ordinals import with_ordinal
from ratelens.session import materialize

K, S = 5, 2


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def _anchors(text: Column, picked) -> Column:
    """`picked(words, pairs, i)` for the first word i of every anchor, in order. A text of fewer than K words has none."""

    def of_words(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(words) - S), lambda i: F.hash(F.get(words, i), F.get(words, i + 1)))

        def of_pairs(h: Column) -> Column:
            def closed(i: Column) -> Column:
                edge = F.least(F.get(h, i), F.get(h, i + (K - S)))
                return edge <= F.least(*[F.get(h, i + j) for j in range(1, K - S)])

            starts = F.filter(F.sequence(F.lit(0), F.size(words) - K), closed)
            return F.transform(starts, lambda i: picked(words, h, i))

        return F.when(F.size(words) >= K, let(pairs, of_pairs))

    return let(_words(text), of_words)


def _kmer_hash(words: Column, pairs: Column, i: Column) -> Column:
    return F.hash(F.get(pairs, i), F.get(pairs, i + 2), F.get(words, i + 4))


def anchors(text: Column) -> Column:
    """Array of (at, hash): every anchor of the text with the number of its first word; empty for fewer than K words."""
    none = F.array().cast("array<struct<at:int,hash:int>>")
    return F.coalesce(_anchors(text, lambda w, p, i: F.struct(i.alias("at"), _kmer_hash(w, p, i).alias("hash"))), none)


def fingerprint(text: Column) -> Column:
    """Array of (at, hash): every anchor of the whole text in order, with the number of its first word.

    A text without an anchor (fewer than five words, or none chosen) is represented by the hash of all of
    it, at -1, so equal texts always have equal fingerprints and no fingerprint is empty. A null text gives null.
    """
    whole = F.struct(F.lit(-1).alias("at"), F.hash(F.lit("whole"), text).alias("hash"))
    found = let(anchors(text), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(whole)))
    return F.when(text.isNotNull(), found)


def hashes(marks: Column) -> Column:
    """The distinct hashes of a fingerprint: what is compared, without the places."""
    return F.array_distinct(F.transform(marks, lambda m: m["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' anchors, given the distinct hashes of each: exact, from all of them."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both.cast("double") / (F.size(a) + F.size(b) - both))


def as_text(marks: Column) -> Column:
    """The fingerprint as hexadecimal digits, for each anchor eight of its hash, a colon and its place, with blanks between."""
    digits = lambda m: F.lpad(F.lower(F.hex(m["hash"].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(marks, lambda m: F.concat(digits(m), F.lit(":"), m["at"].cast("string"))), " ")


def shared_passages(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """For rows with two texts: `shift`, the distance in words at which most of their common anchors lie, and
    `matched`, the number of anchors there (positional matching). Anchors that a text repeats count at their first
    place. Texts without a common anchor (null and empty ones too) have matched 0 and a null shift; ties go to the
    smallest shift. Other columns are passed on.
    """
    places = lambda c: F.map_from_entries(
        let(anchors(F.coalesce(F.col(c), F.lit(""))), lambda found: F.transform(
            F.array_distinct(F.transform(found, lambda x: x["hash"])),
            lambda h: F.struct(h, F.get(F.filter(found, lambda x: x["hash"] == h), 0)["at"]),
        ))
    )
    shifts = let(places(left), lambda a: let(places(right), lambda b: F.transform(
        F.array_intersect(F.map_keys(a), F.map_keys(b)), lambda h: F.element_at(b, h) - F.element_at(a, h)
    )))
    counted = let(shifts, lambda all_shifts: F.transform(
        F.array_distinct(all_shifts),
        lambda d: F.struct(F.size(F.filter(all_shifts, lambda x: x == d)).alias("matched"), (-d).alias("back")),
    ))
    best = pairs.withColumn("_best", F.array_max(counted))
    return best.withColumns({"shift": -F.col("_best.back"), "matched": F.coalesce(F.col("_best.matched"), F.lit(0))}).drop("_best")


def next_documents(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(next_a, next_b, a, b, half): each document's key, half its length, and the key of the document after it
    in falling order of ids.

    After the last comes the first. Missing ids come last; equal ids are ordered by a hash of the text; rows
    equal in id and text are one document. Texts do not move: the order is made on keys alone.
    """
    keys = docs.select(*_key(id, text), F.col(id).alias("id"), F.floor(F.char_length(text_or_empty(text)) / 2).cast("int").alias("half"))
    placed = with_ordinal(keys.distinct(), F.col("id").desc_nulls_last(), "a", "b", name="at").select("at", "a", "b", "half")
    rows = placed.count()
    after = placed.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("at").alias("_at"))
    return placed.join(after, F.when(F.col("at") + 1 < rows, F.col("at") + 1).otherwise(0) == F.col("_at")).drop("at", "_at")


def _key(id: str, text: str) -> list[Column]:
    parts = [F.col(id).isNull(), F.col(id), text_or_empty(text)]
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b")]


def half_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, text, `marks` (fingerprint), `edited`, `edited_marks`, `next_id`, `next_hashes`
    (the distinct hashes of the next document's fingerprint).

    `edited` is the text with its last half (rounded down, in code points) replaced by as many code points, or all,
    from the beginning of the next document. A null text counts as empty; a table of one document edits it
    with itself; an empty table gives an empty one. Other columns are left out.

    Texts are dealt out once by key; only the beginnings that are needed travel on to the document before.
    """
    given = docs.select(*_key(id, text), F.col(id).alias("id"), text_or_empty(text).alias("text"))
    links = materialize(next_documents(docs, id, text))
    following = given.join(links, (given["a"] == links["next_a"]) & (given["b"] == links["next_b"])).select(
        links["a"].alias("to_a"), links["b"].alias("to_b"), F.col("id").alias("next_id"),
        F.substring(F.col("text"), F.lit(1), F.col("half")).alias("beginning"), hashes(fingerprint(F.col("text"))).alias("next_hashes"),
    )
    # One row per document, also where its follower is in the table several times.
    sent = following.groupBy("to_a", "to_b").agg(*[F.first(c).alias(c) for c in ("next_id", "beginning", "next_hashes")])
    met = given.join(sent, (given["a"] == sent["to_a"]) & (given["b"] == sent["to_b"]))
    length = F.char_length("text")
    kept = (length - F.floor(length / 2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("beginning"))
    named = met.select(F.col("id").alias(id), "text", fingerprint(F.col("text")).alias("marks"), "next_id", "next_hashes", edited.alias("edited"))
    return named.withColumn("edited_marks", fingerprint(F.col("edited")))
