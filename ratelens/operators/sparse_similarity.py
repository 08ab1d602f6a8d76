"""Pairs of sparse vectors within a cosine distance, by an inverted index over the terms that a near pair has to share.

Terms are ordered by how many vectors have them, rare ones first. On unit vectors a similarity of t or more cannot come from the end of a
vector whose length is under t. So two near vectors share a term among the first terms of both: those that the end
from which on is t long or longer. Only these are indexed, and the first of them that a pair shares bounds the pair: the product there plus
the product of the lengths of what follows. A term that many vectors begin with is cut into blocks, each pair of blocks its own key.
Candidates that are left are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.functions.scalars import significant
from ratelens.operators.similarity import fold_copies
from ratelens.session import materialize

#: Vectors of one term in a block.
BLOCK_ROWS = 2048
_SLACK = 1e-9  # rounding slack; only lets more candidates in


def _unit(vector: Column) -> Column:
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]))
    held = F.array(F.struct(vector.alias("v"), length.alias("length")))
    return F.get(F.transform(held, lambda h: F.transform(h["v"], lambda e: F.struct(e["term"].alias("term"), (e["weight"] / h["length"]).alias("weight")))), 0)


def first_terms(vectors: DataFrame, similarity: float) -> DataFrame:
    """(id, term, weight, rest): of each unit vector (id, vector) the terms to index, with the squared length from each one on."""
    entries = vectors.select("id", F.explode("vector").alias("e")).select("id", "e.term", "e.weight")
    spread = materialize(entries.groupBy("term").agg(F.count("*").alias("n")))
    placed = entries.join(spread, "term")
    # A vector's own terms: as many as the vector has.
    onward = Window.partitionBy("id").orderBy("n", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = placed.withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(onward))
    return ranked.where(F.sqrt("rest") >= similarity - _SLACK).select("id", "term", "weight", "rest")


def candidate_pairs(vectors: DataFrame, similarity: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id1 < id2) once for each pair of unit vectors (id, vector) that could be so similar; no such pair is missing."""
    listed = materialize(first_terms(vectors, similarity))
    blocks = materialize(listed.groupBy("term").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = listed.join(blocks, "term").select("term", "id", "weight", "rest", "blocks", own.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    # Two vectors of blocks i and j meet under the key (min, max), from both sides of it.
    keyed = dealt.select("*", other).select("term", "id", "weight", "rest", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    names = ("term", "id", "weight", "rest", "own", "low", "high")
    left = keyed.where("own = low").toDF(*[f"l_{n}" for n in names])
    right = keyed.where("own = high").toDF(*[f"r_{n}" for n in names])
    same = (F.col("l_term") == F.col("r_term")) & (F.col("l_low") == F.col("r_low")) & (F.col("l_high") == F.col("r_high"))
    after = F.sqrt(F.greatest(F.lit(0.0), F.col("l_rest") - F.col("l_weight") ** 2) * F.greatest(F.lit(0.0), F.col("r_rest") - F.col("r_weight") ** 2))
    could = F.col("l_weight") * F.col("r_weight") + after >= similarity - _SLACK
    # Within one block the pair is met from both ends, between two blocks once: then either may have the smaller id.
    once = (F.col("l_low") < F.col("l_high")) | (F.col("l_id") < F.col("r_id"))
    met = left.join(right, same & could & once)
    return met.select(F.least("l_id", "r_id").alias("id1"), F.greatest("l_id", "r_id").alias("id2")).distinct()


def similar_sparse_items(
    entries: DataFrame, id_col: str, term_col: str, weight_col: str, max_distance: float, digits: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(item_id1 < item_id2, distance) for all pairs of different vectors within `max_distance` (under 1).

    `entries` has one row for each term of an item; weights are not negative, and rows with a missing value or weight 0 are left out. Equal vectors
    stand in the result once, under their lowest id; each further copy is one row (lowest id, copy, 0).
    """
    if not 0 <= max_distance < 1:
        raise ValueError("vectors without a common term have distance 1: the bound must be under it")
    similarity = 1.0 - max_distance
    given = entries.select(F.col(id_col).cast("long").alias("id"), F.col(term_col).alias("term"), F.col(weight_col).cast("double").alias("weight"))
    listed = given.dropna().where("weight > 0").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("vector"))
    kept, copies = fold_copies(materialize(listed), "id", "vector")
    units = materialize(kept.select("id", _unit(F.col("vector")).alias("vector")))
    pairs = materialize(candidate_pairs(units, similarity, block_rows))
    first, second = units.toDF("id1", "v1"), units.select(F.col("id").alias("id2"), F.map_from_entries("vector").alias("m2"))
    both = pairs.join(first, "id1").join(second, "id2")
    product = F.aggregate("v1", F.lit(0.0), lambda s, e: s + e["weight"] * F.coalesce(F.element_at("m2", e["term"]), F.lit(0.0)))
    found = both.select(F.col("id1").alias("item_id1"), F.col("id2").alias("item_id2"), (1.0 - product).alias("distance")).where(F.col("distance") <= max_distance)
    same = copies.select(F.col("kept").alias("item_id1"), F.col("copy").alias("item_id2"), F.lit(0.0).alias("distance"))
    return found.withColumn("distance", significant("distance", digits)).unionByName(same)
