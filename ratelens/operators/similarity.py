"""Item pairs within a cosine distance, exact, without comparing every item with every other.

On unit vectors a cosine distance t is the Euclidean distance sqrt(2 t). Items go to the
cell of their nearest pivot, and also to each cell whose border is no farther than that
distance; two items in reach of each other then share a cell, and the cell is an equi-join
key. Cells are cut into blocks of bounded size, so a crowded one is spread over many tasks.
Equal vectors are folded into one before anything is compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.functions.scalars import significant
from ratelens.functions.vectors import norm
from ratelens.session import materialize

MAX_PIVOTS = 4096
BLOCK_ROWS = 8192  # of 64 numbers: 4 MB a side
_COMPARE_ROWS = 512
_ASSIGN_ROWS = 1024
_SLACK = 1e-9  # rounding slack; only lets more candidates in


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def fold_copies(items: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """Lowest id per distinct vector, and (kept id, copy id) for the others."""
    kept = materialize(items.groupBy(vector_col).agg(F.min(id_col).alias("kept"), F.count("*").alias("_n")))
    repeated = kept.where(F.col("_n") > 1).select(vector_col, "kept")
    copies = items.join(repeated, vector_col).where(F.col(id_col) != F.col("kept"))
    return (
        kept.select(F.col("kept").alias(id_col), vector_col),
        copies.select("kept", F.col(id_col).alias("copy")),
    )


def _assign_cells(units: DataFrame, pivots: np.ndarray, reach: float) -> DataFrame:
    between = np.sqrt(np.maximum(2.0 - 2.0 * pivots @ pivots.T, 0.0))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        squared = 2.0 - 2.0 * _matrix(rows["unit"]) @ pivots.T
        home = squared.argmin(axis=1)
        own = np.arange(len(home))
        near = squared - squared[own, home][:, None] <= 2.0 * reach * between[home] + _SLACK
        near[own, home] = True
        return rows.assign(home=home.astype("int32"), cells=[np.flatnonzero(r).astype("int32") for r in near])

    def assign(batches):
        for batch in batches:
            for start in range(0, len(batch), _ASSIGN_ROWS):
                yield place(batch.iloc[start : start + _ASSIGN_ROWS])

    return units.mapInPandas(assign, "id long, unit array<double>, home int, cells array<int>")


def _compare(max_distance: float):
    columns = ["item_id1", "item_id2", "distance"]

    def compare(key, home: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if home.empty or near.empty:
            return pd.DataFrame(columns=columns)
        cell = key[0]
        ids, other_ids, other = home["id"].to_numpy(), near["id"].to_numpy(), near["home"].to_numpy()
        units, turned = _matrix(home["unit"]), _matrix(near["unit"]).T
        found = []
        for start in range(0, len(ids), _COMPARE_ROWS):
            distance = 1.0 - units[start : start + _COMPARE_ROWS] @ turned
            rows, cols = np.nonzero(distance <= max_distance)
            a, b = ids[start + rows], other_ids[cols]
            # Within a cell each pair is met from either end; keep one of the two.
            once = (other[cols] != cell) | (a < b)
            low, high = np.minimum(a, b)[once], np.maximum(a, b)[once]
            found.append(pd.DataFrame({"item_id1": low, "item_id2": high, "distance": distance[rows, cols][once]}))
        return pd.concat(found, ignore_index=True)

    return compare


def similar_items(
    items: DataFrame,
    id_col: str,
    vector_col: str,
    max_distance: float,
    digits: int = 5,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(item_id1 < item_id2, distance) for all pairs of different vectors within `max_distance`.

    Equal vectors stand in the result once, under their lowest id; each further copy is one
    row (lowest id, copy, 0). All-zero vectors have no distance to anything. With
    `max_distance=2` every pair of different vectors is in reach.
    """
    # Written first: it is read twice, and vectors made of many columns would be rebuilt at each use.
    vectors = materialize(
        items.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    ).where(norm("vector") > 0)
    kept, copies = fold_copies(vectors, "id", "vector")
    length = norm("vector")
    # Read several times below: counted, sampled for pivots, and assigned to cells.
    units = materialize(
        kept.withColumn("_length", length).select("id", F.transform("vector", lambda x: x / F.col("_length")).alias("unit"))
    )
    total = units.count()
    wanted = max(1, min(max_pivots, math.ceil(total / block_rows)))
    chosen = units.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # at most max_pivots vectors
    same_as_kept = copies.select(
        F.col("kept").alias("item_id1"), F.col("copy").alias("item_id2"), F.lit(0.0).alias("distance")
    )
    if not chosen:
        return same_as_kept
    pivots = np.array([r["unit"] for r in chosen])
    reach = math.sqrt(2.0 * max_distance)
    placed = materialize(_assign_cells(units, pivots, reach))
    # Two cells meet in the first of them alone: an item goes to the cells before its own, and the items of those after it come to it.
    spread = placed.select("id", "unit", "home", F.explode(F.filter("cells", lambda c: c <= F.col("home"))).alias("cell"))

    is_home = F.col("home") == F.col("cell")
    blocks = (
        spread.groupBy("cell")
        .agg(F.count_if(is_home).alias("n_home"), F.count("*").alias("n_near"))
        .select(
            "cell",
            F.ceil(F.col("n_home") / block_rows).cast("int").alias("home_blocks"),
            F.ceil(F.col("n_near") / block_rows).cast("int").alias("near_blocks"),
        )
        .where("home_blocks > 0")
    )
    sized = spread.join(F.broadcast(blocks), "cell")  # at most max_pivots rows
    sized = sized.select("cell", "id", "unit", "home", "home_blocks", "near_blocks")

    def block(count: str):
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # toDF gives the two sides their own columns.
    names = ("cell", "id", "unit", "home", "i", "j")
    home_side = (
        sized.where(is_home)
        .select("cell", "id", "unit", "home", block("home_blocks").alias("i"), every("near_blocks").alias("j"))
        .toDF(*names)
    )
    near_side = sized.select(
        "cell", "id", "unit", "home", every("home_blocks").alias("i"), block("near_blocks").alias("j")
    ).toDF(*names)
    pairs = (
        home_side.groupBy("cell", "i", "j")
        .cogroup(near_side.groupBy("cell", "i", "j"))
        .applyInPandas(_compare(max_distance), "item_id1 long, item_id2 long, distance double")
    )
    return pairs.withColumn("distance", significant("distance", digits)).unionByName(same_as_kept)
