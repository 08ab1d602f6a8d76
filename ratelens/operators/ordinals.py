"""Global positions, dense ids and group ranks without a single-task sort.

A window without a partition key sends every row to one task, and one with few keys
sends a group to one. Here rows are range-partitioned on the whole sort key, numbered
inside their partition, and shifted by the sizes of the partitions before them.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_ordinal(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Add the 0-based global position of each row under `order`.

    `order` must identify a row, so that equal keys cannot pile up in one range.
    """
    row = "_row"
    while row in {c.lower() for c in df.columns}:
        row = f"_{row}"
    marked = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(row, F.monotonically_increasing_id())
    )
    stable = materialize(marked)
    part = F.shiftright(row, _ROW_BITS)
    # One row per partition reaches the driver, whatever the table size.
    sizes = {r["part"]: r["n"] for r in stable.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return stable.withColumn(name, F.col(row)).drop(row)
    counts = [sizes.get(p, 0) for p in range(max(sizes) + 1)]
    starts = [0, *accumulate(counts[:-1])]
    offsets = F.expr("array(" + ",".join(f"{s}L" for s in starts) + ")")
    within = F.col(row).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    offset = F.get(offsets, part.cast("int"))
    return stable.withColumn(name, within + offset).drop(row)


def dense_id_tables(df: DataFrame, ids: dict[str, str]) -> dict[str, DataFrame]:
    """For each name column its (name, id) table: one row per distinct non-null name, ids 0..n-1 by name.

    All columns share one pass over `df`.
    """
    kinds = list(ids)
    named = (
        df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("name")) for i, k in enumerate(kinds)])))
        .select("col.kind", "col.name")
        .where(F.col("name").isNotNull())
        .distinct()
    )
    placed = with_ordinal(named, "kind", "name", name="_position")
    # One row per column reaches the driver.
    firsts = {r["kind"]: r["first"] for r in placed.groupBy("kind").agg(F.min("_position").alias("first")).collect()}
    return {
        k: placed.where(F.col("kind") == i).select(
            F.col("name").alias(k), (F.col("_position") - firsts.get(i, 0)).cast("int").alias(ids[k])
        )
        for i, k in enumerate(kinds)
    }


def dense_ids(df: DataFrame, key: str, id_name: str) -> DataFrame:
    """One row per distinct non-null `key` with ids 0..n-1 in key order."""
    return dense_id_tables(df, {key: id_name})[key]


def new_ids(known: DataFrame, incoming: DataFrame, key: str, id_name: str) -> DataFrame:
    """Ids for keys of `incoming` that `known` (key, id) lacks, counting on from its maximum."""
    unseen = incoming.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    highest = known.agg(F.coalesce(F.max(id_name), F.lit(-1)).alias("highest")).scalar()
    placed = with_ordinal(unseen, key, name="_position")
    return placed.select(key, (F.col("_position") + highest + 1).cast("int").alias(id_name))


def group_rank(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position inside each group; a group may be larger than one task can sort.

    `groups` plus `order` must identify a row.
    """
    placed = with_ordinal(df, *groups, *order, name="_position")
    firsts = materialize(placed.groupBy(*groups).agg(F.min("_position").alias("_first")))
    ranked = placed.join(firsts, groups)
    return ranked.withColumn(name, (F.col("_position") - F.col("_first") + 1).cast("int")).drop("_position", "_first")


def top_k_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; each map task keeps only k rows per group before the exchange."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
