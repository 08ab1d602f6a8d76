"""Shards by jump consistent hashing (Lamping and Veach), in Spark's own functions only.

Law `key`: a row's shard follows from its key and the number of shards alone. With one shard more, a row
either stays or moves into the new shard, and on average 1 in n + 1 rows moves. There is no ring table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.llm.common import fresh, number_within, replaced

# The multiplier of the method's generator x -> 2862933555777941757 x + 1 (modulo 2^64), in 32-bit halves.
MULTIPLIER_HIGH = 2862933555777941757 >> 32
MULTIPLIER_LOW = 2862933555777941757 & 0xFFFFFFFF

#: Jumps made for every row; the few rows that need more go on in a second loop.
FIRST_JUMPS = 48
_LOW = 0xFFFFFFFF


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _times(x: Column, factor: int) -> tuple[Column, Column]:
    """A 32-bit number times a 32-bit constant in two parts, so that no product passes 2^63: a + (b << 16)."""
    return x * F.lit(factor & 0xFFFF), x * F.lit(factor >> 16)


def _times_modulo(x: Column, factor: int) -> Column:
    a, b = _times(x, factor)
    return _low(a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16))


def _jump(state: Column, shards: int) -> Column:
    """One step of the generator and the jump after it; a state past the last shard stays as it is."""
    high, low = state["high"], state["low"]
    a, b = _times(low, MULTIPLIER_LOW)
    bottom = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    top = F.shiftright(bottom, 32) + F.shiftright(b, 16)
    next_low = _low(bottom)
    next_high = _low(top + _times_modulo(high, MULTIPLIER_LOW) + _times_modulo(low, MULTIPLIER_HIGH))
    drawn = (F.shiftright(next_high, 1) + 1).cast("double")
    to = F.floor((state["next"] + 1).cast("double") * (F.lit(2147483648.0) / drawn))
    moved = F.struct(next_high.alias("high"), next_low.alias("low"), state["next"].alias("at"), to.alias("next"))
    return F.when(state["next"] >= shards, state).otherwise(moved)


def key_halves(df: DataFrame, key: str) -> tuple[Column, Column]:
    """The 64 bits that a key stands for: an integer itself, other types the first 64 bits of the md5 of their text.

    A missing key counts as 0 or as an empty text.
    """
    kind = dict(df.dtypes)[key]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        whole = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
        return F.shiftrightunsigned(whole, 32), _low(whole)
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return part(1), part(9)


def jump(high: Column, low: Column, shards: int) -> Column:
    """Struct (at, next): the shard among `shards`, and the first jump past them, which is `shards` itself
    exactly if the row moves into a shard that is appended."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    start = F.struct(high.alias("high"), low.alias("low"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    steps = lambda n: F.sequence(F.lit(1), F.lit(n))
    end = F.aggregate(steps(min(shards, FIRST_JUMPS)), start, lambda s, _: _jump(s, shards))
    if shards > FIRST_JUMPS:  # as many jumps as there are shards can be needed, and no more
        end = F.aggregate(
            F.array(F.lit(1)), end,
            lambda s, _: F.when(s["next"] >= shards, s).otherwise(
                F.aggregate(steps(shards - FIRST_JUMPS), s, lambda t, _: _jump(t, shards))
            ),
        )
    return end


def with_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Add `shard` (0 to shards - 1) and `grown_shard`, the shard if there were one shard more.

    Columns of these names are replaced. Equal keys share a shard; a missing key has one too. Each row is
    judged alone: no shuffle, and the number of rows plays no part.
    """
    high, low = key_halves(df, key)
    at = jump(high, low, shards)
    (jumped,) = fresh(df, "jumped")
    placed = df.withColumn(jumped, at)
    grown = F.when(F.col(f"{jumped}.next") == shards, F.lit(shards)).otherwise(F.col(f"{jumped}.at"))
    return replaced(placed, shard=F.col(f"{jumped}.at").cast("int"), grown_shard=grown.cast("int")).drop(jumped)


def shard_rows(df: DataFrame, key: str, shards: int, order: list[str]) -> DataFrame:
    """`with_shards` plus `slot`, the row's place in its shard: 0, 1, 2 and so on without a gap.

    `order` should identify a row; rows equal on it take neighbouring slots in any order. An empty table
    gives an empty one. A shard's rows are numbered bucket by bucket, never all in one task.
    """
    return number_within(with_shards(df, key, shards), ["shard"], order, "slot", rows=df.count())
