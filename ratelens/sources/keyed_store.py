"""A store of rows by key that a batch of new rows reads only a small part of.

Rows lie in one folder per part of the keys' hash. Beside them each part keeps a Bloom filter: bitmaps of 32,768 bits, of
which a key uses one, and `BITS_OF_KEY` bits in it. A key whose bits are not all set is new without a look at any row; only the
parts of the other keys are read, and of these only the key column. A filter that says too much costs a read, never a row, so
the result is exact at any size. Filters are written before rows, so a batch that failed half-way can be run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.operators.relational import first_per_key
from ratelens.session import materialize
from ratelens.sources.writers import stored_table

#: Bits of one bitmap; the size that Spark's bitmap functions have.
BITMAP_BITS = 32_768
BITS_OF_KEY = 3


@dataclass(frozen=True)
class KeyedStore:
    """A folder, the key's column, and the layout, which must stay as it was when the store was begun.

    Choose `parts` so that a part of the finished store is a few files (it is also the most folders that a batch can touch), and
    `bitmaps` at about one for every 4,000 keys of a part: then one new key in some 25 is looked for in vain.
    """

    path: str
    key: str
    parts: int = 64
    bitmaps: int = 16

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("part"), F.col(self.key)), F.lit(self.parts)).cast("int")

    def _bitmap(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("bitmap"), F.col(self.key)), F.lit(self.bitmaps)).cast("int")

    def _bits(self) -> list[Column]:
        drawn = F.xxhash64(F.lit("bits"), F.col(self.key))
        return [F.shiftrightunsigned(drawn, 15 * i).bitwiseAND(F.lit(BITMAP_BITS - 1)) for i in range(BITS_OF_KEY)]

    def _write_filters(self, rows: DataFrame) -> None:
        marked = rows.select("part", self._bitmap().alias("bitmap"), F.explode(F.array(*self._bits())).alias("bit"))
        filters = marked.groupBy("part", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
        filters.write.mode("append").partitionBy("part").parquet(f"{self.path}/filters")

    def maybe_stored(self, rows: DataFrame) -> DataFrame:
        """(key, part): the keys of `rows` that the filters cannot rule out."""
        keys = rows.select(self.key, self._part().alias("part"), self._bitmap().alias("bitmap"))
        filters = stored_table(rows, f"{self.path}/filters")
        if filters is None:
            return keys.where(F.lit(False)).select(self.key, "part")
        merged = filters.groupBy("part", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
        met = keys.join(merged, ["part", "bitmap"])
        for bit in self._bits():
            byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            met = met.where(F.pmod(F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(F.lit(7)))), F.lit(2)) == 1)
        return met.select(self.key, "part")

    def stored_keys(self, df: DataFrame, parts: list[int]) -> DataFrame | None:
        """(key, part) of the stored rows of these parts, read by the session of `df`; None if there is nothing to read."""
        rows = stored_table(df, f"{self.path}/rows") if parts else None
        return None if rows is None else rows.where(F.col("part").isin(parts)).select(self.key, "part")

    def insert(self, df: DataFrame, order: list[Column]) -> int:
        """Append rows whose key is not stored yet, of several with one key the first; returns how many parts were read.

        A missing key is a key like others. Running the same batch again adds nothing; an empty batch changes nothing. One
        writer at a time. A column named `part` is not allowed, as the folders bear this name.
        """
        if "part" in (c.lower() for c in df.columns):
            raise ValueError("a column named part cannot be stored")
        batch = materialize(first_per_key(df, [self.key], order))
        maybe = materialize(self.maybe_stored(batch))
        touched = sorted(r["part"] for r in maybe.select("part").distinct().collect())  # at most `parts` numbers
        stored = self.stored_keys(batch, touched)
        new = batch.withColumn("part", self._part())
        if stored is not None:
            same = maybe[self.key].eqNullSafe(stored[self.key]) & (maybe["part"] == stored["part"])
            known = maybe.join(stored, same, "left_semi").select(F.col(self.key).alias("known_key"), F.col("part").alias("known_part"))
            new = new.join(known, F.col(self.key).eqNullSafe(F.col("known_key")) & (F.col("part") == F.col("known_part")), "left_anti")
        new = materialize(new)
        self._write_filters(new)
        new.write.mode("append").partitionBy("part").parquet(f"{self.path}/rows")
        return len(touched)

    def rows(self, df: DataFrame) -> DataFrame | None:
        """All stored rows, read by the session of `df`; None before the first batch."""
        found = stored_table(df, f"{self.path}/rows")
        return None if found is None else found.drop("part")
