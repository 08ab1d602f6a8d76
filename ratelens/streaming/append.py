"""The batch append of new ratings, run on each micro-batch of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ratelens.plans.ratings import append_ratings
from ratelens.session import materialize
from ratelens.sources.writers import stored_table


def _with_batch(table: DataFrame) -> DataFrame:
    return table if "batch_no" in table.columns else table.withColumn("batch_no", F.lit(None).cast("long"))


def _holds(table: DataFrame, batch_id: int) -> bool:
    return bool(table.where(F.col("batch_no") == batch_id).head(1))


def append_stream(
    arriving: DataFrame,
    ratings_path: str,
    rejected_path: str,
    items: DataFrame,
    order: list[Column],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append (user_name, item, taste) rows to the rating table at `ratings_path`.

    Both tables keep the number of the batch that a row came with (`batch_no`; rows stored before have none). A batch
    that is run again is decided against the rows of other batches, as it was the first time, and each table takes
    its rows only if it has none of that batch. The stream is the only writer of the tables.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        table = _with_batch(batch.sparkSession.read.option("mergeSchema", True).parquet(ratings_path))
        stored = table.where(~F.col("batch_no").eqNullSafe(F.lit(batch_id)))
        accepted, rejected = append_ratings(stored, batch, items, order)
        # Decided against the table as it is before the append below changes it.
        accepted, rejected = materialize(accepted), materialize(rejected)
        number = F.lit(batch_id).cast("long")
        if not _holds(table, batch_id):
            accepted.withColumn("batch_no", number).select(*stored.columns).write.mode("append").parquet(ratings_path)
        before = stored_table(rejected, rejected_path)
        if before is None or not _holds(_with_batch(before), batch_id):
            rejected.withColumn("batch_no", number).write.mode("append").parquet(rejected_path)

    writer = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
