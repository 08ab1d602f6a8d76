"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "ratelens", **conf: str) -> SparkSession:
    """Session with the library's defaults; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: `spark.checkpoint.dir`, else one beside the warehouse, which is shared too."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    context.setCheckpointDir(configured)
    return configured


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the checkpoint folder and read it from there on.

    The files are shared, so a lost executor cannot make a second pass see other rows or
    another partitioning than the first one did; later passes read only the columns they
    use. The planner knows the table's size, so it broadcasts a small one; with a large one
    it can still split a hot key of the other side, which it cannot do against an aggregate
    that feeds the join directly.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "table")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a scan out to all cores when it has fewer pieces than there are cores.

    For work that is heavy per row. A large input has more pieces than cores and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` returned and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, False)


def release_materialized(spark: SparkSession) -> None:
    """Delete the tables that `materialize` wrote in this session, once their results are used up."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
