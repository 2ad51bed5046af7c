"""What the operators need of a session: sizes, checkpoints, dense numbers without one big task."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside are removed as each ends; the session's setting comes back afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder in spark.checkpoint.dir; only a local session (tests) may leave that unset.  Shuffle files before the cut go.

    The driver's JVM collects its garbage here as well.  Left alone it widens its heap first, up to all that it may have, and keeps
    plans, broadcasts and files of former cuts until then.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    gc.collect()  # plans before the cut, which the driver's JVM keeps as long as Python has names for them; it is told of these meanwhile
    with freeing(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)
    pa.default_memory_pool().release_unused()
    context._jvm.System.gc()
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def numbered(df: DataFrame, group: str, bucket: Column, order: list[Column], name: str, size: Column | None = None) -> DataFrame:
    """Add `name`: rows before this one in its group by `order` (with `size`: the sum of sizes before it).

    `bucket` is a long that never falls along the order and cuts any group into ranges small enough for one task; the
    ranges' totals are added up in a table of groups x buckets rows.  So no task sees a whole group, however large that is.
    Names with an underscore are this function's own; callers keep their rows in a struct.
    """
    cut = df.withColumn("_bucket", bucket)
    what = F.count(F.lit(1)) if size is None else F.coalesce(F.sum(size), F.lit(0))
    totals = cut.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_at")).agg(what.alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_group", "_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    local = F.row_number().over(inside) - 1 if size is None else F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.withColumn("_local", local)
    joined = ranked.join(totals, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at")))
    return joined.withColumn(name, (F.col("_local") + F.col("_base")).cast("long")).drop("_bucket", "_group", "_at", "_base", "_local")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most so many rows in this session: whole texts are long, and both sides hold a batch at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
