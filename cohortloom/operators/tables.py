"""Intermediate tables that a plan reads more than once, and row numbers over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the session's checkpoint folder; a temporary one in local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cohortloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: what is read twice is made once, and no executor memory is held for it."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row, from 0, in two levels: rows are sorted by ranges, and a range starts where those before it end.

    Only the ranges' totals, one row each, are brought together; rows that are equal in `order` share a range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranges.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, own = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    totals = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, own + F.col("__start")).drop("__part", "__at", "__start")


def tasks_for(spark: SparkSession, rows: int, most: int) -> int:
    """How many tasks `rows` are dealt to by a key, so that what one holds stays the same at any size: some `most` rows.

    A number of partitions that is fixed, or that Spark reckons from compressed bytes, makes a task's tables grow with the input.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table to be sent along with the tasks if its counted rows are few, and joined by a shuffle if they are not."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
