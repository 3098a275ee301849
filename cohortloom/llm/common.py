"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the session has.

    One of our own only in local mode, where driver and executors are one process; on a cluster an unset folder is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        # Set by SparkContext.setCheckpointDir: a folder of its own within the one that was named.
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="cohortloom-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors and frees the shuffles behind it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that `saved` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.split("://")[-1].split(":", 1)[-1].startswith(shared_dir(spark).split("://")[-1].split(":", 1)[-1]):
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the write that needed them has ended."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of text in a column: one number, which sets how many buckets a job is dealt into."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def lower_ascii(column):
    """Lower-case A-Z alone, so that lengths and other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
