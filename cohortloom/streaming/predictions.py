"""Predictions that arrive over time: deduplicated attempts and windowed accuracy.

The batch operators read finished tables; these two keep the same rules for files that keep arriving, with watermarks
so that their state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("request_sha256", T.StringType()), T.StructField("scored_at", T.TimestampType()), T.StructField("truth", T.StringType()),
    T.StructField("predicted", T.StringType()), T.StructField("accepted", T.BooleanType()),
])


def attempts(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Answers from a folder of Parquet files, each request once within the watermark, which is set here and nowhere else."""
    rows = spark.readStream.schema(SCHEMA).parquet(path)
    return rows.withWatermark("scored_at", late).dropDuplicatesWithinWatermark(["request_sha256"])


def windowed_accuracy(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """(window, eligible, failed, coverage, top1) per window; failures (no prediction) stay in the denominators.

    Rows of a stream come with their watermark (`attempts` sets it).
    """
    n = F.count(F.lit(1))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy(F.window("scored_at", window)).agg(
        n.alias("eligible"), yes(F.col("predicted").isNull()).alias("failed"), (yes(F.col("accepted") & F.col("predicted").isNotNull()) / n).alias("coverage"), (yes(F.col("predicted") == F.col("truth")) / n).alias("top1")
    )
