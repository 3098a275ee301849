"""Running sums and products over long ordered groups in two levels.

A plain window puts a whole group into one task. Here the order is cut into blocks, each block is totalled, the few
totals run over the blocks, and rows get the total of the blocks before theirs plus their own running value. Groups
with many distinct times so spread over as many tasks as they have blocks, and the result is that of one window.
Blocks end at quantiles of the order, so they hold about as many rows each however the values are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCKS = 64
PRECISION = 0.002


def quantile_block(df: DataFrame, order: str, blocks: int = BLOCKS) -> Column:
    """The number of the block of a row, by the quantiles of the order: one job, which brings at most `blocks` numbers to the driver."""
    edges = sorted({e for e in df.approxQuantile(order, [k / blocks for k in range(1, blocks)], PRECISION)} if blocks > 1 else set())
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order))) if edges else F.lit(0)


def running(df: DataFrame, by: list[str], block: Column, order: str, sums: dict[str, str] | None = None, products: dict[str, str] | None = None, inclusive: bool = True) -> DataFrame:
    """Adds running sums and products of columns, by the names of the outputs; rows of a group must be distinct in `order`."""
    made = [(k, v, F.sum, 0.0, lambda a, b: a + b) for k, v in (sums or {}).items()] + [(k, v, F.product, 1.0, lambda a, b: a * b) for k, v in (products or {}).items()]
    rows = df.withColumn("__block", block)
    totals = rows.groupBy(*by, "__block").agg(*[make(v).alias(f"__t_{k}") for k, v, make, _, _ in made])
    before = W.partitionBy(*by).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    # Rows without a group are a group of their own.
    totals = totals.select(*[F.col(c).alias(f"__g_{i}") for i, c in enumerate(by)], F.col("__block").alias("__of"), *[F.coalesce(make(f"__t_{k}").over(before), F.lit(neutral)).alias(f"__b_{k}") for k, _, make, neutral, _ in made])
    own = W.partitionBy(*by, "__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    met = F.col("__block") == F.col("__of")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"__g_{i}"))
    joined = rows.join(totals, met)
    return joined.select(*df.columns, *[join(F.col(f"__b_{k}"), F.coalesce(make(v).over(own), F.lit(neutral))).alias(k) for k, v, make, neutral, join in made])


def running_sums(df: DataFrame, by: list[str], block: Column, order: str, outputs: dict[str, str], inclusive: bool = True) -> DataFrame:
    return running(df, by, block, order, outputs, None, inclusive)


def running_products(df: DataFrame, by: list[str], block: Column, order: str, outputs: dict[str, str]) -> DataFrame:
    return running(df, by, block, order, None, outputs)
