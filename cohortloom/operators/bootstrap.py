"""Patient-clustered percentile bootstrap by counter-based random draws.

Draw k of a generator with seed s is a function of s + (k+1) * increment alone, so every replicate makes its own draws
and nothing is sequential. Records collapse to counts per cluster and (truth, predicted); a replicate turns draws into
multiplicities of clusters and joins them to those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.stats import ratio
from cohortloom.operators.tables import row_numbers, small

# The SplitMix64 generator.
INCREMENT = 0x9E3779B97F4A7C15
MIX1 = 0xBF58476D1CE4E5B9
MIX2 = 0x94D049BB133111EB
MASK = (1 << 64) - 1
MOST_DRAWS = 10_000_000


def draws_at(seed: int, positions: np.ndarray) -> np.ndarray:
    """The draws at some positions of the generator's sequence, as uint64."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & MASK) + (positions.astype(np.uint64) + np.uint64(1)) * np.uint64(INCREMENT)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX2)
        return z ^ (z >> np.uint64(31))


def draws(seed: int, start: int, n: int) -> np.ndarray:
    """Draws start .. start+n-1 of the generator."""
    return draws_at(seed, np.arange(start, start + n, dtype=np.uint64))


def unit(seed: int, start: int, n: int) -> np.ndarray:
    """Numbers between 0 and 1, both left out: the middles of 2**53 steps, by the upper 53 bits."""
    return ((draws(seed, start, n) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def passed_over(seed: int, n: int, of: int, block: int = 1 << 20) -> list[int]:
    """Positions of the draws that unbiased indexes below `of` pass over, among those that the first n indexes need.

    They are the draws beyond the largest multiple of `of`, `of` in 2**64 of all, so the list is short and mostly empty.
    """
    bound, found, at = np.uint64(_bound(of)), [], 0
    while at < n + len(found):
        size = min(block, n + len(found) - at)
        found += (np.flatnonzero(draws(seed, at, size) >= bound) + at).tolist()
        at += size
    return found


def _bound(of: int) -> int:
    return MASK - MASK % of


def indexes(seed: int, start: int, n: int, of: int, skipped: list[int] | None = None) -> np.ndarray:
    """Unbiased indexes start .. start+n-1 below `of`; `skipped`: the positions that `passed_over` found."""
    at = np.arange(start, start + n, dtype=np.uint64)
    for position in skipped or []:
        at[at >= np.uint64(position)] += np.uint64(1)
    return (draws_at(seed, at) % np.uint64(of)).astype(np.int64)


def permutations(seed: int, pairs: np.ndarray, n: int) -> np.ndarray:
    """Fisher-Yates from the end with draws modulo i+1, a row for each number of a permutation; permutation p takes draws p*(n-1) on."""
    orders, rows, first = np.tile(np.arange(n), (len(pairs), 1)), np.arange(len(pairs)), pairs.astype(np.uint64) * np.uint64(max(1, n - 1))
    for k, i in enumerate(range(n - 1, 0, -1)):
        j = (draws_at(seed, first + np.uint64(k)) % np.uint64(i + 1)).astype(np.int64)
        orders[rows, i], orders[rows, j] = orders[rows, j], orders[rows, i].copy()
    return orders


def _measures(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., top1, weighted_f1) from (by..., truth, predicted, n); predictions outside the classes are null."""
    long = counts.select(*by, F.explode(F.array(
        F.struct(F.col("truth").alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("predicted").alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")),
    )).alias("x")).select(*by, "x.*").where("c is not null")
    each = long.groupBy(*by, "c").agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    f1 = F.coalesce(ratio(2.0 * F.col("h") * F.col("s"), F.col("s") + F.col("p")), F.lit(0.0))
    return each.groupBy(*by).agg(ratio(F.sum("h"), F.sum("s")).alias("top1"), ratio(F.sum(f1), F.sum("s")).alias("weighted_f1"))


def replicate_measures(rows: DataFrame, classes: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(replicate, top1, weighted_f1); replicate -1 is the full sample. rows: patient_group_id, truth, predicted.

    With fewer than two patient groups there are no replicates, and `intervals` gives the reason.
    """
    if not 100 <= replicates <= 1000:
        raise ValueError("100 to 1,000 replicates")
    known = small(classes.select(F.col("class_id").alias("predicted"), F.lit(True).alias("__known")))
    cells = rows.join(known, "predicted", "left").groupBy("patient_group_id", "truth", F.when(F.col("__known"), F.col("predicted")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    numbered = row_numbers(rows.select("patient_group_id").distinct(), ["patient_group_id"], "cluster")
    size = numbered.count()
    if size < 2:
        return rows.sparkSession.createDataFrame([], _measures(cells.withColumn("replicate", F.lit(-1).cast("long")), ["replicate"]).schema)
    if size * replicates > MOST_DRAWS:
        raise ValueError(f"{size} patient groups in {replicates} replicates are more than {MOST_DRAWS} draws")
    skipped = passed_over(seed, size * replicates, size)

    def multiplicities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch["id"]:
                counts = np.bincount(indexes(seed, int(r) * size, size, size, skipped), minlength=size)
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"replicate": np.int64(r), "cluster": at, "times": counts[at]})

    drawn = rows.sparkSession.range(replicates).repartition(min(replicates, 64), "id").mapInPandas(multiplicities, "replicate long, cluster long, times long")
    once = numbered.select(F.lit(-1).cast("long").alias("replicate"), F.col("cluster").cast("long").alias("cluster"), F.lit(1).cast("long").alias("times"))
    weighed = drawn.unionByName(once).join(numbered, "cluster").join(cells, "patient_group_id")
    counts = weighed.groupBy("replicate", "truth", "predicted").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    return _measures(counts, ["replicate"])


TOO_FEW = "fewer than two patient groups"


def intervals(measures: DataFrame) -> DataFrame:
    """(measure, estimate, lower, upper, reason): the full sample and the 2.5 and 97.5 percentiles of the replicates.

    Without replicates the three are null and `reason` says why; it is null otherwise.
    """
    names = measures.sparkSession.createDataFrame([("top1",), ("weighted_f1",)], "measure string")
    long = measures.unpivot(["replicate"], ["top1", "weighted_f1"], "measure", "value")
    again = F.when(F.col("replicate") >= 0, F.col("value"))
    made = long.groupBy("measure").agg(F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("estimate"), F.percentile(again, 0.025).alias("lower"), F.percentile(again, 0.975).alias("upper"), F.lit(True).alias("__made"))
    return names.join(made, "measure", "left").select("measure", "estimate", "lower", "upper", F.when(F.col("__made").isNull(), TOO_FEW).alias("reason"))
