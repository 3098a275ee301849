"""Mutation spectra over 96 channels and their non-negative refit to a catalogue of signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
CHANGES = [(r, a) for r in "CT" for a in BASES if a != r]
CHANNELS = [f"{left}[{r}>{a}]{right}" for r, a in CHANGES for left in BASES for right in BASES]


def channels(spark: SparkSession) -> DataFrame:
    """(channel, number) of all 96, from the rule: six pyrimidine changes by the base on each side."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(CHANNELS)], "channel string, number int")


def channel(context: Column, alternate: Column) -> Column:
    """Channel of a change of the middle base of a context of three; purines are read on the other strand. Null if not one."""
    middle = F.substring(context, 2, 1)
    purine = middle.isin("A", "G")
    other = lambda c: F.translate(c, "ACGT", "TGCA")
    ctx = F.when(purine, F.reverse(other(context))).otherwise(context)
    alt = F.when(purine, other(alternate)).otherwise(alternate)
    name = F.concat(F.substring(ctx, 1, 1), F.lit("["), F.substring(ctx, 2, 1), F.lit(">"), alt, F.lit("]"), F.substring(ctx, 3, 1))
    ok = F.rlike(context, F.lit(r"\A[ACGT]{3}\z")) & F.rlike(alternate, F.lit(r"\A[ACGT]\z")) & (alternate != middle)
    return F.when(ok, name)


def variant_problems(variants: DataFrame, build: str) -> DataFrame:
    """(sample_id, chromosome, position, problem): duplicates, another build, or a reference base that isn't the context's."""
    keys = ["sample_id", "chromosome", "position", "reference", "alternate"]
    place = ["sample_id", "chromosome", "position"]
    twice = variants.groupBy(*keys).count().where("count > 1").select(*place, F.lit("duplicate variant").alias("problem"))
    other = variants.where(F.col("build") != build).select(*place, F.lit("another build").alias("problem"))
    wrong = variants.where((F.length("reference") == 1) & (F.substring("context", 2, 1) != F.col("reference"))).select(*place, F.lit("reference mismatch").alias("problem"))
    return twice.unionByName(other).unionByName(wrong)


def spectrum(variants: DataFrame) -> DataFrame:
    """(sample_id, channel, number, n) of somatic single-base changes, all 96 channels for each sample."""
    spark = variants.sparkSession
    single = variants.where(F.col("somatic") & (F.length("reference") == 1) & (F.length("alternate") == 1)).withColumn("channel", channel(F.col("context"), F.col("alternate"))).where("channel is not null")
    counts = single.groupBy("sample_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    every = counts.select("sample_id").distinct().crossJoin(F.broadcast(channels(spark)))  # 96 rows
    return every.join(counts, ["sample_id", "channel"], "left").fillna(0, ["n"])


def with_context(variants: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Adds the context of three bases from (chromosome, chunk, sequence), where chunk k holds bases k*size+1 .. (k+1)*size and one more on each side."""
    chunk = F.floor((F.col("position") - 1) / size)
    at = F.col("position") - chunk * size
    return variants.withColumn("chunk", chunk).join(chunks, ["chromosome", "chunk"], "left").withColumn("context", F.upper(F.substring("sequence", at.cast("int"), F.lit(3)))).drop("chunk", "sequence")


def catalogue_problems(catalogue: DataFrame) -> DataFrame:
    """(signature, problem) of a catalogue (signature, channel, weight): 96 channels, none negative, sum 1."""
    known = catalogue.join(F.broadcast(channels(catalogue.sparkSession)), "channel", "left")
    sums = known.groupBy("signature").agg(F.count("number").alias("known"), F.count(F.lit(1)).alias("n"), F.min("weight").alias("least"), F.sum("weight").alias("total"))
    problem = F.when((F.col("known") != 96) | (F.col("n") != 96), "not the 96 channels").when(F.col("least") < 0, "negative weight").when(F.abs(F.col("total") - 1) > 1e-6, "weights don't sum to one")
    return sums.select("signature", problem.alias("problem")).where("problem is not null")


SWEEPS, CHANGE, MOST_SIGNATURES, ROWS_AT_ONCE = 5000, 1e-9, 128, 256


def nnls(matrix: np.ndarray, counts: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-negative least squares of many spectra at once by cyclic coordinate descent: exposures, reconstructions, sweeps and whether they converged.

    matrix: channels x columns; counts: spectra x channels. A column is one product over all spectra that still change; a
    spectrum stops once no exposure moved by `CHANGE` of its total in a sweep.
    """
    x, rest = np.zeros((len(counts), matrix.shape[1])), counts.astype(float).copy()
    norms, small = (matrix**2).sum(axis=0), CHANGE * counts.sum(axis=1)
    done, took = np.zeros(len(counts), dtype=bool), np.zeros(len(counts), dtype=np.int64)
    for sweep in range(1, sweeps + 1):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        own, left, most = x[at], rest[at], np.zeros(len(at))
        for j in np.flatnonzero(norms > 0):
            new = np.maximum(own[:, j] + left @ matrix[:, j] / norms[j], 0.0)
            change = new - own[:, j]
            own[:, j] = new
            left -= np.outer(change, matrix[:, j])
            most = np.maximum(most, np.abs(change))
        x[at], rest[at], took[at] = own, left, sweep
        done[at] = most < small[at]
    return x, counts - rest, took, done


def refit(spectra: DataFrame, catalogue: DataFrame, least_mutations: int = 50) -> DataFrame:
    """(sample_id, signature, exposure, mutations, relative_residual, cosine, iterations, converged) of samples with enough mutations.

    Spectra are fitted in Arrow blocks, each a matrix beside the catalogue's; a catalogue of at most 128 signatures goes
    along. A catalogue with `catalogue_problems` is refused with the first of them. A fit that ran out of sweeps is
    returned with converged = false. The residual is the length of what is left over that of the counts.
    """
    for found in catalogue_problems(catalogue).orderBy("signature").limit(1).collect():
        raise ValueError(f"signature {found['signature']}: {found['problem']}")
    rows = catalogue.join(F.broadcast(channels(catalogue.sparkSession)), "channel").groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("number", "weight"))).alias("w")).orderBy("signature").limit(MOST_SIGNATURES + 1).collect()
    if not 1 <= len(rows) <= MOST_SIGNATURES:
        raise ValueError(f"a catalogue of 1 to {MOST_SIGNATURES} signatures")
    names, matrix = [r["signature"] for r in rows], np.array([[c["weight"] for c in r["w"]] for r in rows]).T
    wide = spectra.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "n"))), lambda c: c["n"].cast("double")).alias("counts"), F.sum("n").alias("mutations")).where(F.col("mutations") >= least_mutations)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.iloc[at : at + ROWS_AT_ONCE]
                counts = np.array(batch["counts"].tolist(), dtype=float).reshape(len(batch), len(matrix))
                x, made, took, done = nnls(matrix, counts)
                length, own = np.linalg.norm(counts, axis=1), np.linalg.norm(made, axis=1)
                cosine = np.divide((made * counts).sum(axis=1), own * length, out=np.zeros(len(batch)), where=own * length > 0).clip(-1, 1)
                each = lambda v: np.repeat(np.asarray(v), len(names))
                yield pd.DataFrame({"sample_id": each(batch["sample_id"]), "signature": names * len(batch), "exposure": x.ravel(), "mutations": each(batch["mutations"]), "relative_residual": each(np.linalg.norm(counts - made, axis=1) / length), "cosine": each(cosine), "iterations": each(took), "converged": each(done)})

    kind = spectra.schema["sample_id"].dataType.simpleString()
    return wide.select("sample_id", "counts", "mutations").mapInPandas(fit, f"sample_id {kind}, signature string, exposure double, mutations long, relative_residual double, cosine double, iterations long, converged boolean")
