"""Runs on disk: files that are written once or replaced whole, a lock, resume rules, and loaders by kind.

Paths are of any file system that Spark reads; small documents go through Hadoop's file system, tables through bundles.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.operators.attribution import MOST_EXACT, exact
from cohortloom.functions.text import fingerprint
from cohortloom.sources import bundles
from cohortloom.sources.bundles import BundleError

DOCUMENT_BYTES = 16 << 20
# Fields of a run's configuration that a resumed run may change.
BUDGETS = ("attempts", "tokens", "seconds")


class RunError(ValueError):
    pass


def read_json(spark: SparkSession, path: str, most: int = DOCUMENT_BYTES) -> object:
    """One JSON document of at most `most` bytes; errors name the path and never the content."""
    fs, where = bundles._fs(spark, path)
    if not fs.exists(where):
        raise RunError(f"{path}: no such document")
    if fs.getFileStatus(where).getLen() > most:
        raise RunError(f"{path}: more than {most} bytes")
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (ValueError, TypeError):
        raise RunError(f"{path}: not a JSON document") from None


def _put(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    fs, where = bundles._fs(spark, path)
    out = fs.create(where, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def save_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a document that must not be there yet."""
    try:
        _put(spark, path, text, False)
    except Exception as e:
        raise RunError(f"{path}: exists or can't be written") from e


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Replace a document whole: a reader sees the old one or the new one, never part of one."""
    fs, where = bundles._fs(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}"
    _put(spark, beside, text, False)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(beside), where, options)


@contextmanager
def locked(spark: SparkSession, path: str, owner: str) -> Iterator[None]:
    """Hold a run's lock: a second run of the same folder is refused; the lock goes when the run ends, also by an error."""
    fs, where = bundles._fs(spark, f"{path}/_lock")
    try:
        _put(spark, f"{path}/_lock", owner, False)
    except Exception as e:
        raise RunError(f"{path}: another run holds the lock") from e
    try:
        yield
    finally:
        fs.delete(where, False)


def resumable(before: dict, now: dict) -> None:
    """A resumed run has the configuration of the one that was cut off; only its budgets may differ, and may not shrink."""
    changed = sorted(k for k in before.keys() | now.keys() if k not in BUDGETS and before.get(k) != now.get(k))
    if changed:
        raise RunError(f"a resumed run can't change {', '.join(changed)}")
    less = [k for k in BUDGETS if k in before and (now.get(k) is None or now[k] < before[k])]
    if less:
        raise RunError(f"a resumed run can't lower {', '.join(less)}")


def configured(spark: SparkSession, path: str, config: dict) -> dict:
    """The configuration of a run's folder: written by its first run, held against the given one by the next."""
    fs, where = bundles._fs(spark, f"{path}/config.json")
    if fs.exists(where):
        resumable(read_json(spark, f"{path}/config.json"), config)
        replace(spark, f"{path}/config.json", json.dumps(config, sort_keys=True))
    else:
        save_new(spark, f"{path}/config.json", json.dumps(config, sort_keys=True))
    return config


def export_run(features: DataFrame, inference: DataFrame, path: str) -> dict:
    """An inference that can be opened again: features and run, each run row with the fingerprint of the features it is of."""
    by = features.groupBy("sample_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(fingerprint(*sorted(features.columns)))), ""), 256).alias("feature_sha256"))
    return bundles.write({"features": features, "inference": inference.join(by, "sample_id")}, path, "inference")


def open_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Features and run of `export_run`; refused unless every run row is of the features that are there."""
    found = bundles.read(spark, path, "inference")
    features, run = found["features"], found["inference"]
    by = features.groupBy("sample_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(fingerprint(*sorted(features.columns)))), ""), 256).alias("feature_sha256"))
    if run.join(by, ["sample_id", "feature_sha256"], "left_anti").limit(1).count():
        raise BundleError("a run is of other features")
    return found


def write_cases(cases: DataFrame, labels: DataFrame, splits: DataFrame, path: str) -> dict:
    """An import bundle: cases as JSON lines and as tables, labels and splits, the manifest last."""
    cases.select(F.to_json(F.struct(*cases.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(f"{path}/cases.jsonl")
    return bundles.write({"cases": cases, "labels": labels, "splits": splits}, path, "cases")


def write_dataset(records: DataFrame, gene_map: DataFrame, samples: DataFrame, path: str) -> dict:
    """A dataset bundle: records by sample, the gene map as TSV too, one row a sample, the manifest last."""
    bundles.export(gene_map, f"{path}/gene-map.tsv", "\t")
    return bundles.write({"records": records, "gene_map": gene_map, "samples": samples}, path, "dataset", {"records": ["sample_id"]})


def adopt(spark: SparkSession, source: str, path: str) -> dict:
    """A document of an older layout, kept byte for byte, with its digest; the copy is checked against it."""
    (row,) = spark.read.format("binaryFile").load(source).select("length", F.sha2("content", 256).alias("sha256")).collect()
    fs, where = bundles._fs(spark, source)
    to, target = bundles._fs(spark, f"{path}/source")
    if to.exists(target):
        raise BundleError("the bundle is there already")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, to, target, False, spark._jsc.hadoopConfiguration())
    again = spark.read.format("binaryFile").load(f"{path}/source").select(F.sha2("content", 256).alias("sha256")).first()["sha256"]
    if again != row["sha256"]:
        raise BundleError("the copy differs from the source")
    manifest = {"kind": "adopted", "length": row["length"], "sha256": row["sha256"], "tables": {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/_manifest")
    return manifest


def kind_of(spark: SparkSession, path: str) -> str:
    fs, where = bundles._fs(spark, f"{path}/_manifest")
    if not fs.exists(where):
        raise BundleError("no manifest: the bundle was not finished")
    return json.loads(spark.read.text(f"{path}/_manifest").first()[0])["kind"]


TOLERANCE = 1e-9


def export_attribution(values: DataFrame, contributions: DataFrame, names: list[str], path: str) -> dict:
    """An exact attribution that can be opened again: scored coalitions (mask, value), contributions (feature, contribution) and the groups by bit."""
    spark = values.sparkSession
    groups = spark.createDataFrame(list(enumerate(names)), "bit int, feature string")
    return bundles.write({"values": values.select("mask", "value"), "contributions": contributions.select("feature", "contribution"), "groups": groups}, path, "attribution", keys={"values": ["mask"], "contributions": ["feature"]})


def open_attribution(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of `export_attribution`; refused where a part differs from the manifest, coalitions are missing, or the contributions don't follow from the values."""
    found = bundles.read(spark, path, "attribution")
    names = [r["feature"] for r in found["groups"].orderBy("bit").limit(MOST_EXACT + 1).collect()]
    have = found["values"].agg(F.count_distinct("mask").alias("n"), F.count(F.lit(1)).alias("all"), F.min("mask").alias("low"), F.max("mask").alias("high")).first()
    if not 1 <= len(names) <= MOST_EXACT or (have["n"], have["all"], have["low"], have["high"]) != (1 << len(names), 1 << len(names), 0, (1 << len(names)) - 1):
        raise BundleError("the coalitions are not complete")
    again = exact(found["values"], names).withColumnRenamed("contribution", "__again")
    both = found["contributions"].join(again, "feature", "full_outer")
    odd = both.where(~F.coalesce(F.abs(F.col("contribution") - F.col("__again")) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs("__again")), F.lit(False)))
    for row in odd.orderBy("feature").limit(1).collect():
        raise BundleError(f"the contribution of {row['feature']} does not follow from the scored coalitions")
    return found


_OPEN: dict[str, Callable[[SparkSession, str], dict]] = {"inference": open_run, "attribution": open_attribution}


def open_any(spark: SparkSession, path: str) -> tuple[str, dict[str, DataFrame]]:
    """The kind of a bundle and its tables, by the loader of that kind; other kinds are verified against their manifest."""
    kind = kind_of(spark, path)
    return kind, _OPEN.get(kind, bundles.read)(spark, path)


def synthetic_study(spark: SparkSession, seed: int = 42, predictions: int = 528, classes: int = 22, outcomes: int = 180) -> dict[str, DataFrame]:
    """A made-up study that follows from a seed and the rows' numbers alone: records, probabilities and survival outcomes."""
    draw = lambda k, n, mod: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), n), F.lit(mod))
    share = lambda k, n: draw(k, n, 1_000_000) / F.lit(1_000_000.0)
    name = lambda c: F.concat(F.lit("class-"), F.lpad(c.cast("string"), 2, "0"))
    one = spark.range(predictions).select(F.col("id").alias("n"), F.concat(F.lit("s-"), F.col("id")).alias("sample_id"), F.concat(F.lit("p-"), F.floor(F.col("id") / 2)).alias("patient_group_id"), F.pmod("id", F.lit(classes)).alias("k"))
    part = F.when(draw(1, F.col("patient_group_id"), 10) < 6, "development").when(draw(1, F.col("patient_group_id"), 10) < 8, "calibration").otherwise("test")
    failed = draw(2, F.col("n"), 25) == 0
    records = one.select("sample_id", "patient_group_id", part.alias("partition"), name(F.col("k")).alias("truth"), F.when(failed, "budget_not_run").alias("failure"), (~failed & (draw(3, F.col("n"), 3) > 0)).alias("accepted"))
    each = one.where(~failed).select("sample_id", "n", "k", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("c"))
    raw = each.withColumn("w", 0.01 + share(4, F.concat_ws("-", "n", "c")) + F.when((F.col("c") == F.col("k")) & (draw(5, F.col("n"), 4) > 0), float(classes)).otherwise(0.0))
    total = raw.groupBy("sample_id").agg(F.sum("w").alias("t"))
    probabilities = raw.join(total, "sample_id").select("sample_id", name(F.col("c")).alias("class_id"), (F.col("w") / F.col("t")).alias("p"))
    n = F.col("id")
    entry = F.floor(share(6, n) * 6).cast("double")
    survival = spark.range(outcomes).select(
        F.concat(F.lit("p-"), n).alias("patient_id"), name(F.pmod(n, F.lit(4))).alias("grp"), entry.alias("entry"), (entry + 1 + F.floor(share(7, n) * 60)).cast("double").alias("time"), (draw(8, n, 10) < 7).alias("event"),
        F.when(draw(9, n, 2) == 0, "concordant").otherwise("discordant").alias("concordance"), (0.2 + 0.6 * share(10, n)).alias("propensity"),
    )
    return {"records": records, "probabilities": probabilities, "outcomes": survival}


def run_markdown(run: DataFrame, features: DataFrame, contributions: DataFrame | None = None, title: str = "Molecular run") -> str:
    """A run for readers: what was asked, what came back, why it may have been held, and what moved it."""
    from cohortloom.sources.exports import escaped, markdown_table

    counts = features.groupBy("modality", "status").agg(F.count(F.lit(1)).alias("features")).orderBy("modality", "status")
    shown = run.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in run.dtypes])
    out = [f"# {escaped(title)}", "\n## Outcome\n", markdown_table(shown), "\n## Features\n", markdown_table(counts)]
    if contributions is not None:
        out += ["\n## Contributions\n", markdown_table(contributions.orderBy(F.desc(F.abs("contribution")), "feature"))]
    return "\n".join([*out, "\nScores are not validated; thresholds are engineering defaults."])
