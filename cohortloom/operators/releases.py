"""Reference releases: samples, labels and measured values put together into classes and their centroids, behind gates.

samples: (sample_id, patient_group_id, data_class, qc, measurement_sha256); labels: (sample_id, patient_group_id, class_id,
cancer_type); records: (sample_id, gene, value), gene and value null where a record has none. Gates are data: (subject,
problem) rows, none if the release may be made. Samples are never dropped to make one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import finite
from cohortloom.operators.expression import centroids, common_genes, label_problems
from cohortloom.operators.tables import written

MOST_CENTROID_VALUES = 1_000_000


class ReleaseError(ValueError):
    """A release that may not be made; the text is its first problem."""


def measured_problems(records: DataFrame) -> DataFrame:
    """(sample_id, gene, problem): a canonical gene measured twice in a sample, or a value that is not finite."""
    mapped = records.where("gene is not null and value is not null")
    each = mapped.groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("n"), F.bool_and(finite(F.col("value"))).alias("ok"))
    problem = F.when(F.col("n") > 1, "duplicate canonical gene").when(~F.col("ok"), "value is not finite")
    return each.select("sample_id", "gene", problem.alias("problem")).where("problem is not null")


def measured_view(records: DataFrame) -> DataFrame:
    """(sample_id, gene, value) of the records that have both; refused, when it is read, where `measured_problems` finds one."""
    mapped = records.where("gene is not null and value is not null")
    each = mapped.groupBy("sample_id", "gene").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    good = (F.col("n") == 1) & finite(F.col("v"))
    return each.select("sample_id", "gene", F.when(good, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("duplicate canonical gene or value that is not finite: "), "gene")).cast("double")).alias("value"))


def problems(samples: DataFrame, labels: DataFrame, records: DataFrame, most: int = MOST_CENTROID_VALUES) -> DataFrame:
    """(subject, problem) of all that keeps a release from being made; subjects are samples, classes or `release`."""
    whole = F.lit("release").alias("subject")
    text = lambda c: F.col(c).cast("string").alias("subject")
    found = label_problems(labels, samples).select(text("sample_id"), "problem")
    found = found.unionByName(samples.groupBy("sample_id").count().where("count > 1").select(text("sample_id"), F.lit("duplicate sample").alias("problem")))
    blocked = F.coalesce("qc", F.lit("blocked")) == "blocked"
    found = found.unionByName(samples.where(blocked).select(text("sample_id"), F.lit("blocked or absent quality control").alias("problem")))
    both = samples.select("sample_id", F.col("patient_group_id").alias("__group")).join(labels, "sample_id").where(F.col("__group") != F.col("patient_group_id"))
    found = found.unionByName(both.select(text("sample_id"), F.lit("patient group conflicts with the sample").alias("problem")).distinct())
    names = labels.groupBy("class_id").agg(F.count_distinct("cancer_type").alias("n")).where("n > 1")
    found = found.unionByName(names.select(text("class_id"), F.lit("class has conflicting names").alias("problem")))
    kinds = samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("data_class") == "synthetic").alias("s"))
    found = found.unionByName(kinds.where("n = 0").select(whole, F.lit("no samples").alias("problem")))
    found = found.unionByName(kinds.where("s > 0 and s < n").select(whole, F.lit("synthetic and research samples together").alias("problem")))
    found = found.unionByName(measured_problems(records).select(text("sample_id"), "problem").distinct())
    size = common_genes(records.where("gene is not null and value is not null")).agg(F.count(F.lit(1)).alias("g")).crossJoin(labels.agg(F.count_distinct("class_id").alias("c")))  # one row each
    found = found.unionByName(size.where(F.col("g") * F.col("c") > most).select(whole, F.lit("too many centroid values").alias("problem")))
    return found.unionByName(size.where("g = 0").select(whole, F.lit("no gene is measured in every sample").alias("problem")))


def release(samples: DataFrame, labels: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """members, classes, genes and centroids of a release; refused with the first of its problems."""
    for found in problems(samples, labels, records).orderBy("subject", "problem").limit(1).collect():
        raise ReleaseError(f"{found['subject']}: {found['problem']}")
    values = written(measured_view(records), "measured")
    members = samples.select("sample_id", "measurement_sha256").join(labels.select("sample_id", "patient_group_id", "class_id"), "sample_id")
    classes = labels.groupBy("class_id").agg(F.min("cancer_type").alias("cancer_type"), F.count(F.lit(1)).alias("samples"))
    made = centroids(values, labels)
    return {"members": members, "classes": classes, "genes": made.select("gene").distinct(), "centroids": made}
