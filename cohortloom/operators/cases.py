"""Case assembly, duplicate withdrawal, poisoning, import reports and the patient-level split.

Findings arrive one a row with their record number. A case stands only if all its rows are valid and agree on its
metadata; samples that two cases claim are withdrawn from both. Every rule keeps its reason as data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.functions.text import bucket_10000, is_id, is_label

ISSUES_SHOWN = 1000
FINDINGS_MOST = 64


def finding_issue() -> Column:
    """First reason to reject a finding row, null if there is none."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.coalesce(
        F.when(blank("case_id"), "missing_case_id"), F.when(~is_id(F.col("case_id")), "invalid_case_id"), F.when(blank("finding_id"), "missing_finding_id"),
        F.when(~is_id(F.col("finding_id")), "invalid_finding_id"), F.when(blank("name"), "missing_name"), F.when(~is_label(F.col("name")), "invalid_name"), F.when(blank("value"), "missing_value"),
    )


def issues(findings: DataFrame) -> DataFrame:
    """(record, case_id, issue) of rows and cases that can't stand, each reason by itself."""
    rows = findings.withColumn("issue", finding_issue())
    row = rows.where("issue is not null").select("record", "case_id", "issue")
    again = F.row_number().over(W.partitionBy("case_id", "finding_id").orderBy("record")) > 1
    twice = rows.where("issue is null").withColumn("again", again).where("again").select("record", "case_id", F.lit("duplicate_finding").alias("issue"))
    per = findings.where(F.col("case_id").isNotNull()).groupBy("case_id").agg(F.count_distinct(F.struct("patient_id", "sample_id")).alias("m"), F.count(F.lit(1)).alias("n"), F.min("record").alias("record"))
    clash = per.where("m > 1").select("record", "case_id", F.lit("conflicting_metadata").alias("issue"))
    many = per.where(F.col("n") > FINDINGS_MOST).select("record", "case_id", F.lit("too_many_findings").alias("issue"))
    return row.unionByName(twice).unionByName(clash).unionByName(many).unionByName(shared_samples(findings).select("record", "case_id", F.lit("shared_sample").alias("issue")))


def shared_samples(findings: DataFrame) -> DataFrame:
    """(record, case_id, sample_id) of all cases that claim a sample of another case."""
    cases = findings.where("sample_id is not null and case_id is not null").groupBy("case_id", "sample_id").agg(F.min("record").alias("record"))
    claimed = cases.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample_id")
    return cases.join(claimed, "sample_id", "left_semi").select("record", "case_id", "sample_id")


def accepted(findings: DataFrame) -> DataFrame:
    """Rows of cases without any issue: one bad row with a readable id withdraws the whole case."""
    bad = issues(findings).where("case_id is not null").select("case_id").distinct()
    return findings.where("case_id is not null").join(bad, "case_id", "left_anti")


def assembled(findings: DataFrame) -> DataFrame:
    """One row a case: its metadata and its findings in order of record (at most 64, so the arrays are small)."""
    entry = F.struct("record", "finding_id", "name", "value")
    return accepted(findings).groupBy("case_id").agg(F.first("patient_id").alias("patient_id"), F.first("sample_id").alias("sample_id"), F.sort_array(F.collect_list(entry)).alias("findings"))


def import_report(findings: DataFrame) -> DataFrame:
    """(measure, key, n): rows, rows and cases by verdict, issues by reason."""
    found = issues(findings)
    one = lambda df, measure, key: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), F.col("key").cast("string").alias("key"), "n")
    bad = found.where("case_id is not null").select("case_id").distinct().withColumn("rejected", F.lit(True))
    cases = findings.where("case_id is not null").select("case_id").distinct().join(bad, "case_id", "left").withColumn("verdict", F.when(F.col("rejected"), "rejected").otherwise("accepted"))
    missing = [one(findings.where(F.col(c).isNull() | (F.trim(c) == "")), "missing", F.lit(c)) for c in ("patient_id", "sample_id", "value")]
    out = one(findings, "rows", F.lit("all")).unionByName(one(cases, "cases", F.col("verdict"))).unionByName(one(found, "issues", F.col("issue")))
    for m in missing:
        out = out.unionByName(m)
    return out


def shown_issues(found: DataFrame) -> DataFrame:
    """The first issues by record; their number is the feature, counts stay complete in the report."""
    return found.orderBy("record", "issue", "case_id").limit(ISSUES_SHOWN)


def several_specimens(cases: DataFrame) -> DataFrame:
    """(patient_id, samples, first_record) of patients with more than one sample."""
    return cases.where("patient_id is not null").groupBy("patient_id").agg(F.count_distinct("sample_id").alias("samples"), F.min("record").alias("first_record")).where("samples > 1")


def first_seen(rows: DataFrame, key: list[str], record: str) -> DataFrame:
    """Adds `again`: whether the key was there in an earlier record. The first record is joined, so hot keys aren't sorted."""
    first = rows.groupBy(*key).agg(F.min(record).alias("__first"))
    return rows.join(first, key).select(rows["*"], (F.col(record) > F.col("__first")).alias("again"))


def split(patients: DataFrame, seed: str = "42", holdout: str | None = None, patient: str = "patient_id", institution: str | None = None) -> DataFrame:
    """Adds partition: 60/20/20 by the hash of seed and patient; patients of the held-out institution go to test whole.

    A row without a patient is unassigned.
    """
    bucket = bucket_10000(F.concat(F.lit(seed), F.lit("\x00"), F.col(patient).cast("string")))
    part = F.when(bucket < 6000, "development").when(bucket < 8000, "calibration").otherwise("test")
    if holdout is not None and institution is not None:
        held = patients.where(F.col(institution) == holdout).select(patient).distinct().withColumn("__held", F.lit(True))
        return patients.join(held, patient, "left").withColumn("partition", F.when(F.col(patient).isNull(), "unassigned").when(F.col("__held"), "test").otherwise(part)).drop("__held")
    return patients.withColumn("partition", F.when(F.col(patient).isNull(), "unassigned").otherwise(part))


def migrated(cases: DataFrame, source_sha256: str) -> DataFrame:
    """Cases of schema 1 as schema 2: each finding gets an observation status and its source record."""
    made = F.transform("findings", lambda f, i: F.struct(f["finding_id"].alias("finding_id"), f["name"].alias("name"), f["value"].alias("value"), F.lit("observed").alias("status"), F.struct(F.lit(source_sha256).alias("sha256"), F.col("record").alias("record"), i.alias("index")).alias("source")))
    return cases.withColumn("findings", made).withColumn("schema_version", F.lit(2))
