"""Checks of cases, clinical context, reference releases and studies: each gives (subject, problem) rows, none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import category, finite, is_id, is_label, is_sha256, strict_date

FINDINGS_MOST = 64
CASE_BYTES = 16 << 10
ENTRIES_MOST, DAYS_MOST = 32, 36_500
# Names that a broad group may not have.
RESERVED = ("__failed__", "unknown", "other")


def case_problems(cases: DataFrame) -> DataFrame:
    """Cases (case_id, schema_version, age_years, age_lower_bound, findings): identifiers, schema coupling, sizes, values against status."""
    f = F.col("findings")
    observed = F.exists(f, lambda x: (x["status"] == "observed") != x["value"].isNotNull())
    sourced = F.exists(f, lambda x: x["status"].isNull())
    checks = F.array_compact(F.array(
        F.when(~F.coalesce(is_id(F.col("case_id")), F.lit(False)), "invalid case id"), F.when(~F.col("schema_version").between(1, 3), "unknown schema"),
        F.when(F.size(f) == 0, "no findings"), F.when(F.size(f) > FINDINGS_MOST, "too many findings"), F.when(F.octet_length(F.to_json(f)) > CASE_BYTES, "case too large"),
        F.when((F.col("schema_version") >= 2) & sourced, "finding without status"), F.when((F.col("schema_version") >= 2) & observed, "value against status"),
        F.when(F.size(F.array_distinct(F.transform(f, lambda x: x["finding_id"]))) < F.size(f), "finding id used twice"),
        F.when(F.exists(f, lambda x: ~F.coalesce(is_label(x["name"]), F.lit(False))), "invalid finding name"),
        F.when(F.col("age_years").isNotNull() & F.col("age_lower_bound").isNotNull(), "age and bound together"), F.when(~F.col("age_years").between(0, 130), "age out of range"),
    ))
    return cases.select(F.col("case_id").alias("subject"), F.explode(checks).alias("problem"))


def context_problems(cases: DataFrame) -> DataFrame:
    """Clinical context (flags map, investigations, reviews): one investigation of a kind, dates that exist, reasons on reviews."""
    kinds = F.transform("investigations", lambda i: i["kind"])
    checks = F.array_compact(F.array(
        F.when(F.size(F.array_distinct(kinds)) < F.size(kinds), "investigation recorded twice"),
        F.when(F.exists("investigations", lambda i: i["date"].isNotNull() & strict_date(i["date"]).isNull()), "invalid date"),
        F.when(F.exists("reviews", lambda r: F.coalesce(F.trim(r["reason"]), F.lit("")) == ""), "review without a reason"), F.when(~F.col("ecog").between(0, 4), "performance status out of range"),
    ))
    return cases.select(F.col("case_id").alias("subject"), F.explode(checks).alias("problem"))


def _said(c: Column, most: int) -> Column:
    """A text that says something: not blank, short enough, no control characters. Null says nothing."""
    return F.coalesce((F.trim(c) != "") & (F.octet_length(c) <= most) & ~F.rlike(c, F.lit(r"[\x00-\x1F\x7F-\x9F]")), F.lit(False))


def _unless_absent(c: Column, ok: Column) -> Column:
    return c.isNull() | F.coalesce(ok, F.lit(False))


def _assessed(a: Column) -> Column:
    return F.coalesce(is_id(a["reviewer_id"]) & strict_date(a["recorded_on"]).isNotNull(), F.lit(False)) & _said(a["source"], 256)


def _day(c: Column) -> Column:
    return _unless_absent(c, c.between(-DAYS_MOST, DAYS_MOST))


def clinical_problems(cases: DataFrame) -> DataFrame:
    """(subject, problem) of clinical contexts (case_id, assessment, stage, lineage, features, investigations, ecog, ldh, albumin, reviews).

    What is asserted needs an assessment; one investigation of a kind, with a result if completed and a reason if not done;
    measurements and reviews are whole. Absent lists are empty ones.
    """
    rows = lambda c: F.coalesce(F.col(c), F.filter(F.col(c), lambda x: F.lit(False)), F.array().cast(cases.schema[c].dataType))
    investigations, reviews = rows("investigations"), rows("reviews")
    populated = (
        (F.coalesce("stage", F.lit("unassessed")) != "unassessed") | (F.coalesce("lineage", F.lit("unknown")) != "unknown") | (F.coalesce(F.size("features"), F.lit(0)) > 0) | (F.size(investigations) > 0)
        | F.col("ecog").isNotNull() | F.col("ldh").isNotNull() | F.col("albumin").isNotNull()
    )
    kinds = F.transform(investigations, lambda i: i["kind"])

    def done(i: Column) -> Column:
        optional = lambda c: _unless_absent(c, _said(c, 512))
        settled = ~((i["status"] == "completed") & i["result"].isNull()) & ~(i["status"].isin("not_indicated", "contraindicated", "declined") & i["reason"].isNull())
        return _said(i["source"], 256) & _day(i["day"]) & optional(i["result"]) & optional(i["reason"]) & F.coalesce(settled, F.lit(False))

    measured = lambda m: F.coalesce(finite(m["value"]) & (m["value"] >= 0), F.lit(False)) & _said(m["units"], 32) & _said(m["source"], 256) & _day(m["day"])
    review = lambda r: F.coalesce(is_id(r["rule_id"]) & is_sha256(r["basis_sha256"]), F.lit(False)) & _said(r["ruleset_version"], 64) & _said(r["reason"], 512) & _assessed(r["assessment"])
    checks = F.array_compact(F.array(
        F.when(F.col("assessment").isNull() & populated, "assertions without an assessment"), F.when(F.col("assessment").isNotNull() & ~_assessed(F.col("assessment")), "invalid assessment"),
        F.when(~F.col("ecog").between(0, 4), "performance status out of range"), F.when((F.size(investigations) > ENTRIES_MOST) | (F.size(reviews) > ENTRIES_MOST), "too many entries"),
        F.when(F.size(F.array_distinct(kinds)) < F.size(kinds), "investigation recorded twice"), F.when(F.exists(investigations, lambda i: ~done(i)), "invalid investigation"),
        *[F.when(F.col(c).isNotNull() & ~measured(F.col(c)), f"invalid {c}") for c in ("ldh", "albumin")], F.when(F.exists(reviews, lambda r: ~review(r)), "invalid review"),
    ))
    return cases.select(F.col("case_id").cast("string").alias("subject"), F.explode(checks).alias("problem"))


def evidence_problems(cases: DataFrame) -> DataFrame:
    """(subject, problem) of what a case's schema asks of its evidence.

    cases: (case_id, schema_version, age_lower_bound, specimen_site, metadata, clinical, findings), metadata a struct of ids and
    evidence_cutoff, clinical of any type, findings an array of (finding_id, value, source (source_id, source_sha256, record,
    field), observation (status, units, assay, timepoint, reference_build)).
    """
    f, version = F.col("findings"), F.col("schema_version")
    ids = F.array(*[F.col(f"metadata.{c}") for c in ("patient_id", "sample_id", "institution_id")])
    short = lambda c: _unless_absent(c, _said(c, 128))
    sourced = lambda x: _unless_absent(x["source"], F.coalesce(is_id(x["source"]["source_id"]) & is_sha256(x["source"]["source_sha256"]) & (x["source"]["record"] > 0), F.lit(False)) & (F.trim(x["source"]["field"]) != "") & (F.octet_length(x["source"]["field"]) <= 128))
    seen = lambda x: F.forall(F.array(*[x["observation"][c] for c in ("units", "assay", "timepoint", "reference_build")]), short)
    recorded = lambda x: category(x["value"])
    against = lambda x: F.coalesce(recorded(x) != x["observation"]["status"], F.lit(False)) | F.coalesce((x["observation"]["status"] == "not_tested") & (F.coalesce(recorded(x), F.lit("")) != "not_tested"), F.lit(False))
    checks = F.array_compact(F.array(
        F.when((version == 1) & (F.col("metadata").isNotNull() | F.col("age_lower_bound").isNotNull() | F.exists(f, lambda x: x["source"].isNotNull() | x["observation"].isNotNull())), "evidence metadata in schema 1"),
        F.when((version >= 2) & (F.col("metadata").isNull() | F.exists(f, lambda x: x["source"].isNull() | x["observation"].isNull())), "schema without evidence metadata"),
        F.when((version == 3) != F.col("clinical").isNotNull(), "clinical context and schema disagree"), F.when(F.col("age_lower_bound") >= 120, "age bound out of range"),
        F.when(F.exists(ids, lambda i: i.isNotNull() & ~F.coalesce(is_id(i), F.lit(False))), "invalid metadata id"), F.when(~short(F.col("metadata.evidence_cutoff")), "invalid evidence cutoff"),
        F.when(F.col("specimen_site").isNotNull() & ((F.trim("specimen_site") == "") | (F.octet_length("specimen_site") > 128)), "invalid specimen site"),
        F.when(F.exists(f, lambda x: ~sourced(x)), "invalid source"), F.when(F.exists(f, lambda x: ~seen(x)), "invalid observation"), F.when(F.exists(f, against), "status against the recorded value"),
        F.when(F.exists(f, lambda x: F.coalesce(F.trim(x["value"]) == "", F.lit(True)) | (F.octet_length(x["value"]) > 1024)), "finding value empty or too long"),
    ))
    return cases.select(F.col("case_id").alias("subject"), F.explode(checks).alias("problem"))


def reference_problems(members: DataFrame, centroids: DataFrame, least_genes: int = 3) -> DataFrame:
    """A release of members (sample_id, patient_group_id, class_id) and centroids (class_id, gene, mean, members)."""
    crossing = members.groupBy("patient_group_id").agg(F.count_distinct("class_id").alias("n")).where("n > 1").select(F.col("patient_group_id").cast("string").alias("subject"), F.lit("patient group in several classes").alias("problem"))
    twice = members.groupBy("sample_id").count().where("count > 1").select(F.col("sample_id").cast("string").alias("subject"), F.lit("sample listed twice").alias("problem"))
    counts = members.groupBy("class_id").agg(F.count_distinct("sample_id").alias("m"))
    sizes = centroids.groupBy("class_id").agg(F.count(F.lit(1)).alias("genes"), F.min("members").alias("least"), F.max("members").alias("most"), F.bool_and(finite(F.col("mean"))).alias("finite"))
    both = sizes.join(counts, "class_id", "full_outer")
    problem = F.when(F.col("m").isNull() | F.col("genes").isNull(), "class without members or centroid").when((F.col("least") != F.col("m")) | (F.col("most") != F.col("m")), "members don't match samples").when(F.col("genes") < least_genes, "too few genes").when(~F.col("finite"), "mean is not finite")
    return both.select(F.col("class_id").cast("string").alias("subject"), problem.alias("problem")).where("problem is not null").unionByName(crossing).unionByName(twice)


def study_problems(classes: DataFrame, outcomes: DataFrame, broad: DataFrame) -> DataFrame:
    """Classes are outcomes, every class has a broad group, there are two groups at least, and none has a reserved name."""
    lost = classes.join(outcomes, "class_id", "left_anti").select(F.col("class_id").alias("subject"), F.lit("class is not an outcome").alias("problem"))
    bare = classes.join(broad, "class_id", "left_anti").select(F.col("class_id").alias("subject"), F.lit("class without a broad group").alias("problem"))
    odd = broad.join(classes, "class_id", "left_anti").select(F.col("class_id").alias("subject"), F.lit("broad group of an unknown class").alias("problem"))
    taken = broad.where(F.lower("broad").isin(*RESERVED)).select(F.col("broad").alias("subject"), F.lit("reserved name").alias("problem"))
    few = broad.agg(F.count_distinct("broad").alias("n")).where("n < 2").select(F.lit("study").alias("subject"), F.lit("fewer than two broad groups").alias("problem"))
    return lost.unionByName(bare).unionByName(odd).unionByName(taken).unionByName(few)
