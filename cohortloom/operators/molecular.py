"""Feature sets of samples: what may be shown, whether they are ready, and how modalities and derived features join.

A feature set is long: (sample_id, patient_group_id, data_class, id, name, modality, kind, status, group, ...), one row a
feature. Everything is a projection, an aggregation by sample or an equality join on the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import token_estimate
from cohortloom.operators.scoring import STATE_TOKENS, WINDOW_TOKENS

# Columns of a case and fields of a finding that a request may hold; everything else stays behind.
EVIDENCE = ("age_years", "age_lower_bound", "sex_at_birth", "specimen_site")
EVIDENCE_FINDING = ("finding_id", "kind", "name", "value", "status")
CALLS = {-2: "deep loss", -1: "loss", 0: "neutral", 1: "gain", 2: "amplification"}
DERIVED_GROUP = "variants and derived signatures"
COMPARISON_GROUP = "expression comparison"


def gate(run: DataFrame, least_top: float = 0.75, least_margin: float = 0.15, least_support: float = 0.8, most_conflict: float = 0.2) -> DataFrame:
    """Adds `reasons` and `status` (p_top, margin, support, conflict, predicted_kind, source); low and ambiguous scores are one reason."""
    low = (F.col("p_top") < least_top) | (F.col("margin") < least_margin)
    reasons = F.array_compact(F.array(
        F.when(F.col("source") != "live", "not_live"), F.when(F.col("predicted_kind") != "named", "unresolved_class"), F.when(low, "low_or_ambiguous"),
        F.when(F.col("support") < least_support, "insufficient_support"), F.when(F.col("conflict") > most_conflict, "conflicting_evidence"),
    ))
    return run.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "review_required").otherwise("abstained"))


def evidence(cases: DataFrame, case: str = "case_id") -> DataFrame:
    """The case's key and, as `evidence`, what a request may hold of it: an explicit list, so a new column stays out until it is named."""
    have = [F.col(c) for c in EVIDENCE if c in cases.columns]
    names = cases.schema["findings"].dataType.elementType.fieldNames()
    shown = F.transform("findings", lambda f: F.struct(*[f[n].alias(n) for n in EVIDENCE_FINDING if n in names]))
    return cases.select(case, F.struct(*have, shown.alias("findings")).alias("evidence"))


def with_meaning(features: DataFrame) -> DataFrame:
    """Adds `meaning` in words: copy-number calls, exact ages or bounds, somatic status; a feature that isn't observed gets none."""
    call = F.create_map(*[x for k, v in CALLS.items() for x in (F.lit(k), F.lit(v))])
    somatic = F.when(F.col("somatic"), "somatic as annotated").when(~F.col("somatic"), "germline").otherwise("origin not resolved")
    age = F.when(F.coalesce(F.col("is_bound"), F.lit(False)), "older than the stated years").otherwise("completed years")
    meaning = F.when(F.col("kind") == "copy_number", F.try_element_at(call, F.col("number").cast("int"))).when(F.col("kind") == "mutation", somatic).when(F.col("kind") == "age", age)
    return features.withColumn("meaning", F.when(F.col("status") == "observed", meaning))


def context_problem(request: Column, state: Column, longest_question: Column) -> Column:
    """What keeps a request from the scorer's window, null if nothing does; it is refused, never cut."""
    whole = token_estimate(request) > WINDOW_TOKENS
    part = F.ceil((F.octet_length(state) + F.octet_length(longest_question)) / 4) > STATE_TOKENS
    return F.when(whole, "request_exceeds_window").when(part, "state_and_question_exceed_window")


def readiness(features: DataFrame, requests: DataFrame) -> DataFrame:
    """(sample_id, features, observed, unavailable, request_bytes, blockers, ready); requests: (sample_id, request)."""
    counts = features.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(F.col("status").isNull()).alias("bare"), F.bool_and(F.col("data_class") == "synthetic").alias("synthetic"),
    )
    both = counts.join(requests.select("sample_id", "request"), "sample_id", "left")
    blockers = F.array_compact(F.array(
        F.when(F.col("request").isNull(), "no_request"), F.when(token_estimate(F.col("request")) > WINDOW_TOKENS, "request_exceeds_window"), F.when(~F.coalesce("synthetic", F.lit(False)), "not_synthetic"),
        F.when(F.col("bare") > 0, "feature_without_status"), F.when(F.col("observed") == 0, "nothing_observed"),
    ))
    made = both.select("sample_id", "features", "observed", (F.col("features") - F.col("observed")).alias("unavailable"), F.octet_length("request").cast("long").alias("request_bytes"), blockers.alias("blockers"))
    return made.withColumn("ready", F.size("blockers") == 0)


def merged(sets: list[DataFrame]) -> DataFrame:
    """The features of several modalities; a sample that a set lacks, or of another patient group or data class, is an error when read."""
    rows = None
    for k, one in enumerate(sets):
        one = one.withColumn("__set", F.lit(k))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    keys = rows.groupBy("sample_id").agg(F.count_distinct(F.struct("patient_group_id", "data_class")).alias("__keys"), F.count_distinct("__set").alias("__sets"))
    good = F.when((F.col("__keys") == 1) & (F.col("__sets") == len(sets)), True).otherwise(F.raise_error(F.lit("the sets differ in samples, patient groups or data classes")).cast("boolean"))
    return rows.join(keys, "sample_id").where(good).drop("__set", "__keys", "__sets")


def attached_comparison(features: DataFrame, compared: DataFrame, reference_sha256: str) -> DataFrame:
    """Features with one more of each compared sample: its similarities by class as a vector; none compared: the feature is unavailable.

    compared: (sample_id, class_id, r, status) of `expression.compare`.
    """
    entry = F.struct("class_id", "r")
    vector = compared.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("status") == "compared", entry)))).alias("vector"))
    who = features.groupBy("sample_id").agg(F.first("patient_group_id").alias("patient_group_id"), F.first("data_class").alias("data_class"))
    some = F.size("vector") > 0
    new = vector.join(who, "sample_id").select(
        "sample_id", "patient_group_id", "data_class", F.lit("expression-comparison").alias("id"), F.lit("expression comparison").alias("name"), F.lit("expression").alias("modality"), F.lit("vector").alias("kind"),
        F.when(some, "observed").otherwise("not_available").alias("status"), F.lit(COMPARISON_GROUP).alias("group"), F.when(some, F.col("vector")).alias("vector"), F.lit(reference_sha256).alias("reference_sha256"),
    )
    return features.unionByName(new, allowMissingColumns=True)


def attached_signatures(features: DataFrame, exposures: DataFrame) -> DataFrame:
    """Features with the fitted signatures of each sample; whatever shares a group with a variant is one group with them.

    exposures: (sample_id, signature, exposure, converged). A signature hangs on all variants of its sample, so they are
    shown or hidden together; samples without variants or with a fit that didn't converge are an error when read.
    """
    variant = F.col("kind") == "mutation"
    grouped = features.where(variant).select("sample_id", "group", F.lit(True).alias("__with")).distinct()
    joined = features.join(grouped, ["sample_id", "group"], "left")
    regrouped = joined.withColumn("group", F.when(F.col("__with"), F.lit(DERIVED_GROUP)).otherwise(F.col("group"))).select(features.columns)
    sources = features.where(variant).groupBy("sample_id").agg(F.array_sort(F.collect_set("id")).alias("depends"), F.first("patient_group_id").alias("patient_group_id"), F.first("data_class").alias("data_class"))
    good = F.when(F.col("converged") & F.col("depends").isNotNull(), True).otherwise(F.raise_error(F.lit("a fit without variants or convergence")).cast("boolean"))
    new = exposures.join(sources, "sample_id", "left").where(good).select(
        "sample_id", "patient_group_id", "data_class", F.concat(F.lit("derived-"), F.col("signature")).alias("id"), F.col("signature").alias("name"), F.lit("signature").alias("modality"), F.lit("signature").alias("kind"),
        F.lit("observed").alias("status"), F.lit(DERIVED_GROUP).alias("group"), F.col("exposure").cast("double").alias("number"), "depends",
    )
    return regrouped.unionByName(new, allowMissingColumns=True)


def labelled(rows: DataFrame, classes: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Adds the name and the parent of each class; outcomes that aren't classes have none."""
    names = classes.select(F.col("class_id").alias("__id"), F.col("name").alias("class_name"), F.col("parent").alias("class_parent"))
    return rows.join(names, rows[class_id] == names["__id"], "left").drop("__id")


def numeric_view(kind: Column, number: Column, is_bound: Column) -> Column:
    """The number that a value can be compared by, null if it has none: an age that is only a bound is no number."""
    return F.when(kind.isin("number", "signature", "copy_number"), number).when((kind == "age") & ~F.coalesce(is_bound, F.lit(False)), number)


def displayed(kind: Column, number: Column, units: Column, label: Column, is_bound: Column) -> Column:
    """A value for readers: four digits and units, signed calls with their gene (`label`), ages with their bound, else the label."""
    out = F.when(kind.isin("number", "signature"), F.format_string("%.4f %s", number, F.coalesce(units, F.lit(""))))
    out = out.when(kind == "copy_number", F.format_string("%s CNA %+d", label, number.cast("int")))
    return out.when(kind == "age", F.format_string("%s%d years", F.when(is_bound, ">").otherwise(""), number.cast("int"))).otherwise(label)


def encoding(kind: Column, units: Column, label: Column) -> Column:
    """What two values must share to stand in for one another: kind and units, or kind and what they are about."""
    return F.to_json(F.array_compact(F.array(kind, F.when(kind.isin("number", "signature"), F.coalesce(units, F.lit(""))).when(kind.isin("mutation", "copy_number"), label))))


def background_problems(query: DataFrame, background: DataFrame, partition: str, release_id: str, most: int = 64) -> DataFrame:
    """(sample_id, problem) of background samples that can't stand in for a query; empty if all can.

    Both have one row a feature: sample_id, patient_group_id, data_class, id and what must be the same for each id. A
    background is a named release of the development partition with 1 to 64 samples, each of another patient.
    """
    spark = query.sparkSession
    samples = background.groupBy("sample_id").agg(F.first("patient_group_id").alias("patient_group_id"), F.first("data_class").alias("data_class"), F.count(F.lit(1)).alias("n"))
    whole = []
    if partition != "development" or not release_id.strip() or len(release_id.encode()) > 128:
        whole.append("not a named release of the development partition")
    if not 1 <= samples.limit(most + 1).count() <= most:
        whole.append(f"not 1 to {most} samples")
    out = spark.createDataFrame([(None, w) for w in whole], "sample_id string, problem string")
    asked = query.groupBy("sample_id").agg(F.first("patient_group_id").alias("qp"), F.first("data_class").alias("qd"), F.count(F.lit(1)).alias("qn")).withColumnRenamed("sample_id", "qs")
    # One query and at most 64 samples.
    both = samples.crossJoin(asked)
    known = F.array_compact(F.array(
        F.when(F.col("sample_id") == F.col("qs"), "sample of the query"), F.when(F.col("patient_group_id") == F.col("qp"), "patient of the query"), F.when(F.col("data_class") != F.col("qd"), "another data class"), F.when(F.col("n") != F.col("qn"), "another number of features"),
    ))
    out = out.unionByName(both.select("sample_id", F.explode(known).alias("problem")))
    twice = samples.groupBy("patient_group_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out = out.unionByName(samples.join(twice, "patient_group_id", "left_semi").select("sample_id", F.lit("patient listed twice").alias("problem")))
    held = [c for c in query.columns if c not in ("sample_id", "patient_group_id", "data_class", "id", "value", "number")]
    have = query.select("id", F.struct(*held).alias("__q"))
    met = background.join(have, "id", "left")
    differ = F.when(F.col("__q").isNull(), "feature ids differ").when(~F.struct(*held).eqNullSafe(F.col("__q")), "features differ in what must be the same")
    return out.unionByName(met.select("sample_id", differ.alias("problem")).where("problem is not null").distinct())
