"""Evaluation of classifications: ranking, confusion, calibration, selective accuracy and their strata.

Input is two tables. `records`: sample_id, patient_group_id, partition, truth, accepted, failure. `probabilities`:
sample_id, class_id, p. Failures stay in the denominators of accuracy and coverage; Brier score, log loss and
calibration are over returned predictions. Ties of probability go to the smallest class id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.functions.stats import ratio
from cohortloom.operators.tables import small, written

PARTITIONS = ("development", "calibration", "test")
FAILED = "__failed__"
THRESHOLDS = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95)
FLOOR = 1e-15
TOLERANCE = 1e-6


def ranking(probabilities: DataFrame) -> DataFrame:
    """Adds rank by probability, ties by class id, and the lead over the next class."""
    order = W.partitionBy("sample_id").orderBy(F.desc("p"), F.asc("class_id"))
    return probabilities.select("*", F.row_number().over(order).alias("rank"), (F.col("p") - F.lead("p").over(order)).alias("margin"))


def winners(probabilities: DataFrame) -> DataFrame:
    """(sample_id, predicted, p_top, margin, top3): the first class, its lead and the first three, without a window.

    One aggregation: the classes of a sample are sorted inside its own small array.
    """
    key = F.struct((-F.col("p")).alias("q"), F.col("class_id").alias("c"))
    ranked = probabilities.groupBy("sample_id").agg(F.array_sort(F.collect_list(key)).alias("r"))
    r = F.col("r")
    second = F.get(r, F.lit(1))["q"]
    return ranked.select("sample_id", r[0]["c"].alias("predicted"), (-r[0]["q"]).alias("p_top"), (-r[0]["q"] + second).alias("margin"), F.transform(F.slice(r, 1, 3), lambda x: x["c"]).alias("top3"))


def problems(records: DataFrame, probabilities: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(subject, problem) of everything that makes an evaluation invalid; empty if it may go on."""
    twice = records.groupBy("sample_id").count().where("count > 1").select(F.col("sample_id").alias("subject"), F.lit("duplicate sample").alias("problem"))
    crossing = records.groupBy("patient_group_id").agg(F.count_distinct("partition").alias("n")).where("n > 1").select(F.col("patient_group_id").alias("subject"), F.lit("patient group crosses partitions").alias("problem"))
    unknown = records.join(outcomes, records["truth"] == outcomes["class_id"], "left_anti").select(F.col("sample_id").alias("subject"), F.lit("truth is not an outcome").alias("problem"))
    part = records.where(~F.col("partition").isin(*PARTITIONS)).select(F.col("sample_id").alias("subject"), F.lit("unknown partition").alias("problem"))
    n = outcomes.count()
    vectors = probabilities.join(outcomes.withColumn("__known", F.lit(1)), "class_id", "left").groupBy("sample_id").agg(
        F.sum("p").alias("total"), F.count(F.lit(1)).alias("n"), F.count("__known").alias("known"),
        F.bool_and(F.col("p").between(0.0, 1.0) & ~F.isnan("p")).alias("ranged"),
    )
    bad = vectors.where(~(F.coalesce("ranged", F.lit(False)) & (F.col("n") == n) & (F.col("known") == n) & (F.abs(F.col("total") - 1) <= TOLERANCE)))
    bad = bad.select(F.col("sample_id").alias("subject"), F.lit("invalid probability vector").alias("problem"))
    have = vectors.select("sample_id", F.lit(True).alias("returned"))
    status = records.join(have, "sample_id", "left").where((F.coalesce("returned", F.lit(False)) == F.col("failure").isNotNull()) | (F.col("returned").isNull() & F.col("accepted")))
    status = status.select(F.col("sample_id").alias("subject"), F.lit("success and failure are not explicit").alias("problem"))
    return twice.unionByName(crossing).unionByName(unknown).unionByName(part).unionByName(bad).unionByName(status)


def scored(records: DataFrame, probabilities: DataFrame) -> DataFrame:
    """One row a record: predicted, p_top, correct, in_top3, brier, log_loss; nulls for failures.

    The classes of a sample meet once, in its own small array, and everything is measured there against the record's truth.
    """
    key = F.struct((-F.col("p")).alias("q"), F.col("class_id").alias("c"))
    ranked = probabilities.groupBy("sample_id").agg(F.array_sort(F.collect_list(key)).alias("__r"))
    out = records.join(ranked, "sample_id", "left")
    r, truth = F.col("__r"), F.col("truth")
    top3 = F.transform(F.slice(r, 1, 3), lambda x: x["c"])
    brier = F.aggregate(r, F.lit(0.0), lambda a, x: a + F.pow(-x["q"] - (x["c"] == truth).cast("double"), F.lit(2.0)))
    of_truth = F.array_max(F.transform(F.filter(r, lambda x: x["c"] == truth), lambda x: -x["q"]))
    made = {
        "predicted": r[0]["c"], "p_top": -r[0]["q"], "margin": -r[0]["q"] + F.get(r, F.lit(1))["q"], "top3": top3, "brier": brier, "log_loss": F.when(r.isNotNull(), -F.ln(F.greatest(of_truth, F.lit(FLOOR)))),
        "correct": r[0]["c"] == truth, "in_top3": F.array_contains(top3, truth),
    }
    return out.select(*records.columns, *[c.alias(k) for k, c in made.items()])


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, coverage, top-1 and top-3 over all eligible, accepted accuracy, Brier score and log loss."""
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n, correct = F.count(F.lit(1)), F.col("correct")
    returned = F.col("predicted").isNotNull()
    return rows.groupBy(*(by or [])).agg(
        n.alias("eligible"), yes(returned).alias("predicted"), yes(~returned).alias("failed"), yes(F.col("accepted") & returned).alias("accepted"),
        ratio(yes(F.col("accepted") & returned), n).alias("coverage"), ratio(yes(correct), n).alias("top1"), ratio(yes(F.col("in_top3")), n).alias("top3"),
        ratio(yes(correct & F.col("accepted")), yes(F.col("accepted") & returned)).alias("accepted_accuracy"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"),
    )


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), "truth", F.coalesce("predicted", F.lit(FAILED)).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def normalised_confusion(counts: DataFrame) -> DataFrame:
    """Adds the share of the row (recall) and of the column (precision)."""
    share = lambda c: ratio(F.col("n"), F.sum("n").over(W.partitionBy(c)))
    return counts.select("*", share("truth").alias("of_truth"), share("predicted").alias("of_predicted"))


def per_class(rows: DataFrame, classes: DataFrame, outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(class_id, support, precision, recall, f1) of the declared classes and of unresolved outcomes that are truths."""
    return per_class_of(confusion(rows, by), classes, outcomes, by)


def per_class_of(counts: DataFrame, classes: DataFrame, outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The same from counts (by..., truth, predicted, n)."""
    by = by or []
    long = counts.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("class_id"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("predicted").alias("class_id"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hits")))).alias("c")).select(*by, "c.*")
    # A row a class and group: small, and asked for three times.
    sums = written(long.groupBy(*by, "class_id").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits")), "classes")
    wanted = sums.select(*by).distinct().crossJoin(F.broadcast(classes.select("class_id"))) if by else classes.select("class_id")  # classes: a fixed list
    wanted = wanted.unionByName(sums.where("support > 0").join(outcomes.join(classes, "class_id", "left_anti"), "class_id", "left_semi").select(*by, "class_id"))
    full = wanted.join(sums, [*by, "class_id"], "left").fillna(0, ["support", "claimed", "hits"])
    precision, recall = F.coalesce(ratio(F.col("hits"), F.col("claimed")), F.lit(0.0)), F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    made = full.select(*by, "class_id", "support", precision.alias("precision"), recall.alias("recall"))
    f1 = F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return made.withColumn("f1", f1)


def f1_summary(by_class: DataFrame, eligible: Column, by: list[str] | None = None) -> DataFrame:
    """Mean over the classes, and the mean weighted by support over all eligible records."""
    return by_class.groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), eligible).alias("weighted_f1"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy), empty bins with nulls."""
    spark = rows.sparkSession
    at = F.least(F.floor(F.col("p_top") * bins), F.lit(bins - 1)).alias("bin")
    got = rows.where("predicted is not null").groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.avg("p_top").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return spark.range(bins).select(F.col("id").alias("bin")).join(got, "bin", "left").fillna(0, ["n"])


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(ratio(F.sum(F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("n")), F.sum("n")).alias("ece"))


def _thresholds() -> Column:
    return F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold")


def selective(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(threshold, retained, coverage, error) of predictions of a declared class with at least that probability."""
    named = rows.join(F.broadcast(classes.select(F.col("class_id").alias("predicted"), F.lit(True).alias("named"))), "predicted", "left")
    each = named.select("p_top", "correct", F.coalesce("named", F.lit(False)).alias("named"), _thresholds())
    kept = F.col("named") & (F.col("p_top") >= F.col("threshold"))
    held = F.count_if(F.coalesce(kept, F.lit(False)))
    return each.groupBy("threshold").agg(held.alias("retained"), ratio(held, F.count(F.lit(1))).alias("coverage"), ratio(F.count_if(F.coalesce(kept & ~F.col("correct"), F.lit(False))), held).alias("error"))


def threshold_table(rows: DataFrame, classes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(threshold, retained, accuracy, weighted_f1): both measured again on what each threshold keeps."""
    named = rows.join(F.broadcast(classes.select(F.col("class_id").alias("predicted"))), "predicted", "left_semi")
    counts = written(confusion(named.select("*", _thresholds()).where(F.col("p_top") >= F.col("threshold")), ["threshold"]), "counts")
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    base = counts.groupBy("threshold").agg(F.sum("n").alias("retained"), ratio(F.sum(hit), F.sum("n")).alias("accuracy"))
    f1 = f1_summary(per_class_of(counts, classes, outcomes, ["threshold"]), F.sum("support"), ["threshold"]).select("threshold", "weighted_f1")
    return base.join(f1, "threshold")


def strata(rows: DataFrame, classes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(stratum, eligible, failed, abstained, top1, top3): named truths together, each unresolved truth for itself."""
    unresolved = outcomes.join(classes, "class_id", "left_anti").select(F.col("class_id").alias("stratum"))
    each = rows.join(F.broadcast(classes.select(F.col("class_id").alias("truth"), F.lit("named").alias("__named"))), "truth", "left").withColumn("stratum", F.coalesce("__named", "truth"))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = each.groupBy("stratum").agg(F.count(F.lit(1)).alias("eligible"), yes(F.col("predicted").isNull()).alias("failed"), yes(F.col("predicted").isNotNull() & ~F.col("accepted")).alias("abstained"), yes(F.col("correct")).alias("top1"), yes(F.col("in_top3")).alias("top3"))
    wanted = rows.sparkSession.range(1).select(F.lit("named").alias("stratum")).unionByName(unresolved)
    return wanted.join(got, "stratum", "left").fillna(0)


def relabelled(records: DataFrame, probabilities: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes replaced by their broad group (groups: class_id, broad; those without keep their own id), probabilities summed."""
    to = small(groups.select("class_id", "broad"))
    p = probabilities.join(to, "class_id", "left").groupBy("sample_id", F.coalesce("broad", "class_id").alias("class_id")).agg(F.sum("p").alias("p"))
    r = records.join(to.withColumnRenamed("class_id", "truth"), "truth", "left").withColumn("truth", F.coalesce("broad", "truth")).drop("broad")
    return r, p


def paired_delta(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidate minus baseline of two summaries with the same partitions."""
    names = ["top1", "coverage", "macro_f1"]
    a, b = baseline.select("partition", *[F.col(c).alias(f"a_{c}") for c in names]), candidate.select("partition", *[F.col(c).alias(f"b_{c}") for c in names])
    return a.join(b, "partition", "full_outer").select("partition", *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in names])


def paired_report(baseline: DataFrame, candidate: DataFrame, classes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(partition, eligible, delta_top1, delta_coverage, delta_macro_f1) of two runs over the same cases (rows of `scored`).

    Failures and cases without an answer stay in the denominators of both.
    """

    def measured(rows: DataFrame) -> DataFrame:
        f1 = f1_summary(per_class(rows, classes, outcomes, ["partition"]), F.sum("support"), ["partition"]).select("partition", "macro_f1")
        return summary(rows, ["partition"]).select("partition", "eligible", "top1", "coverage").join(f1, "partition")

    a, b = measured(baseline), measured(candidate)
    return paired_delta(a, b).join(a.select("partition", "eligible"), "partition").select("partition", "eligible", "delta_top1", "delta_coverage", "delta_macro_f1")


def paired_cases(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """A row a case of two runs: what each says, whether it is accepted, why it failed, and `change` of its correctness."""
    side = lambda rows, k: rows.select("sample_id", F.col("predicted").alias(f"{k}_top"), F.col("failure").alias(f"{k}_failure"), F.col("accepted").alias(f"{k}_accepted"), F.coalesce("correct", F.lit(False)).alias(f"__{k}"))
    both = baseline.select("sample_id", "patient_group_id", "partition", "truth").join(side(baseline, "baseline"), "sample_id").join(side(candidate, "candidate"), "sample_id", "left")
    change = F.when(F.col("__candidate") & ~F.col("__baseline"), "gained").when(F.col("__baseline") & ~F.coalesce("__candidate", F.lit(False)), "lost").otherwise("same")
    return both.withColumn("change", change).drop("__baseline", "__candidate")


def gate(run: DataFrame, least_top: float = 0.75, least_margin: float = 0.15, least_support: float = 0.8, most_conflict: float = 0.2) -> DataFrame:
    """Adds `reasons` to abstain (p_top, margin, support, conflict, predicted_kind, findings, source) and `accepted`."""
    reasons = F.array_compact(F.array(
        F.when(F.col("p_top") < least_top, "low_probability"), F.when(F.col("margin") < least_margin, "ambiguous"),
        F.when(F.col("support") < least_support, "insufficient_support"), F.when(F.col("conflict") > most_conflict, "conflicting_evidence"),
        F.when(F.col("predicted_kind") != "named", "unresolved_class"), F.when(F.col("findings") == 0, "no_findings"), F.when(F.col("source") != "live", "not_live"),
    ))
    return run.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
