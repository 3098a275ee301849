"""Whole reports: what is available goes in, what isn't carries its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import bootstrap, evaluation, survival


def survival_report(rows: DataFrame, covariates: list[str]) -> dict:
    """DataFrames of the curves and tables, small results of the tests, and reasons for what is unavailable."""
    arms = rows.where(F.col("concordance").isin(*survival.ARMS))
    report: dict = {
        "problems": survival.problems(rows), "by_class": survival.kaplan_meier(rows, ["grp"]), "risk_table": survival.risk_table(rows, ["grp"]),
        "by_concordance": survival.kaplan_meier(arms, ["concordance"]),
    }
    for name, make in (("log_rank", lambda: survival.two_group_log_rank(arms, "concordance", "concordant")), ("subtype_log_rank", lambda: survival.k_group_log_rank(rows)), ("cox", lambda: survival.cox(rows, covariates))):
        try:
            report[name] = make()
        except survival.Unavailable as reason:
            report[f"{name}_unavailable"] = str(reason)
    weighed = survival.weights(rows)
    if weighed.where("weight is null").limit(1).count():
        report["weighted_unavailable"] = "propensity missing or outside [0.01, 0.99]; nothing is clipped"
    else:
        report |= {"weighted": survival.kaplan_meier(weighed, ["concordance"], F.col("weight")), "weights": survival.weight_diagnostics(rows), "balance": survival.balance(rows, covariates)}
    return report


def study_report(records: DataFrame, probabilities: DataFrame, classes: DataFrame, outcomes: DataFrame, partition: str = "test", broad: DataFrame | None = None, replicates: int = 200, seed: int = 42) -> dict:
    """Evaluation of one partition, over the classes and again over their broad groups, with clustered intervals."""

    def part(r: DataFrame, p: DataFrame, c: DataFrame, o: DataFrame) -> dict:
        rows = evaluation.scored(r.where(F.col("partition") == partition), p)
        by = evaluation.per_class(rows, c, o)
        bins = evaluation.reliability(rows)
        return {
            "summary": evaluation.summary(rows), "confusion": evaluation.confusion(rows), "per_class": by, "f1": evaluation.f1_summary(by, F.sum("support")), "reliability": bins,
            "ece": evaluation.expected_calibration_error(bins), "selective": evaluation.selective(rows, c), "thresholds": evaluation.threshold_table(rows, c, o), "strata": evaluation.strata(rows, c, o), "rows": rows,
        }

    report = {"problems": evaluation.problems(records, probabilities, outcomes), "detailed": part(records, probabilities, classes, outcomes)}
    if broad is not None:
        r, p = evaluation.relabelled(records, probabilities, broad)
        to = lambda c: c.join(broad, "class_id", "left").select(F.coalesce("broad", "class_id").alias("class_id")).distinct()
        report["broad"] = part(r, p, to(classes), to(outcomes))
    try:
        report["bootstrap"] = bootstrap.intervals(bootstrap.replicate_measures(report["detailed"]["rows"], outcomes, replicates, seed))
    except ValueError as reason:
        report["bootstrap_unavailable"] = str(reason)
    return report
