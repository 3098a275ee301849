import numpy as np
from pyspark.sql import functions as F

from cohortloom.operators import bootstrap, evaluation
from cohortloom.plans.study import study_report, survival_report
from cohortloom.sources import bindings as B

R = "sample_id string, patient_group_id string, partition string, truth string, accepted boolean, failure string"
P = "sample_id string, class_id string, p double"


def data(spark, records, probabilities):
    r = spark.createDataFrame([(s, p, part, t, a, f) for s, p, part, t, a, f in records], R)
    return r, spark.createDataFrame([(s, c, float(p)) for s, v in probabilities.items() for c, p in v.items()], P)


def test_three_records(spark):
    r, p = data(spark, [("1", "p1", "test", "a", True, None), ("2", "p2", "test", "b", False, None), ("3", "p3", "test", "a", False, "timeout")], {"1": {"a": 0.8, "b": 0.2}, "2": {"a": 0.6, "b": 0.4}})
    rows = evaluation.scored(r, p)
    s = evaluation.summary(rows).first()
    assert abs(s["top1"] - 1 / 3) < 1e-12 and abs(s["brier"] - 0.4) < 1e-12 and s["accepted_accuracy"] == 1 and s["failed"] == 1
    ece = evaluation.expected_calibration_error(evaluation.reliability(rows)).first()["ece"]
    assert abs(ece - 0.4) < 1e-12
    assert evaluation.problems(r, p, B.named(spark, ["a", "b"])).count() == 0


def test_mixed_truths(spark):
    r, p = data(
        spark,
        [("1", "1", "test", "a", True, None), ("2", "2", "test", "unknown", False, None), ("3", "3", "test", "other", False, None), ("4", "4", "test", "other", False, "timeout")],
        {"1": {"a": 0.7, "b": 0.1, "unknown": 0.1, "other": 0.1}, "2": {"a": 0.1, "b": 0.1, "unknown": 0.7, "other": 0.1}, "3": {"a": 0.1, "b": 0.1, "unknown": 0.7, "other": 0.1}},
    )
    classes, outcomes = B.named(spark, ["a", "b"]), B.named(spark, ["a", "b", "unknown", "other"])
    rows = evaluation.scored(r, p)
    by = evaluation.per_class(rows, classes, outcomes)
    assert abs(evaluation.f1_summary(by, F.sum("support")).first()["weighted_f1"] - 5 / 12) < 1e-12
    assert evaluation.summary(rows).first()["top1"] == 0.5
    assert {x["threshold"]: x["retained"] for x in evaluation.selective(rows, classes).collect()}[0.0] == 1
    strata = {x["stratum"]: (x["eligible"], x["failed"], x["top1"]) for x in evaluation.strata(rows, classes, outcomes).collect()}
    assert strata == {"named": (1, 0, 1), "unknown": (1, 0, 1), "other": (2, 1, 0)}


def test_ties_go_to_the_smallest_id(spark):
    _, p = data(spark, [("1", "1", "test", "a", True, None)], {"1": {"b": 0.5, "a": 0.5}})
    assert evaluation.winners(p).first()["predicted"] == "a"
    assert evaluation.ranking(p).where("rank = 1").first()["class_id"] == "a"


def test_problems(spark):
    r, p = data(
        spark,
        [("1", "x", "test", "a", False, None), ("2", "x", "development", "a", False, None), ("3", "y", "test", "zzz", True, "failed"), ("3", "y", "test", "a", False, None), ("4", "z", "later", "a", False, "f")],
        {"1": {"a": 0.9, "b": 0.2}, "2": {"a": 1.0}, "3": {"a": 0.5, "b": 0.5}},
    )
    found = {x["problem"] for x in evaluation.problems(r, p, B.named(spark, ["a", "b"])).collect()}
    assert found == {"duplicate sample", "patient group crosses partitions", "truth is not an outcome", "unknown partition", "invalid probability vector", "success and failure are not explicit"}


def test_gate_and_delta(spark):
    run = spark.createDataFrame([(0.9, 0.5, 0.9, 0.0, "named", 3, "live"), (0.5, 0.1, 0.1, 0.9, "unknown", 0, "stored")], "p_top double, margin double, support double, conflict double, predicted_kind string, findings int, source string")
    got = sorted(r["reasons"] for r in evaluation.gate(run).collect())
    assert got == [[], ["low_probability", "ambiguous", "insufficient_support", "conflicting_evidence", "unresolved_class", "no_findings", "not_live"]]
    s = "partition string, top1 double, coverage double, macro_f1 double"
    d = evaluation.paired_delta(spark.createDataFrame([("test", 0.5, 0.5, 0.25)], s), spark.createDataFrame([("test", 0.75, 0.5, 0.5)], s)).first()
    assert (d["delta_top1"], d["delta_coverage"], d["delta_macro_f1"]) == (0.25, 0.0, 0.25)


def sequential(seed, n):
    out, mask = [], (1 << 64) - 1
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & mask
        z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return out


def test_counter_based_draws_are_the_sequence():
    assert bootstrap.draws(42, 0, 100).tolist() == sequential(42, 100)
    assert bootstrap.draws(42, 60, 40).tolist() == sequential(42, 100)[60:]
    assert sorted(bootstrap.permutations(7, __import__("numpy").arange(3), 9)[1].tolist()) == list(range(9))
    assert 0 <= bootstrap.unit(1, 0, 50).min() and bootstrap.unit(1, 0, 50).max() < 1


def test_bootstrap_against_a_loop(spark):
    g = np.random.default_rng(1)
    rows = [(f"p{g.integers(12):02d}", str(g.choice(list("abc"))), str(g.choice(list("abcz")))) for _ in range(60)]
    df = spark.createDataFrame(rows, "patient_group_id string, truth string, predicted string")
    got = {r["replicate"]: (r["top1"], r["weighted_f1"]) for r in bootstrap.replicate_measures(df, B.named(spark, list("abc")), 100, 9).collect()}
    names = sorted({r[0] for r in rows})
    draws = sequential(9, 100 * len(names))
    for rep in (-1, 0, 57):
        picked = names if rep < 0 else [names[d % len(names)] for d in draws[rep * len(names) : (rep + 1) * len(names)]]
        sample = [(t, p) for n in picked for q, t, p in rows if q == n]
        f1 = 0.0
        for c in "abc":
            s, k, h = sum(t == c for t, _ in sample), sum(p == c for _, p in sample), sum(t == p == c for t, p in sample)
            f1 += s * 2 * h / (s + k) if s + k else 0
        assert abs(got[rep][0] - np.mean([t == p for t, p in sample])) < 1e-12 and abs(got[rep][1] - f1 / len(sample)) < 1e-12


def test_reports(spark):
    sf = "/root/testdata/sf0.001"
    records, p = B.predictions(spark, sf)
    broad = spark.createDataFrame(list(B.BROAD.items()), "class_id string, broad string")
    report = study_report(records, p, B.named(spark, B.CLASSES), B.named(spark, B.OUTCOMES), "development", broad, 100)
    assert report["problems"].count() == 0 and report["broad"]["summary"].first()["eligible"] == report["detailed"]["summary"].first()["eligible"]
    assert report["bootstrap"].count() == 2
    made = survival_report(B.outcomes(spark, sf).limit(0), ["qty"])
    assert "cox_unavailable" in made and "subtype_log_rank_unavailable" in made
