"""Release assembly: what a release holds, and every gate."""

import pytest

from cohortloom.operators import releases


def parts(spark, samples=None, labels=None, records=None):
    s = samples or [("s1", "p1", "synthetic", "pass", "a"), ("s2", None, "synthetic", "warning", "b"), ("s3", "p3", "synthetic", "pass", "c")]
    m = labels or [("s1", "p1", "A", "alpha"), ("s2", "p2", "A", "alpha"), ("s3", "p3", "B", "beta")]
    r = records or [(s, g, float(i * k)) for i, s in enumerate(("s1", "s2", "s3"), 1) for k, g in enumerate(("G1", "G2"), 1)] + [("s1", "G3", 1.0), ("s1", None, 5.0), ("s2", "G3", None)]
    return (
        spark.createDataFrame(s, "sample_id string, patient_group_id string, data_class string, qc string, measurement_sha256 string"),
        spark.createDataFrame(m, "sample_id string, patient_group_id string, class_id string, cancer_type string"),
        spark.createDataFrame(r, "sample_id string, gene string, value double"),
    )


def test_a_release(spark):
    made = releases.release(*parts(spark))
    assert {(r["class_id"], r["gene"]): (r["mean"], r["members"]) for r in made["centroids"].collect()} == {("A", "G1"): (1.5, 2), ("A", "G2"): (3.0, 2), ("B", "G1"): (3.0, 1), ("B", "G2"): (6.0, 1)}
    assert {(r["class_id"], r["cancer_type"], r["samples"]) for r in made["classes"].collect()} == {("A", "alpha", 2), ("B", "beta", 1)}
    assert {r["gene"] for r in made["genes"].collect()} == {"G1", "G2"}
    assert {(r["sample_id"], r["patient_group_id"]) for r in made["members"].collect()} == {("s1", "p1"), ("s2", "p2"), ("s3", "p3")}


@pytest.mark.parametrize(("change", "want"), [
    ({"samples": [("s1", "p9", "synthetic", "pass", "a"), ("s2", None, "synthetic", "pass", "b"), ("s3", "p3", "synthetic", "pass", "c")]}, ("s1", "patient group conflicts with the sample")),
    ({"samples": [("s1", "p1", "synthetic", "blocked", "a"), ("s2", None, "synthetic", None, "b"), ("s3", "p3", "synthetic", "pass", "c")]}, ("s2", "blocked or absent quality control")),
    ({"samples": [("s1", "p1", "synthetic", "pass", "a"), ("s2", None, "research", "pass", "b"), ("s3", "p3", None, "pass", "c")]}, ("release", "synthetic and research samples together")),
    ({"labels": [("s1", "p1", "A", "alpha"), ("s2", "p2", "A", "alpha")]}, ("s3", "no label")),
    ({"labels": [("s1", "p1", "A", "alpha"), ("s2", "p2", "A", "other"), ("s3", "p3", "B", "beta")]}, ("A", "class has conflicting names")),
    ({"records": [("s1", "G1", 1.0), ("s1", "G1", 1.0), ("s2", "G1", 2.0), ("s3", "G1", 2.0)]}, ("s1", "duplicate canonical gene")),
    ({"records": [("s1", "G1", 1.0), ("s2", "G1", float("nan")), ("s3", "G1", 2.0)]}, ("s2", "value is not finite")),
    ({"records": [("s1", "G1", 1.0), ("s2", "G2", 1.0), ("s3", "G1", 2.0)]}, ("release", "no gene is measured in every sample")),
])
def test_gates(spark, change, want):
    got = parts(spark, **change)
    assert want in {(r["subject"], r["problem"]) for r in releases.problems(*got).collect()}
    with pytest.raises(releases.ReleaseError):
        releases.release(*got)


def test_the_measured_view_refuses(spark):
    _, _, records = parts(spark)
    assert releases.measured_view(records).count() == 7
    for bad in ([("s1", "G1", 1.0), ("s1", "G1", 2.0)], [("s1", "G1", float("inf"))]):
        with pytest.raises(Exception, match="duplicate canonical gene or value"):
            releases.measured_view(parts(spark, records=bad)[2]).collect()


def test_too_large_and_empty(spark):
    samples, labels, records = parts(spark)
    assert "too many centroid values" in {r["problem"] for r in releases.problems(samples, labels, records, most=3).collect()}
    assert "no samples" in {r["problem"] for r in releases.problems(samples.limit(0), labels.limit(0), records.limit(0)).collect()}
