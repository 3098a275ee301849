"""Typed values by kind and modality, leaks in requests, and archives that are recomputed when they are opened."""

import os

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import attribution, scoring, values
from cohortloom.sources import bundles, runs

SHA = "ab" * 32
GOOD = {
    "expression": [("number", {"number": -1.5, "units": "log2"}), ("vector", {"entries": {"G1": 0.5}, "units": "r", "reference_sha256": SHA})],
    "mutation": [("number", {"number": 3.0, "units": "n"}), ("mutation", {"gene": "TP53", "chromosome": "17", "position": 5, "reference": "A", "alternate": "CT", "consequence": "missense"})],
    "copy_number": [("copy_number", {"gene": "MYC", "call": 2})],
    "signature": [("signature", {"signature": "SBS4", "number": 0.5, "units": "fraction", "catalogue": "v1", "method": "m", "mutation_count": 50})],
    "demographic": [("age", {"years": 120, "is_bound": True}), ("category", {"text": "x"})],
    "histology": [("category", {"text": "adeno"})],
    "ihc": [("number", {"number": 1.0, "units": "%"})],
}
BAD = [
    ("expression", "age", {"years": 3, "is_bound": False}, "modality"), ("histology", "number", {"number": 1.0, "units": "x"}, "modality"), ("mutation", "number", {"number": 1.5, "units": "n"}, "bounds"), ("ihc", "number", {"number": float("inf"), "units": "n"}, "bounds"),
    ("ihc", "number", {"number": 1.0}, "bounds"), ("copy_number", "copy_number", {"gene": "a b", "call": 0}, "bounds"), ("copy_number", "copy_number", {"gene": "a", "call": 3}, "bounds"), ("demographic", "age", {"years": 121, "is_bound": False}, "bounds"),
    ("histology", "category", {"text": "a\nb"}, "bounds"), ("histology", "category", {"text": "x" * 257}, "bounds"), ("signature", "vector", {"entries": {}, "units": "r", "reference_sha256": SHA}, "bounds"),
    ("signature", "vector", {"entries": {"a": float("nan")}, "units": "r", "reference_sha256": SHA}, "bounds"), ("signature", "vector", {"entries": {"a": 1.0}, "units": "r", "reference_sha256": "zz"}, "bounds"),
]


def column(v):
    if isinstance(v, dict):
        return F.create_map(*[F.lit(x) for kv in v.items() for x in kv]).cast("map<string,double>")
    return F.lit(v)


def test_values(spark):
    one = spark.range(1)
    row = lambda k, mode, kind, fields, status="observed": one.select(F.lit(k).alias("k"), F.lit(mode).alias("modality"), F.lit(status).alias("status"), values.tagged(F.lit(kind), **{n: column(v) for n, v in fields.items()}).alias("value"))
    good = [row(0, m, kind, fields) for m, every in GOOD.items() for kind, fields in every]
    assert set(GOOD) == {m for ms in values.FITS.values() for m in ms} and {k for e in GOOD.values() for k, _ in e} == set(values.FITS)
    df = good[0]
    for g in good[1:]:
        df = df.unionByName(g)
    assert values.problems(df, ["k"]).count() == 0
    bad = row(0, *BAD[0][:3])
    for i, b in enumerate(BAD[1:], 1):
        bad = bad.unionByName(row(i, *b[:3]))
    got = {r["k"]: r["problem"] for r in values.problems(bad, ["k"]).collect()}
    assert all(BAD[i][3] in got[i] for i in range(len(BAD))), got
    hidden = df.withColumn("status", F.lit("not_tested"))
    assert {r["problem"] for r in values.problems(hidden, ["k"]).collect()} == {"a value that was not observed"}
    none = df.withColumn("value", F.when(F.lit(False), F.col("value")))
    assert {r["problem"] for r in values.problems(none, ["k"]).collect()} == {"observed without a value"} and values.problems(none.withColumn("status", F.lit("not_tested")), ["k"]).count() == 0
    with pytest.raises(ValueError, match="no fields"):
        values.tagged(F.lit("age"), colour=F.lit(1))


def test_leaks(spark):
    asked = spark.createDataFrame([("c1", 1, "patient P-77 has type COLON/rectum"), ("c1", 2, "nothing of p-771 or xp-77"), ("c2", 3, "about c1 and P_77"), ("c3", 4, None), ("c4", 5, "")], "case_id string, n long, request string")
    secrets = spark.createDataFrame([("c1", "patient", "p-77"), ("c1", "label", "Colon rectum"), ("c2", "case", "c2"), ("c2", "label", "..."), ("c2", "label", None), ("c9", "case", "c9")], "case_id string, kind string, value string")
    assert sorted((r["case_id"], r["n"], r["kind"]) for r in scoring.leaks(asked, secrets).collect()) == [("c1", 1, "label"), ("c1", 1, "patient")]
    with pytest.raises(ValueError, match="c1 holds its"):
        scoring.without_leaks(asked, secrets)
    assert scoring.without_leaks(asked.where("n > 1"), secrets).count() == 4


def archive(spark, path):
    names = ["x", "y", "z"]
    table = spark.createDataFrame([(m, 0.1 + 0.2 * (m & 1) + 0.3 * (m >> 1 & 1) * (m & 1) + 0.01 * m) for m in range(8)], "mask long, value double")
    runs.export_attribution(table, attribution.exact(table, names), names, path)
    return table, names


def test_archives_are_recomputed(spark, tmp_path):
    path = str(tmp_path / "a")
    table, names = archive(spark, path)
    kind, found = runs.open_any(spark, path)
    assert kind == "attribution" and found["contributions"].count() == 3
    forged = str(tmp_path / "b")
    wrong = attribution.exact(table, names).withColumn("contribution", F.col("contribution") + F.when(F.col("feature") == "y", 0.1).otherwise(0.0))
    runs.export_attribution(table, wrong, names, forged)
    with pytest.raises(bundles.BundleError, match="contribution of y"):
        runs.open_attribution(spark, forged)
    short = str(tmp_path / "c")
    runs.export_attribution(table.where("mask <> 3"), attribution.exact(table, names), names, short)
    with pytest.raises(bundles.BundleError, match="not complete"):
        runs.open_attribution(spark, short)


def test_a_changed_row_is_refused_with_its_part(spark, tmp_path):
    path = str(tmp_path / "a")
    table, _ = archive(spark, path)
    (part,) = [r["part"] for r in bundles.digests(table.where("mask = 5"), ["mask"]).collect()]
    table.withColumn("value", F.when(F.col("mask") == 5, 9.0).otherwise(F.col("value"))).write.mode("overwrite").parquet(f"{path}/values")
    with pytest.raises(bundles.BundleError, match=f"values differs from the manifest in parts {part} of"):
        runs.open_attribution(spark, path)


def test_links_and_names_are_refused(spark, tmp_path):
    path = str(tmp_path / "a")
    archive(spark, path)
    os.rename(f"{path}/values", str(tmp_path / "elsewhere"))
    os.symlink(str(tmp_path / "elsewhere"), f"{path}/values")
    with pytest.raises(bundles.BundleError, match="link"):
        bundles.read(spark, path)
    for name in ("..", "a/b", ".hidden", "a/../b", ""):
        with pytest.raises(bundles.BundleError):
            bundles._inside(spark, path, name)
