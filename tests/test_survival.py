import math

import numpy as np
import pytest

from cohortloom.functions.stats import chi_squared_tail, erfc_value, inverse
from cohortloom.operators import survival

SCHEMA = "patient_id long, grp string, entry double, time double, event boolean, concordance string, propensity double, x double"


def rows(spark, given):
    """given: (time, event[, entry[, arm[, x]]])"""
    made = []
    for i, g in enumerate(given):
        t, e, entry, arm, x = (*g, *(0.0, "concordant", 0.0)[len(g) - 2 :]) if len(g) < 5 else g
        made.append((i, arm, float(entry), float(t), bool(e), arm, 0.5, float(x)))
    return spark.createDataFrame(made, SCHEMA)


def curve(df):
    return [(r["t"], r["at_risk"], r["survival"]) for r in sorted(df.collect(), key=lambda r: r["t"])]


@pytest.mark.parametrize("blocks", [1, 2, 64])
def test_ties_and_censoring(spark, blocks):
    df = rows(spark, [(1, 1), (2, 0), (2, 1), (3, 1)])
    km = survival.kaplan_meier(df, ["grp"], blocks=blocks)
    assert curve(km) == [(1, 4, 0.75), (2, 3, 0.5), (3, 1, 0.0)]
    assert survival.medians(km, ["grp"]).first()["median"] == 2
    table = {r["tick"]: r["at_risk"] for r in survival.risk_table(rows(spark, [(1, 1), (2, 0), (2, 1), (4, 1)]), ["grp"]).collect()}
    assert table == {0: 4, 1: 4, 2: 3, 3: 1, 4: 1}
    assert survival.step_points(km, ["grp"]).count() == 6


def test_delayed_entry_and_weights(spark):
    from pyspark.sql import functions as F

    df = rows(spark, [(1, 1), (3, 0), (2, 1, 1.0)])
    assert curve(survival.kaplan_meier(df, ["grp"])) == [(1, 2, 0.5), (2, 2, 0.25), (3, 1, 0.25)]
    km = survival.kaplan_meier(df, ["grp"], F.when(F.col("patient_id") == 0, 2.0).otherwise(1.0))
    assert abs(curve(km)[0][2] - 1 / 3) < 1e-12 and "lower" not in km.columns


def test_bounds_are_greenwood_log_log(spark):
    first = sorted(survival.kaplan_meier(rows(spark, [(1, 1), (2, 1), (3, 1), (4, 0)]), ["grp"]).collect(), key=lambda r: r["t"])[0]
    se = math.sqrt(1 / (4 * 3)) / abs(math.log(0.75))
    assert abs(first["lower"] - 0.75 ** math.exp(1.959963984540054 * se)) < 1e-12
    assert abs(first["upper"] - 0.75 ** math.exp(-1.959963984540054 * se)) < 1e-12


def test_two_group_log_rank(spark):
    df = rows(spark, [(1, 1, 0, "concordant"), (2, 1, 0, "discordant"), (3, 1, 0, "concordant"), (4, 1, 0, "discordant")])
    r = survival.two_group_log_rank(df, "grp", "concordant").first()
    assert abs(r["observed_minus_expected"] - (0.5 - 1 / 3 + 0.5)) < 1e-12
    assert abs(r["variance"] - (0.25 + 2 / 9 + 0.25)) < 1e-12
    none = survival.two_group_log_rank(rows(spark, [(1, 0, 0, "concordant"), (2, 0, 0, "discordant")]), "grp", "concordant").first()
    assert none is None or none["chi_squared"] is None


def test_k_group_log_rank(spark):
    df = rows(spark, [(t, 1, 0, g) for t in (1, 2) for g in ("a", "b", "c")])
    got = survival.k_group_log_rank(df)
    assert got["degrees_of_freedom"] == 2 and abs(got["chi_squared"]) < 1e-9 and abs(got["p_value"] - 1) < 1e-9
    with pytest.raises(survival.Unavailable):
        survival.k_group_log_rank(rows(spark, [(1, 1, 0, "a")]))


def test_cox_closed_form(spark):
    df = rows(spark, [(1, 1, 0, "concordant"), (2, 1, 0, "discordant"), (3, 1, 0, "concordant"), (4, 1, 0, "discordant")])
    c = survival.cox(df, [])["coefficients"][0]
    assert abs(c["hazard_ratio"] - (1 + math.sqrt(17)) / 2) < 1e-6
    tied = survival.cox(rows(spark, [(1, 1, 0, "concordant"), (1, 1, 0, "discordant"), (2, 1, 0, "concordant"), (2, 1, 0, "discordant")]), [])["coefficients"][0]
    assert abs(tied["hazard_ratio"] - 1) < 1e-9 and abs(tied["standard_error"] - 1) < 1e-9


def test_cox_against_a_plain_likelihood(spark):
    r = np.random.default_rng(4)
    given = [(float(r.integers(3, 14)), bool(r.random() < 0.7), float(r.integers(0, 3)), r.choice(["concordant", "discordant"]), float(r.normal())) for _ in range(36)]
    fit = survival.cox(rows(spark, given), ["x"], blocks=4)
    beta = np.array([c["log_hazard_ratio"] for c in fit["coefficients"]])
    z = np.array([[g[3] == "concordant", g[4]] for g in given], dtype=float)

    def gradient(b):
        out = np.zeros(2)
        for t in {g[0] for g in given if g[1]}:
            risk = np.array([g[2] < t <= g[0] for g in given])
            dead = np.array([g[1] and g[0] == t for g in given])
            w = np.exp(z @ b) * risk
            out += z[dead].sum(0) - dead.sum() * (w @ z) / w.sum()
        return out

    assert np.abs(gradient(beta)).max() < 1e-4


def test_cox_refuses(spark):
    with pytest.raises(survival.Unavailable):
        survival.cox(rows(spark, [(t, 1, 0, "concordant" if t < 5 else "discordant") for t in range(1, 9)]), [])
    with pytest.raises(survival.Unavailable):
        survival.cox(rows(spark, [(1, 1), (2, 0)]), [])


def test_small_numbers():
    for df in range(1, 8):
        for x in (0.1, 1.0, 5.0, 20.0):
            grid = np.linspace(x, x + 200, 400_001)
            density = grid ** (df / 2 - 1) * np.exp(-grid / 2) / (2 ** (df / 2) * math.gamma(df / 2))
            assert abs(chi_squared_tail(x, df) - np.trapezoid(density, grid)) < 1e-4
    assert abs(erfc_value(0.7) - math.erfc(0.7)) < 2e-7
    assert inverse(np.array([[1.0, 1.0], [1.0, 1.0]])) is None
    assert np.allclose(inverse(np.array([[0.0, 2.0], [1.0, 1.0]])), np.linalg.inv([[0.0, 2.0], [1.0, 1.0]]))


def test_problems(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0, True, "x", 0.5, 0.0), (1, "a", -1.0, 2.0, None, "x", 1.0, 0.0), (None, "a", 0.0, float("nan"), True, "x", None, 0.0)], SCHEMA)
    found = {r["problem"] for r in survival.problems(df).collect()}
    assert found == {"exit does not follow entry", "negative entry", "missing event", "propensity outside (0, 1)", "duplicate patient", "missing patient", "interval is not finite"}


def test_unusable_weights(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 1.0, True, "concordant", 0.001, 0.0), (2, "a", 0.0, 2.0, True, "discordant", 0.5, 1.0)], SCHEMA)
    got = {r["concordance"]: r for r in survival.weight_diagnostics(df).collect()}
    assert got["concordant"]["unusable"] == 1 and got["discordant"]["effective_n"] == 1


def test_global_test_in_the_plan(spark):
    balanced = rows(spark, [(t, 1, 0, g) for t in (1, 2, 3) for g in ("a", "b", "c")])
    r = survival.k_group_test(balanced, "grp").first()
    assert r["degrees_of_freedom"] == 2 and abs(r["chi_squared"]) < 1e-12 and abs(r["p_value"] - 1) < 1e-12 and r["reason"] is None
    import random

    rng = random.Random(4)
    given = [(rng.randrange(1, 12), rng.random() < 0.7, rng.randrange(0, 1), rng.choice("abcd")) for _ in range(120)]
    df = rows(spark, given)
    r = survival.k_group_test(df, "grp").first()
    terms = {x["grp"]: x["observed"] - x["expected"] for x in survival.log_rank_terms(df).collect()}
    cov = {(x["g"], x["h"]): x["covariance"] for x in survival.log_rank_covariance(df).collect()}
    d, v = np.array([terms[g] for g in "abc"]), np.array([[cov[g, h] for h in "abc"] for g in "abc"])
    chi = float(d @ np.linalg.inv(v) @ d)
    assert abs(r["chi_squared"] - chi) < 1e-9 and abs(r["p_value"] - chi_squared_tail(chi, 3)) < 1e-12
    none = survival.k_group_test(rows(spark, [(1, 0, 0, "a"), (2, 0, 0, "b"), (2, 0, 0, "c")]), "grp").first()
    assert none["chi_squared"] is None and none["p_value"] is None and none["reason"] == survival.SINGULAR
    alone = survival.k_group_test(rows(spark, [(1, 0, 0, "a"), (2, 1, 0, "b"), (3, 1, 0, "b"), (4, 0, 0, "c")]), "grp").first()
    assert alone["reason"] == survival.SINGULAR


def test_tails_and_elimination_as_expressions(spark):
    from pyspark.sql import functions as F

    from cohortloom.functions.stats import chi_squared_tail_of, solved

    got = spark.range(1, 32).select(F.col("id").cast("int").alias("df"), F.explode(F.array(*[F.lit(x) for x in (0.0, 0.3, 4.0, 31.0, 200.0)])).alias("x")).withColumn("p", chi_squared_tail_of(F.col("x"), F.col("df"))).collect()
    assert all(abs(r["p"] - chi_squared_tail(r["x"], r["df"])) < 1e-12 for r in got)
    rng = np.random.default_rng(1)
    systems = [(rng.normal(size=(n, n)).tolist(), rng.normal(size=n).tolist(), n) for n in (1, 2, 3, 6, 12, 31)] + [([[0.0, 1.0], [1.0, 0.0]], [2.0, 3.0], 2), ([[1.0, 2.0], [2.0, 4.0]], [1.0, 1.0], 2), ([[0.0]], [1.0], 1)]
    df = spark.createDataFrame(systems, "m array<array<double>>, b array<double>, n int")
    for (m, b, n), r in zip(systems, df.select(solved(F.col("m"), F.col("b"), F.col("n")).alias("s")).collect()):
        inv = inverse(np.array(m))
        assert r["s"]["solved"] == (inv is not None)
        assert inv is None or np.allclose(r["s"]["x"], inv @ np.array(b), atol=1e-8), (n, r)


def test_no_table_is_left_cached(spark):
    df = rows(spark, [(t, t % 2, 0, g) for t in range(1, 9) for g in ("concordant", "discordant")])
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    survival.kaplan_meier(df, ["grp"]).collect(), survival.k_group_test(df, "grp").collect(), survival.two_group_log_rank(df, "grp", "concordant").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
