"""Row numbers over whole tables, drawn permutations, and intervals without groups."""

import numpy as np

from cohortloom.operators import attribution, bootstrap
from cohortloom.operators.tables import row_numbers


def test_row_numbers(spark):
    df = spark.range(10_000).selectExpr("(id * 7919) % 10007 as k").repartition(13)
    got = sorted((r["k"], r["n"]) for r in row_numbers(df, ["k"], "n").collect())
    assert [n for _, n in got] == list(range(10_000))
    assert row_numbers(df.limit(0), ["k"], "n").count() == 0
    assert [r["n"] for r in row_numbers(df.limit(1), ["k"], "n").collect()] == [0]


def by_hand(seed, start, n):
    draws, order = bootstrap.draws(seed, start, max(0, n - 1)), list(range(n))
    for k, i in enumerate(range(n - 1, 0, -1)):
        j = int(draws[k]) % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def test_permutations(spark):
    for n in (1, 2, 5, 64, 300):
        made = bootstrap.permutations(9, np.arange(6), n)
        assert made.tolist() == [by_hand(9, p * max(1, n - 1), n) for p in range(6)]
    rows = attribution.permutation_prefixes(spark, 4, 30, 9).orderBy("pair", "direction", "step").collect()
    want = [f for p in range(30) for o in [by_hand(9, p * 3, 4)] for f in [*o, *o[::-1]]]
    assert [r["feature_index"] for r in rows] == want and all(r["after"] == r["before"] | 1 << r["feature_index"] for r in rows)


def test_too_few_groups_are_a_reason(spark):
    classes = spark.createDataFrame([("x",)], "class_id string")
    for rows in ([], [("p", "x", "x")], [("p", "x", "x"), ("p", "x", None)]):
        df = spark.createDataFrame(rows, "patient_group_id string, truth string, predicted string")
        got = bootstrap.intervals(bootstrap.replicate_measures(df, classes, 100)).collect()
        assert {(r["measure"], r["estimate"], r["reason"]) for r in got} == {(m, None, bootstrap.TOO_FEW) for m in ("top1", "weighted_f1")}
