"""Numerical helpers: expressions for the executors and small closed forms for the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054

# The rational approximation of erfc (Abramowitz and Stegun 7.1.26, about 1.5e-7).
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 as an expression."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERFC_A):
        poly = (poly + F.lit(a)) * t
    return poly * F.exp(-x * x)


def erfc_value(x: float) -> float:
    t = 1 / (1 + ERFC_P * x)
    poly = 0.0
    for a in reversed(ERFC_A):
        poly = (poly + a) * t
    return poly * math.exp(-x * x)


def chi_squared_tail(x: float, df: int) -> float:
    """P(X > x) for an integer number of degrees of freedom, by the recurrence of the incomplete gamma function."""
    half = x / 2
    if df % 2 == 0:
        terms = [math.exp(-half)]
        for k in range(1, df // 2):
            terms.append(terms[-1] * half / k)
        total = sum(terms)
    else:
        total = erfc_value(math.sqrt(half))
        term = 2 * math.sqrt(half / math.pi) * math.exp(-half)
        for k in range(df // 2):
            total += term
            term *= half / (k + 1.5)
    return min(1.0, max(0.0, total))


def chi_squared_tail_of(x: Column, df: Column) -> Column:
    """The same as an expression: null where x is, the recurrence as a fold over the terms."""
    half, k = x / 2, (df / 2).cast("int")
    state = lambda total, term: F.struct(total.cast("double").alias("total"), term.cast("double").alias("term"))
    terms = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    first = F.exp(-half)
    even = F.aggregate(terms(k - 1), state(first, first), lambda s, j: state(s["total"] + s["term"] * half / j, s["term"] * half / j))["total"]
    odd = F.aggregate(terms(k), state(erfc(F.sqrt(half)), 2 * F.sqrt(half / math.pi) * F.exp(-half)), lambda s, j: state(s["total"] + s["term"], s["term"] * half / (j + 0.5)))["total"]
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(df % 2 == 0, even).otherwise(odd))))


def solved(matrix: Column, right: Column, n: Column) -> Column:
    """x of `matrix` x = `right` by elimination with pivoting over array columns (array<array<double>>, array<double>, size).

    A struct (x, solved); not solved, and x null, if a pivot falls below 1e-10 of the largest entry.
    """
    scale = F.aggregate(F.flatten(matrix), F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))
    rows = F.transform(F.arrays_zip(matrix.alias("a"), right.alias("b")), lambda r: F.concat(r["a"], F.array(r["b"])))
    start = F.struct(rows.alias("m"), (scale > 0).alias("ok"))

    def step(s: Column, j: Column) -> Column:
        m = s["m"]
        size = lambda r: F.abs(F.element_at(F.element_at(m, r), j))
        best = F.array_max(F.transform(F.sequence(j, n), lambda r: F.struct(size(r).alias("v"), (-r).alias("r"))))
        ok = s["ok"] & (best["v"] >= scale * 1e-10)
        top = F.transform(F.element_at(m, -best["r"]), lambda v: v / F.element_at(F.element_at(m, -best["r"]), j))
        # The pivot's row goes to place j and the row that was there to the pivot's.
        swapped = F.transform(m, lambda row, i: F.when(i + 1 == -best["r"], F.element_at(m, j)).otherwise(row))
        cleared = F.transform(swapped, lambda row, i: F.when(i + 1 == j, top).otherwise(F.zip_with(row, top, lambda v, t: v - F.element_at(row, j) * t)))
        return F.struct(F.when(ok, cleared).otherwise(m).alias("m"), ok.alias("ok"))

    done = F.aggregate(F.sequence(F.lit(1), n), start, step)
    return F.struct(F.when(done["ok"], F.transform(done["m"], lambda row: F.element_at(row, -1))).alias("x"), done["ok"].alias("solved"))


def inverse(matrix: np.ndarray) -> np.ndarray | None:
    """Inverse of a small matrix; None if a pivot falls below 1e-10 of the largest entry."""
    a = np.array(matrix, dtype=float)
    n, scale = len(a), np.abs(a).max(initial=0.0)
    if not n or not np.isfinite(scale) or scale == 0:
        return None
    work = np.hstack([a, np.eye(n)])
    for j in range(n):
        pivot = j + int(np.abs(work[j:, j]).argmax())
        if abs(work[pivot, j]) < scale * 1e-10:
            return None
        work[[j, pivot]] = work[[pivot, j]]
        work[j] /= work[j, j]
        others = np.arange(n) != j
        work[others] -= np.outer(work[others, j], work[j])
    return work[:, n:]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))
