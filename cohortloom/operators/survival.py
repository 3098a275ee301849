"""Survival statistics with delayed entry: Kaplan-Meier, log-rank, Cox and inverse-probability weights.

An observation is at risk over (entry, time]; exits at one time share a risk set. Risk sets come from a sweep: entries
and exits are summed per distinct time and run along the time axis, so there is no range join, and what is ordered is
distinct times, not patients. Columns: patient_id, grp, entry, time, event (boolean), concordance, propensity and the
covariates by name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.stats import Z95, chi_squared_tail_of, erfc, erfc_value, inverse, ratio, solved
from cohortloom.operators.running import BLOCKS, quantile_block, running
from cohortloom.operators.tables import tasks_for, written

MOST_GROUPS = 32
# Patients that one task counts.
TASK_PATIENTS = 1_000_000
ARMS = ("concordant", "discordant")


class Unavailable(Exception):
    """A statistic that the data don't support; the text is the reason that a report carries."""


def problems(rows: DataFrame) -> DataFrame:
    """(patient_id, problem) of observations that no survival statistic may use.

    The rows are made once; their ids and problems are kept, as ids are then counted in tasks of about `TASK_PATIENTS`.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    checks = F.array_compact(F.array(
        F.when(F.col("patient_id").isNull(), "missing patient"),
        F.when(~(finite("entry") & finite("time")), "interval is not finite"),
        F.when(F.col("entry") < 0, "negative entry"),
        F.when(F.col("time") <= F.col("entry"), "exit does not follow entry"),
        F.when(F.col("event").isNull(), "missing event"),
        F.when((F.col("propensity") <= 0) | (F.col("propensity") >= 1), "propensity outside (0, 1)"),
    ))
    checked = written(rows.select("patient_id", checks.alias("problems")), "checked")
    duplicate = F.lit("duplicate patient").alias("problem")
    ids = checked.where("patient_id is not null").select("patient_id")
    ids = ids.repartition(tasks_for(rows.sparkSession, checked.count(), TASK_PATIENTS), "patient_id")
    repeated = ids.groupBy("patient_id").count().where("count > 1").select("patient_id", duplicate)
    unnamed = checked.where("patient_id is null").agg(F.count(F.lit(1)).alias("n"), F.max("patient_id").alias("patient_id")).where("n > 1").select("patient_id", duplicate)
    return checked.select("patient_id", F.explode("problems").alias("problem")).unionByName(repeated).unionByName(unnamed)


def _steps(rows: DataFrame, by: list[str], values: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(by..., t, values...) summed per distinct time: a row steps in at its entry and out at its time, from one scan.

    values: what a row adds at its entry and at its time. The table has one row a group and distinct time; it is kept, as
    its quantiles are asked for before its running sums.
    """
    step = lambda t, which: F.struct(F.col(t).cast("double").alias("t"), *[v[which].cast("double").alias(k) for k, v in values.items()])
    each = rows.select(*by, F.inline(F.array(step("entry", 0), step("time", 1))))
    return written(each.groupBy(*by, "t").agg(*[F.sum(k).alias(k) for k in values]), "times")


def _sweep(rows: DataFrame, by: list[str], weight: Column | None, blocks: int) -> tuple[DataFrame, Column]:
    """The table of `sweep` and the blocks that its running values use."""
    w, zero = F.lit(1.0) if weight is None else weight.cast("double"), F.lit(0.0)
    event = F.col("event")
    steps = _steps(rows, by, {"came": (w, zero), "left": (zero, w), "deaths": (zero, F.when(event, w).otherwise(0.0)), "censored": (zero, F.when(event, 0.0).otherwise(w))})
    block = quantile_block(steps, "t", blocks)
    run = running(steps, by, block, "t", {"all_came": "came", "all_left": "left"}, inclusive=False)
    return run.where("left > 0").select(*by, "t", (F.col("all_came") - F.col("all_left")).alias("at_risk"), "deaths", "censored"), block


def sweep(rows: DataFrame, by: list[str], weight: Column | None = None, blocks: int = BLOCKS) -> DataFrame:
    """(by..., t, at_risk, deaths, censored) at every distinct exit time; sums of weights if there is one."""
    return _sweep(rows, by, weight, blocks)[0]


def kaplan_meier(rows: DataFrame, by: list[str], weight: Column | None = None, blocks: int = BLOCKS) -> DataFrame:
    """Product-limit curve at every exit time with Greenwood log-log bounds (none for weighted curves)."""
    at, block = _sweep(rows, by, weight, blocks)
    n, d = F.col("at_risk"), F.col("deaths")
    at = at.withColumn("keep", F.lit(1.0) - ratio(d, n)).withColumn("term", F.coalesce(ratio(d, n * (n - d)), F.lit(0.0)))
    curve = running(at, by, block, "t", {"variance": "term"}, {"survival": "keep"})
    if weight is not None:
        return curve.select(*by, "t", "at_risk", "deaths", "censored", "survival")
    s = F.col("survival")
    inside = (s > 0) & (s < 1)
    spread = F.lit(Z95) * F.sqrt("variance") / F.abs(F.ln(F.when(inside, s)))
    bound = lambda sign: F.when(inside, F.pow(s, F.exp(F.lit(sign) * spread))).otherwise(s)
    return curve.select(*by, "t", "at_risk", "deaths", "censored", "survival", bound(1.0).alias("lower"), bound(-1.0).alias("upper"))


def medians(curve: DataFrame, by: list[str]) -> DataFrame:
    """First time with a survival of at most one half, null where it isn't reached."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))


def step_points(curve: DataFrame, by: list[str]) -> DataFrame:
    """Corners of the curve for drawing: at each time the value before and the value after."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.lag("survival").over(W.partitionBy(*by).orderBy("t")), F.lit(1.0))
    stepped = curve.select(*by, "t", F.array(before, F.col("survival")).alias("__s"))
    return stepped.select(*by, "t", F.posexplode("__s").alias("corner", "survival"))


def risk_table(rows: DataFrame, by: list[str], ticks: int = 5) -> DataFrame:
    """Numbers at risk at equal ticks from zero to the last time; at zero those who enter at the start."""
    last = rows.agg(F.max("time").alias("t")).first()["t"] or 0.0
    at = F.explode(F.array(*[F.lit(float(last) * k / (ticks - 1)) for k in range(ticks)])).alias("tick")
    each = rows.select(*by, "entry", "time", at)  # a fixed number of ticks a row
    held = F.when(F.col("tick") == 0, F.col("entry") == 0).otherwise((F.col("entry") < F.col("tick")) & (F.col("time") >= F.col("tick")))
    return each.groupBy(*by, "tick").agg(F.count_if(held).alias("at_risk"))


def _group_names(rows: DataFrame, group: str) -> list:
    """The groups of a test, in order; their number is checked before anything is made of it."""
    names = [r[0] for r in rows.select(group).dropna().distinct().limit(MOST_GROUPS + 1).collect()]
    if not 2 <= len(names) <= MOST_GROUPS:
        raise Unavailable("the log-rank test needs 2 to 32 groups")
    return sorted(names)


def _risk_sets(rows: DataFrame, group: str, names: list, blocks: int = BLOCKS) -> DataFrame:
    """(n, d, at, died) at every event time: all at risk, all deaths, and both by group as arrays. One scan, one running pass."""
    mine = [F.col(group) == g for g in names]
    one, zero = F.lit(1.0), F.lit(0.0)
    values = {f"r{i}": (F.when(m, one).otherwise(0.0), F.when(m, -one).otherwise(0.0)) for i, m in enumerate(mine)}
    values |= {f"d{i}": (zero, F.when(m & F.col("event"), one).otherwise(0.0)) for i, m in enumerate(mine)}
    steps = _steps(rows.where(F.col(group).isNotNull()), [], values).withColumn("__all", F.lit(0))
    run = running(steps, ["__all"], quantile_block(steps, "t", blocks), "t", {f"n{i}": f"r{i}" for i in range(len(names))}, inclusive=False)
    total = lambda c: sum((F.col(f"{c}{i}") for i in range(1, len(names))), F.col(f"{c}0"))
    array = lambda c: F.array(*[F.col(f"{c}{i}") for i in range(len(names))])
    return run.select(total("n").alias("n"), total("d").alias("d"), array("n").alias("at"), array("d").alias("died")).where("d > 0")


def log_rank_sums(rows: DataFrame, group: str = "grp") -> DataFrame:
    """(g, h, covariance, observed, expected) over all event times; the last two where g = h, and 0 elsewhere. 2 to 32 groups, rows without one are left out.

    Everything that a log-rank test needs, from one scan, one running pass and one grouping.
    """
    names = _group_names(rows, group)
    at = _risk_sets(rows, group, names).select("n", "d", "at", "died", F.posexplode("at").alias("g", "ng")).select("n", "d", "died", "g", "ng", F.posexplode("at").alias("h", "nh"))
    n, d, same = F.col("n"), F.col("d"), F.col("g") == F.col("h")
    both = F.when(same, F.col("ng") / n).otherwise(0.0) - F.col("ng") * F.col("nh") / (n * n)
    term = F.when(n > 1, d * (n - d) / (n - 1) * both).otherwise(0.0)
    sums = at.groupBy("g", "h").agg(
        F.sum(term).alias("covariance"), F.sum(F.when(same, F.element_at("died", F.col("g") + 1)).otherwise(0.0)).alias("observed"), F.sum(F.when(same, d * F.col("ng") / n).otherwise(0.0)).alias("expected"),
    )
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1).alias(c)
    return sums.select(name("g"), name("h"), "covariance", "observed", "expected")


def log_rank_terms(rows: DataFrame, group: str = "grp") -> DataFrame:
    """(group, observed, expected) over all event times; 2 to 32 groups, rows without one are left out."""
    return log_rank_sums(rows, group).where("g = h").select(F.col("g").alias(group), "observed", "expected")


def log_rank_covariance(rows: DataFrame, group: str = "grp") -> DataFrame:
    """(g, h, covariance) of observed minus expected, hypergeometric for ties; 2 to 32 groups."""
    return log_rank_sums(rows, group).select("g", "h", "covariance")


def two_group_log_rank(rows: DataFrame, group: str, first: str) -> DataFrame:
    """One row: observed minus expected of `first`, its variance, chi-squared and p; nulls without informative risk sets."""
    own = log_rank_sums(rows, group).where((F.col("g") == first) & (F.col("h") == first))
    delta, known = F.col("observed") - F.col("expected"), F.col("covariance") > 1e-12
    chi = F.when(known, delta * delta / F.col("covariance"))
    return own.select(delta.alias("observed_minus_expected"), F.col("covariance").alias("variance"), chi.alias("chi_squared"), F.least(erfc(F.sqrt(chi / 2)), F.lit(1.0)).alias("p_value"))


SINGULAR = "singular event covariance"


def k_group_test(rows: DataFrame, group: str = "grp") -> DataFrame:
    """One row: groups, degrees_of_freedom, chi_squared, p_value and reason of the global test over 2 to 32 groups, solved in the plan.

    The last group in order is left out of the system. Without events, or where the covariance is singular, the statistic
    and p are null and the reason is given.
    """
    names = _group_names(rows, group)
    sums = log_rank_sums(rows, group).where((F.col("g") != names[-1]) & (F.col("h") != names[-1]))
    row = sums.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "covariance"))), lambda x: x["covariance"]).alias("v"), F.sum(F.col("observed") - F.col("expected")).alias("delta"))
    # At most 31 rows of 31 numbers.
    one = row.agg(F.sort_array(F.collect_list(F.struct("g", "v", "delta"))).alias("r")).select(F.transform("r", lambda x: x["v"]).alias("v"), F.transform("r", lambda x: x["delta"]).alias("delta"))
    df = len(names) - 1
    there = F.size("v") == df
    answer = one.select("delta", F.when(there, solved(F.col("v"), F.col("delta"), F.lit(df))).alias("s"))
    chi = F.greatest(F.lit(0.0), F.aggregate(F.zip_with("delta", F.col("s.x"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    found = answer.select(F.when(F.col("s.solved"), chi).alias("chi_squared"))
    return found.select(
        F.array(*map(F.lit, names)).alias("groups"), F.lit(df).alias("degrees_of_freedom"), "chi_squared", chi_squared_tail_of(F.col("chi_squared"), F.lit(df)).alias("p_value"),
        F.when(F.col("chi_squared").isNull(), SINGULAR).alias("reason"),
    )


def k_group_log_rank(rows: DataFrame, group: str = "grp") -> dict:
    """The same as a value; raises where there is no statistic."""
    found = k_group_test(rows, group).first()
    if found["chi_squared"] is None:
        raise Unavailable("the global log-rank test has a singular covariance")
    return {k: found[k] for k in ("groups", "degrees_of_freedom", "chi_squared", "p_value")}


def weights(rows: DataFrame) -> DataFrame:
    """Adds `weight`: 1/p for the concordant, 1/(1-p) for the discordant; null where the propensity is unusable."""
    p = F.when(F.col("propensity").between(0.01, 0.99), F.col("propensity"))
    arms = rows.where(F.col("concordance").isin(*ARMS))
    return arms.withColumn("weight", F.when(F.col("concordance") == ARMS[0], 1 / p).otherwise(1 / (1 - p)))


def weight_diagnostics(rows: DataFrame) -> DataFrame:
    """(concordance, patients, unusable, min_propensity, max_propensity, max_weight, effective_n)."""
    w = F.col("weight")
    return weights(rows).groupBy("concordance").agg(
        F.count(F.lit(1)).alias("patients"), F.count_if(w.isNull()).alias("unusable"), F.min("propensity").alias("min_propensity"), F.max("propensity").alias("max_propensity"),
        F.max("weight").alias("max_weight"), ratio(F.sum("weight") * F.sum("weight"), F.sum(w * w)).alias("effective_n"),
    )


def balance(rows: DataFrame, covariates: list[str]) -> DataFrame:
    """(covariate, unweighted_smd, weighted_smd), scaled by the pooled unweighted population deviation."""
    long = weights(rows).select("concordance", "weight", F.explode(F.map_from_arrays(F.array(*map(F.lit, covariates)), F.array(*[F.col(c).cast("double") for c in covariates]))).alias("covariate", "x"))
    of = lambda arm, x: F.when(F.col("concordance") == arm, x)
    w = F.col("weight")
    aggs = []
    for k, arm in enumerate(ARMS):
        aggs += [F.avg(of(arm, F.col("x"))).alias(f"m{k}"), F.var_pop(of(arm, F.col("x"))).alias(f"v{k}"), ratio(F.sum(of(arm, w * F.col("x"))), F.sum(of(arm, w))).alias(f"w{k}")]
    scale = F.sqrt((F.col("v0") + F.col("v1")) / 2)
    return long.groupBy("covariate").agg(*aggs).select("covariate", ratio(F.col("m0") - F.col("m1"), scale).alias("unweighted_smd"), ratio(F.col("w0") - F.col("w1"), scale).alias("weighted_smd"))


def cox(rows: DataFrame, covariates: list[str], blocks: int = BLOCKS, most_iterations: int = 50) -> dict:
    """Proportional hazards of concordant against discordant with covariates: Breslow ties, delayed entry, Wald bounds.

    Each step of Newton's method is one job: risk-weighted moments per distinct time run along the axis and are reduced
    to a value, a gradient and a matrix of at most 9 x 9, which is all that reaches the driver. Refuses with a reason.
    """
    if len(covariates) > 8:
        raise Unavailable("at most eight covariates are supported")
    arms = rows.where(F.col("concordance").isin(*ARMS))
    names = ["concordant", *covariates]
    p = len(names)
    x = [(F.col("concordance") == ARMS[0]).cast("double"), *[F.col(c).cast("double") for c in covariates]]
    flat = arms.select(F.col("entry").cast("double").alias("entry"), F.col("time").cast("double").alias("time"), F.col("event").alias("event"), F.col("concordance"), *[c.alias(f"x{j}") for j, c in enumerate(x)])
    stats = flat.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("event").alias("events"), *[F.count_if(F.col("event") & (F.col("concordance") == a)).alias(f"e{k}") for k, a in enumerate(ARMS)],
        *[f(f"x{j}").alias(f"{m}{j}") for j in range(p) for m, f in (("m", F.avg), ("s", F.stddev_pop), ("c", F.count))], F.max("time").alias("last"),
    ).first()
    n, events = stats["n"], stats["events"]
    if events <= p or n <= p + 1 or not stats["e0"] or not stats["e1"]:
        raise Unavailable("too few informative events in both arms")
    if any(stats[f"c{j}"] < n for j in range(p)):
        raise Unavailable("a declared covariate is missing; nothing is imputed")
    mean, scale = np.array([stats[f"m{j}"] for j in range(p)]), np.array([stats[f"s{j}"] for j in range(p)])
    if (scale < 1e-12).any():
        raise Unavailable("a covariate is constant")
    z = flat.select("entry", "time", "event", *[((F.col(f"x{j}") - F.lit(float(mean[j]))) / F.lit(float(scale[j]))).alias(f"z{j}") for j in range(p)])
    z = written(z, "covariates")
    block = quantile_block(z.withColumnRenamed("time", "t"), "t", blocks)
    pairs = [(j, k) for j in range(p) for k in range(j + 1)]

    def likelihood(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = sum((F.col(f"z{j}") * F.lit(float(b)) for j, b in enumerate(beta)), F.lit(0.0))
        rowed = z.withColumn("eta", eta).withColumn("w", F.exp("eta"))
        values = [F.col("w"), *[F.col("w") * F.col(f"z{j}") for j in range(p)], *[F.col("w") * F.col(f"z{j}") * F.col(f"z{k}") for j, k in pairs]]
        names_ = [f"m{i}" for i in range(len(values))]
        on = F.col("event").cast("double")
        come = rowed.select(F.col("entry").alias("t"), *[v.alias(m) for v, m in zip(values, names_)], *[F.lit(0.0).alias(f"o{m}") for m in names_], F.lit(0.0).alias("d"), F.lit(0.0).alias("eta_d"), *[F.lit(0.0).alias(f"zd{j}") for j in range(p)])
        go = rowed.select(F.col("time").alias("t"), *[F.lit(0.0).alias(m) for m in names_], *[v.alias(f"o{m}") for v, m in zip(values, names_)], on.alias("d"), (on * F.col("eta")).alias("eta_d"), *[(on * F.col(f"z{j}")).alias(f"zd{j}") for j in range(p)])
        steps = come.unionAll(go).groupBy("t").agg(*[F.sum(c).alias(c) for c in come.columns if c != "t"]).withColumn("__g", F.lit(1))
        run = running(steps, ["__g"], block, "t", {f"r{m}": m for m in names_} | {f"l{m}": f"o{m}" for m in names_}, inclusive=False).where("d > 0")
        at = {m: F.col(f"r{m}") - F.col(f"l{m}") for m in names_}
        s0, d = at["m0"], F.col("d")
        aggs = [F.sum(F.col("eta_d") - d * F.ln(s0)).alias("value")]
        aggs += [F.sum(F.col(f"zd{j}") - d * at[f"m{j + 1}"] / s0).alias(f"g{j}") for j in range(p)]
        aggs += [F.sum(d * (at[f"m{p + 1 + i}"] / s0 - at[f"m{j + 1}"] * at[f"m{k + 1}"] / (s0 * s0))).alias(f"h{j}_{k}") for i, (j, k) in enumerate(pairs)]
        got = run.agg(*aggs).first()
        info = np.zeros((p, p))
        for j, k in pairs:
            info[j, k] = info[k, j] = got[f"h{j}_{k}"]
        return got["value"], np.array([got[f"g{j}"] for j in range(p)]), info

    beta = np.zeros(p)
    value, gradient, info = likelihood(beta)
    for iteration in range(1, most_iterations + 1):
        inv = inverse(info)
        if inv is None:
            raise Unavailable("singular information or separation")
        step = inv @ gradient
        if not np.isfinite(step).all() or (np.abs(beta) > 20).any():
            raise Unavailable("unstable or separated coefficients")
        if np.abs(step).max() < 1e-7:
            b, se = beta / scale, np.sqrt(np.diag(inv)) / scale
            if not np.isfinite(se).all() or (se <= 0).any():
                raise Unavailable("uncertainty is not finite")
            made = [
                {"name": m, "log_hazard_ratio": float(c), "standard_error": float(s), "hazard_ratio": float(np.exp(c)), "lower": float(np.exp(c - Z95 * s)), "upper": float(np.exp(c + Z95 * s)), "p_value": min(1.0, erfc_value(float(abs(c / s)) / 2**0.5))}
                for m, c, s in zip(names, b, se)
            ]
            return {"patients": n, "events": events, "iterations": iteration, "log_likelihood": value, "coefficients": made}
        factor = 1.0
        while True:
            trial = likelihood(beta + factor * step)
            if trial[0] is not None and np.isfinite(trial[0]) and trial[0] >= value - 1e-10:
                beta, (value, gradient, info) = beta + factor * step, trial
                break
            factor /= 2
            if factor < 1e-8:
                raise Unavailable("the line search failed")
    raise Unavailable("the fit did not converge")
