"""Shapley attribution over groups of features, with coalitions as bit masks.

A value table (mask, value) is a memo: each coalition is scored once, whatever asks for it. Exact values join each
coalition with its neighbour by one bit; sampled ones are prefix masks of permutations, forward and reversed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.operators.bootstrap import permutations
from cohortloom.operators.running import quantile_block, running_sums
from cohortloom.operators.tables import written

MOST_EXACT = 16
# Bounds of a sampled run, and the groups that one long holds as exact powers of two of a double.
MOST_SAMPLED, MOST_PAIRS, MOST_EVALUATIONS, MASKED = 512, 10_000, 100_000, 62
MOST_BACKGROUND = 64


def coalitions(spark: SparkSession, groups: int) -> DataFrame:
    """All masks of up to 16 groups."""
    if not 1 <= groups <= MOST_EXACT:
        raise ValueError("exact attribution takes 1 to 16 groups")
    return spark.range(1 << groups).select(F.col("id").alias("mask"))


def plan_size(groups: int, pairs: int | None = None, background: int = 1) -> int:
    """Evaluations that a plan may need at most."""
    return background * ((1 << groups) if pairs is None else 2 * pairs * (groups + 1))


def exact(values: DataFrame, names: list[str]) -> DataFrame:
    """(feature, contribution) from a complete table (mask, value)."""
    n = len(names)
    weight = F.element_at(F.array(*[F.lit(1.0 / (n * comb(n - 1, k))) for k in range(n)]), F.bit_count("mask") + 1)
    bits = F.explode(F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(1 << i).cast("long").alias("bit")) for i, name in enumerate(names)])).alias("b")
    without = values.select("mask", F.col("value").alias("v0"), bits).where(F.col("mask").bitwiseAND(F.col("b.bit")) == 0)
    joined = without.withColumn("to", F.col("mask").bitwiseOR(F.col("b.bit"))).join(values.select(F.col("mask").alias("to"), F.col("value").alias("v1")), "to")
    return joined.groupBy(F.col("b.feature").alias("feature")).agg(F.sum((F.col("v1") - F.col("v0")) * weight).alias("contribution"))


def additivity(values: DataFrame, contributions: DataFrame, groups: int) -> DataFrame:
    """One row: base, full and what the contributions leave unexplained."""
    ends = values.agg(F.max(F.when(F.col("mask") == 0, F.col("value"))).alias("base"), F.max(F.when(F.col("mask") == (1 << groups) - 1, F.col("value"))).alias("full"))
    total = contributions.agg(F.sum("contribution").alias("total"))
    return ends.crossJoin(total).select("base", "full", (F.col("full") - F.col("base") - F.col("total")).alias("residual"))  # one row each


def coalition_key(indexes: Column) -> Column:
    """One name of a set of feature numbers, whatever their number: the numbers in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(indexes), lambda i: i.cast("string")), ",")


def permutation_prefixes(spark: SparkSession, groups: int, pairs: int, seed: int = 42) -> DataFrame:
    """(pair, direction, step, feature_index, before, after) of antithetic permutations of up to 512 groups.

    Coalitions are bit masks for up to 62 groups and names (`coalition_key`) beyond, as a mask is one long.
    """
    if not (1 <= groups <= MOST_SAMPLED and 1 <= pairs <= MOST_PAIRS and plan_size(groups, pairs) <= MOST_EVALUATIONS):
        raise ValueError("sampled attribution takes 1 to 512 groups, 1 to 10,000 pairs and 100,000 evaluations")
    def shuffled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            orders = permutations(seed, batch["id"].to_numpy(), groups)
            for direction, made in ((0, orders), (1, orders[:, ::-1])):
                yield pd.DataFrame({"pair": batch["id"], "direction": np.int32(direction), "order": list(made.astype(np.int32))})

    made = spark.range(pairs).mapInPandas(shuffled, "pair long, direction int, order array<int>")
    each = made.select("pair", "direction", "order", F.posexplode("order").alias("step", "feature_index"))
    if groups > MASKED:
        prefix = lambda n: coalition_key(F.slice("order", F.lit(1), n))
        return each.select("pair", "direction", "step", "feature_index", prefix(F.col("step")).alias("before"), prefix(F.col("step") + 1).alias("after"))
    run = W.partitionBy("pair", "direction").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    bit = F.pow(F.lit(2.0), F.col("feature_index")).cast("long")
    # Every feature is there once, so the sum of its bits is their union.
    after = F.bit_or(bit).over(run)
    return each.select("pair", "direction", "step", "feature_index", after.bitwiseXOR(bit).alias("before"), after.alias("after"))


def sampled(prefixes: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(feature, contribution, standard_error): the mean over pairs of each pair's mean, and its error."""
    v = lambda m, name: values.select(F.col("mask").alias(m), F.col("value").alias(name))
    steps = prefixes.join(v("before", "v0"), "before").join(v("after", "v1"), "after")
    pair = steps.groupBy("pair", "feature_index").agg(F.avg(F.col("v1") - F.col("v0")).alias("c"))
    label = F.element_at(F.array(*map(F.lit, names)), F.col("feature_index") + 1)
    return pair.groupBy("feature_index").agg(F.avg("c").alias("contribution"), (F.stddev_samp("c") / F.sqrt(F.count(F.lit(1)))).alias("standard_error")).select(label.alias("feature"), "contribution", "standard_error")


def mid_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds zero-based ranks, ties at their middle; null values come first.

    What is ordered is each group's distinct values with their counts, in blocks, so a group with a third of all rows is
    not one task's, and neither is a value.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    ordered = counts.withColumn("__v", F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))))
    ordered = written(ordered, "ranked")
    before = running_sums(ordered, by, quantile_block(ordered, "__v"), "__v", {"__before": "__n"}, inclusive=False)
    ranks = before.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*by, value])], (F.col("__before") + (F.col("__n") - 1) / 2).alias("mid_rank"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*by, value])]
    met = on[0]
    for other in on[1:]:
        met = met & other
    return rows.join(ranks, met).select(*rows.columns, "mid_rank")


def ring_order(contributions: DataFrame) -> DataFrame:
    """Adds ring: the place by modality, then feature, in which contributions are set around a ring (modality, feature)."""
    return contributions.withColumn("ring", F.row_number().over(W.orderBy("modality", "feature")))  # at most 512 features


def figure_rows(ranked: DataFrame, selected: str | None = None, shown: int = 10) -> DataFrame:
    """The first rows by position; a selected row further down takes the last place."""
    low = F.col("position") > shown
    if selected is None:
        return ranked.where(~low)
    inside = ranked.where(~low & (F.col("feature") == selected)).limit(1).count() > 0
    known = ranked.where(F.col("feature") == selected).limit(1).count() > 0
    return ranked.where(~low) if inside or not known else ranked.where((F.col("position") < shown) | (F.col("feature") == selected))


def by_magnitude(contributions: DataFrame) -> DataFrame:
    """Adds position by the size of the contribution, then name."""
    return contributions.withColumn("position", F.row_number().over(W.orderBy(F.desc(F.abs("contribution")), "feature")))  # at most 512 features


def stability(left: DataFrame, right: DataFrame, top_k: int = 5) -> DataFrame:
    """One row: RMSE, largest difference, agreement of signs, Spearman of magnitudes and overlap of the first k.

    Attributions have at most 512 features, so their ranks are one plain window.
    """
    size = W.orderBy(F.abs("contribution"))
    ranked = lambda x: x.withColumn("mid_rank", F.rank().over(size) - 1 + (F.count(F.lit(1)).over(W.partitionBy(F.abs("contribution"))) - 1) / 2)
    tiny = lambda c: F.when(F.abs(c) <= 1e-10, 0.0).otherwise(F.signum(c))
    a, b = (ranked(x) for x in (left, right))
    pos = lambda x: by_magnitude(x).select("feature", "position")
    both = a.select("feature", F.col("contribution").alias("x"), F.col("mid_rank").alias("rx")).join(b.select("feature", F.col("contribution").alias("y"), F.col("mid_rank").alias("ry")), "feature", "full_outer")
    both = both.join(pos(left).withColumnRenamed("position", "px"), "feature", "left").join(pos(right).withColumnRenamed("position", "py"), "feature", "left")
    d = F.col("x") - F.col("y")
    constant = (F.stddev_pop("rx") == 0) | (F.stddev_pop("ry") == 0)
    alone = F.count_if(F.col("x").isNull() | F.col("y").isNull())
    refused = F.when(alone > 0, F.raise_error(F.lit("the two attributions are of other features")).cast("double"))
    return both.agg(
        F.coalesce(refused, F.sqrt(F.avg(d * d))).alias("rmse"), F.max(F.abs(d)).alias("largest"), F.avg((tiny(F.col("x")) == tiny(F.col("y"))).cast("double")).alias("sign_agreement"),
        F.when(~constant, F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))).alias("spearman"),
        (F.count_if((F.col("px") <= top_k) & (F.col("py") <= top_k)) / F.lit(float(top_k))).alias("top_k_overlap"),
    )


def hybrids(masks: DataFrame, query: DataFrame, background: DataFrame) -> DataFrame:
    """(mask, background_id, feature_id, bit, value): what a scorer sees of each coalition over each background sample.

    query: (feature_id, bit, value); background: (background_id, feature_id, value), at most MOST_BACKGROUND samples.
    Features of a shown group keep the query's value, the others take the sample's.
    """
    some = background.select("background_id").distinct().limit(MOST_BACKGROUND + 1).count()
    if some > MOST_BACKGROUND:
        raise ValueError(f"more than {MOST_BACKGROUND} background samples")
    each = background.join(query.select("feature_id", "bit", F.col("value").alias("__own")), "feature_id")
    all_masks = F.broadcast(masks.select("mask")) if masks.limit((1 << MOST_EXACT) + 1).count() <= 1 << MOST_EXACT else masks.select("mask")
    shown = F.getbit(F.col("mask"), F.col("bit").cast("int")) == 1
    # Coalitions x background samples x features is what is to be scored, by definition.
    return each.crossJoin(all_masks).select("mask", "background_id", "feature_id", "bit", F.when(shown, F.col("__own")).otherwise(F.col("value")).alias("value"))


def retargeted(distributions: DataFrame, class_id: str) -> DataFrame:
    """(mask, value) of another class from the distributions (mask, probabilities map) that are there; nothing is scored again.

    A coalition whose distribution lacks the class is an error, as its value would be made up.
    """
    p = F.try_element_at("probabilities", F.lit(class_id))
    return distributions.select("mask", F.coalesce(p, F.raise_error(F.lit("a distribution lacks the class")).cast("double")).alias("value"))


def background_values(requests: DataFrame) -> DataFrame:
    """(mask, value): mean over the background samples' hybrids (mask, background_id, value)."""
    return requests.groupBy("mask").agg(F.avg("value").alias("value"))


def linear_scores(visible: DataFrame) -> DataFrame:
    """Deterministic scorer of coalitions from (mask, kind, amount) of the visible features: base plus per-kind shares, clamped.

    Fixed values: 0.12; signature 0.04 x, copy number 0.025 x, mutation 0.035, age 0.015, category 0.01; within 0.01 and 0.85.
    """
    kind, amount = F.col("kind"), F.coalesce("amount", F.lit(0.0))
    share: Column = F.when(kind == "signature", amount * 0.04).when(kind == "copy_number", amount * 0.025).when(kind == "mutation", 0.035).when(kind == "age", 0.015).when(kind == "category", 0.01).otherwise(0.0)
    return visible.groupBy("mask").agg(F.least(F.lit(0.85), F.greatest(F.lit(0.01), F.lit(0.12) + F.sum(share))).alias("value"))


def masked_features(masks: DataFrame, features: DataFrame) -> DataFrame:
    """(mask, features...) of the features each mask shows: features has `bit`, the number of its group; at most 2**16 masks by design."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(F.col("mask"), b) == 1)
    return masks.select("mask", F.explode(bits).alias("bit")).join(features, "bit")
