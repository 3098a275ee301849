"""Scoring with a memo, budgets and resume.

A scorer is any function of a batch of requests; a request is JSON text and its SHA-256 is the key of the memo. Only
distinct requests without an answer are scored, in batches that the budget allows; attempts are appended before a batch
is sent and answers after it, so a run that was cut off knows which requests are uncertain and never sends them twice.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import token_estimate
from cohortloom.operators.tables import written

TOLERANCE = 1e-6
# What a request may hold.
WINDOW_TOKENS = 64_000
STATE_TOKENS = 32_000

POLL_SECONDS = 0.05

Scorer = Callable[[pd.Series], pd.Series]


@dataclass(frozen=True)
class Budget:
    """Limits that a caller states; without seconds a run takes as long as it takes."""

    attempts: int
    tokens: int
    seconds: float | None = None


class Stopped(Exception):
    """A run that ended early, with its reason: cancelled or timeout. What was answered before is in the memo."""


def requests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds request (JSON of the columns, nulls kept) and its key."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return rows.withColumn("request", text).withColumn("request_sha256", F.sha2("request", 256))


def oversized(rows: DataFrame) -> DataFrame:
    """Requests beyond the window; they are refused, never cut."""
    return rows.where(token_estimate(F.col("request")) > WINDOW_TOKENS)


def synthetic_only(rows: DataFrame) -> DataFrame:
    """Raises when read if any row isn't synthetic: nothing else may reach a scorer."""
    return rows.where(F.when(F.col("data_class") == "synthetic", True).otherwise(F.raise_error(F.lit("only synthetic data may be scored")).cast("boolean")))


def plain(text: Column) -> Column:
    """Lower-case words of a text with a blank on each side, whatever parted them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def leaks(requests: DataFrame, secrets: DataFrame, case: str = "case_id") -> DataFrame:
    """(columns of requests but the text, kind, value) of identifiers and labels of its own case that a request spells out.

    requests: (case, ..., request); secrets: (case, kind, value), a bounded list for each case. A value is found as whole
    words, in either case and whatever parts them. One join by case and one pass over each text for all its values.
    """
    own = secrets.where("value is not null").groupBy(F.col(case).alias("__case")).agg(F.collect_set(F.struct("kind", "value", plain(F.col("value")).alias("words"))).alias("__own"))
    text = requests.join(own, F.col(case) == F.col("__case")).withColumn("__text", plain(F.col("request")))
    found = F.filter("__own", lambda s: (s["words"] != "  ") & F.contains(F.col("__text"), s["words"]))
    rest = [c for c in requests.columns if c != "request"]
    return text.select(*rest, F.explode(found).alias("__x")).select(*rest, F.col("__x.kind").alias("kind"), F.col("__x.value").alias("value"))


def without_leaks(requests: DataFrame, secrets: DataFrame, case: str = "case_id") -> DataFrame:
    """The requests; refused with the first leak found, before anything is sent."""
    for found in leaks(requests, secrets, case).limit(1).collect():
        raise ValueError(f"a request of {found[case]} holds its {found['kind']}")
    return requests


def to_score(rows: DataFrame, memo: DataFrame) -> DataFrame:
    """Distinct requests without an answer."""
    return rows.select("request_sha256", "request").dropDuplicates(["request_sha256"]).join(memo, "request_sha256", "left_anti")


def within_budget(todo: DataFrame, budget: Budget) -> tuple[DataFrame, DataFrame]:
    """(to send, left over) in order of key. The budget is a limit that the caller states."""
    from pyspark.sql import Window as W

    order = W.orderBy("request_sha256").rowsBetween(W.unboundedPreceding, 0)
    most = todo.orderBy("request_sha256").limit(budget.attempts)
    sent = most.withColumn("__t", F.sum(token_estimate(F.col("request"))).over(order)).where(F.col("__t") <= budget.tokens).drop("__t")
    return sent, todo.join(sent.select("request_sha256"), "request_sha256", "left_anti")


def score(todo: DataFrame, scorer: Scorer) -> DataFrame:
    """(request_sha256, response) by batches of the scorer."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_sha256": batch["request_sha256"], "response": scorer(batch["request"])})

    return todo.select("request_sha256", "request").mapInPandas(apply, "request_sha256 string, response string")


def uncertain(attempts: DataFrame, memo: DataFrame) -> DataFrame:
    """Requests that were sent and have no answer: a resumed run must not send them again by itself."""
    return attempts.select("request_sha256").distinct().join(memo, "request_sha256", "left_anti")


def uniform(options: DataFrame) -> DataFrame:
    """(request_sha256, class_id, p) with equal shares over the options of each request."""
    n = options.groupBy("request_sha256").agg(F.count(F.lit(1)).alias("n"))
    return options.join(n, "request_sha256").select("request_sha256", "class_id", (F.lit(1.0) / F.col("n")).alias("p"))


def response_problem(classes: Column) -> Column:
    """First thing wrong with a response (model, choice, probabilities map), null if it may be used."""
    p = F.col("probabilities")
    values = F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(
        F.when(F.col("model") != F.col("expected_model"), "wrong_model"),
        F.when(p.isNull(), "no_probabilities"),
        F.when(F.array_sort(F.map_keys(p)) != F.array_sort(classes), "wrong_options"),
        F.when(F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)), "out_of_range"),
        F.when(F.abs(total - 1) > TOLERANCE, "sum_is_not_one"),
        F.when(F.try_element_at(p, F.col("choice")).isNull() | (F.try_element_at(p, F.col("choice")) < F.array_max(values)), "choice_is_not_a_maximum"),
    )


def accounting(attempts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., attempts, tokens): reported tokens, else the bytes that were reserved."""
    return attempts.groupBy(*by).agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.coalesce("tokens", "reserved")).alias("tokens"))


def repeatability(replicates: DataFrame, by: list[str], value: str = "p") -> DataFrame:
    """(by..., n, mean, sd, min, max) over repeated scorings."""
    return replicates.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def masked(features: DataFrame, visible: Column) -> DataFrame:
    """Features in order of id as slots; hidden groups keep nothing but the slot."""
    from pyspark.sql import Window as W

    slot = F.row_number().over(W.partitionBy("sample_id").orderBy("feature_id")) - 1
    shown = F.array_contains(visible, F.col("group"))
    return features.select("sample_id", slot.alias("slot"), F.when(shown, F.col("feature_id")).alias("feature_id"), F.when(shown, F.col("status")).otherwise("withheld").alias("status"), F.when(shown, F.col("value")).alias("value"))


def compatible_background(query: DataFrame, background: DataFrame) -> DataFrame:
    """(sample_id, problem) of background samples that can't stand in for the query: other features, encodings, status or its patient."""
    key = ["feature_id", "encoding", "status", "group"]
    n = query.agg(F.count(F.lit(1)).alias("__q"))
    met = background.join(query.select(*key), key).groupBy("sample_id").agg(F.count(F.lit(1)).alias("met"))
    have = background.groupBy("sample_id").agg(F.count(F.lit(1)).alias("have"), F.first("patient_group_id").alias("patient_group_id"))
    both = have.join(met, "sample_id", "left").crossJoin(F.broadcast(n))  # one row
    differ = both.where((F.coalesce("met", F.lit(0)) != F.col("__q")) | (F.col("have") != F.col("__q"))).select("sample_id", F.lit("different features").alias("problem"))
    same = both.join(query.select("patient_group_id").distinct(), "patient_group_id", "left_semi").select("sample_id", F.lit("patient of the query").alias("problem"))
    return differ.unionByName(same)


def offline(responses: DataFrame, classes: Column) -> DataFrame:
    """Stored responses replayed: checked as live ones are, and marked as unverified."""
    return responses.withColumn("problem", response_problem(classes)).withColumn("verified", F.lit(False))


@contextmanager
def _watched(spark, stop: threading.Event | None, deadline: float | None) -> Iterator[None]:
    """Jobs of the block end when `stop` is set or the deadline passes, and the block then raises Stopped."""
    group, over, why = f"scoring-{uuid.uuid4().hex}", threading.Event(), []
    context = spark.sparkContext

    def watch() -> None:
        while not over.wait(POLL_SECONDS):
            reason = "cancelled" if stop is not None and stop.is_set() else "timeout" if deadline is not None and time.monotonic() >= deadline else None
            if reason:
                why.append(reason)
                while not over.wait(POLL_SECONDS):
                    # Again and again: a job may start after a cancellation.
                    context.cancelJobGroup(group)
                return

    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    context.setJobGroup(group, "scoring", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as error:
        if why:
            raise Stopped(why[0]) from error
        raise
    finally:
        over.set()
        watcher.join()
        for k, v in before.items():
            context.setLocalProperty(k, v)


def _still_going(stop: threading.Event | None, deadline: float | None) -> None:
    if stop is not None and stop.is_set():
        raise Stopped("cancelled")
    if deadline is not None and time.monotonic() >= deadline:
        raise Stopped("timeout")


def run(rows: DataFrame, scorer: Scorer, budget: Budget, memo_path: str, attempts_path: str, resend_uncertain: bool = False, batch: int | None = None, stop: threading.Event | None = None) -> DataFrame:
    """Score what the memo lacks, within the budget, in batches of at most `batch` requests. Returns the memo.

    Before a batch its requests are written as attempts, after it its answers: so a run that ends early keeps every batch
    before, and leaves attempts without answers for the one that it was in. These are not sent again unless the caller asks
    for it, since nobody knows whether the scorer had them. `stop` or the budget's seconds end the jobs of a batch that is
    under way, and the run raises Stopped.
    """
    spark = rows.sparkSession
    deadline = None if budget.seconds is None else time.monotonic() + budget.seconds
    _still_going(stop, deadline)
    memo = _stored(spark, memo_path, "request_sha256 string, response string")
    tried = _stored(spark, attempts_path, "request_sha256 string, reserved long")
    todo = to_score(synthetic_only(rows), memo)
    if not resend_uncertain:
        todo = todo.join(uncertain(tried, memo), "request_sha256", "left_anti")
    sent, _ = within_budget(todo.where(token_estimate(F.col("request")) <= WINDOW_TOKENS), budget)
    sent = written(sent, "requests")
    # Named by what is sent, so that a repeated call of the same batch meets the folder it wrote before.
    keys = sent.agg(F.array_sort(F.collect_list("request_sha256")).alias("k")).first()["k"]  # at most budget.attempts keys
    before = tried.count()
    for first in range(0, len(keys), batch or max(1, len(keys))):
        own = keys[first : first + (batch or len(keys))]
        _still_going(stop, deadline)
        number = f"{before + first}-{hashlib.sha256(''.join(own).encode()).hexdigest()[:32]}"
        with _watched(spark, stop, deadline):
            mine = sent.where(F.col("request_sha256").between(own[0], own[-1]))
            mine.select("request_sha256", F.octet_length("request").cast("long").alias("reserved"), "request").write.parquet(f"{attempts_path}/batch={number}")
            frozen = spark.read.parquet(f"{attempts_path}/batch={number}")
            score(frozen, scorer).write.parquet(f"{memo_path}/batch={number}")
    return _stored(spark, memo_path, "request_sha256 string, response string")


def _stored(spark, path: str, schema: str) -> DataFrame:
    """A table of batches, empty before the first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def paired_arms(rows: DataFrame, case: str = "ordinal") -> DataFrame:
    """Two versions of each case, the first to be scored alternating with the case's parity."""
    order = F.when(F.col(case) % 2 == 0, F.array(F.lit("baseline"), F.lit("candidate"))).otherwise(F.array(F.lit("candidate"), F.lit("baseline")))
    return rows.select("*", F.posexplode(order).alias("turn", "arm"))


def cohort(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Every case stays: those without an answer get the failure budget_not_run."""
    have = answers.select("request_sha256", F.lit(True).alias("__have")).distinct()
    return records.join(have, "request_sha256", "left").withColumn("failure", F.when(F.col("__have").isNull(), "budget_not_run")).drop("__have")


def inventory(features: DataFrame, visible=None) -> DataFrame:
    """(modality, status, n); with `visible` (array of groups), hidden features count as withheld."""
    status = F.col("status") if visible is None else F.when(F.array_contains(visible, F.col("group")), F.col("status")).otherwise("withheld")
    return features.groupBy("modality", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def observed_groups(features: DataFrame) -> DataFrame:
    return features.where("status = 'observed'").select("group").distinct().orderBy("group")
