"""Cohort relations bound to the generic tables, each with the SQL of the same relation.

The generic tables stand in for cohort data so that every operator runs on whole tables: orders are patients with
delayed entry, user-days are classified samples, embeddings are expression profiles, events are variants, conversations
are case findings and customers are cases with three-valued flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.operators.cases import split
from cohortloom.operators.tables import tasks_for

SEED = "42"
CLASSES = ["click", "error", "purchase", "view"]
OUTCOMES = [*CLASSES, "signup"]
BROAD = {"click": "browse", "view": "browse", "purchase": "buy"}
# Orders and their items that one task groups and joins.
TASK_ROWS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in ids], "class_id string")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival observations: one an order. Orders and items are dealt by order into tasks of about `TASK_ROWS`, once for grouping and join."""
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = tasks_for(spark, o.count() + items.count(), TASK_ROWS)
    items = items.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"), F.max(F.col("l_returnflag") == "R").alias("event"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))
    o = o.repartition(n, "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    entry = F.col("o_custkey") % 7
    arm = F.when(F.col("o_orderstatus") == "F", "concordant").when(F.col("o_orderstatus") == "O", "discordant").otherwise("empiric")
    days = F.abs(F.datediff(F.to_date("ship"), F.to_date("o_orderdate")))
    return o.select(
        F.col("o_orderkey").alias("patient_id"), F.col("o_orderpriority").alias("grp"), entry.cast("double").alias("entry"), (entry + 1 + days).cast("double").alias("time"), "event",
        arm.alias("concordance"), (F.lit(0.2) + F.lit(0.6) * (F.col("o_custkey") % 100) / F.lit(100.0)).alias("propensity"), "qty", "disc",
    )


OUTCOMES_SQL = """outcomes AS (SELECT o_orderkey AS patient_id, o_orderpriority AS grp, (o_custkey % 7)::double AS entry,
  (o_custkey % 7 + 1 + abs(date_diff('day', o_orderdate::date, ship::date)))::double AS time, ev AS event,
  CASE o_orderstatus WHEN 'F' THEN 'concordant' WHEN 'O' THEN 'discordant' ELSE 'empiric' END AS concordance,
  0.2::double + 0.6::double * (o_custkey % 100) / 100.0::double AS propensity, qty, disc
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS ship, bool_or(l_returnflag = 'R') AS ev, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, n, first_type, truth): the truth is the type of the user's first event on the next active day."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))
    nxt = F.lead("first_type").over(W.partitionBy("user_id").orderBy("day"))  # days of one user
    return days.withColumn("truth", nxt).where("truth is not null").withColumn("sample_id", F.concat_ws("-", "user_id", "day"))


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, probabilities): shares of each event type of a day, as a prediction of the next active day.

    Both come from one row a user and day that holds its counts by type, so events are read and grouped once for each.
    """
    day = F.to_date("ts").alias("day")
    types = table(spark, sf_dir, "events").groupBy("user_id", day, "event_type").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ts", "event_id")).alias("first"))
    entry = F.struct("event_type", "c")
    days = types.groupBy("user_id", "day").agg(F.sum("c").alias("n"), F.min_by("event_type", "first").alias("first_type"), F.map_from_entries(F.collect_list(entry)).alias("counts"))
    nxt = F.lead("first_type").over(W.partitionBy("user_id").orderBy("day"))  # days of one user
    days = days.withColumn("truth", nxt).where("truth is not null").withColumn("sample_id", F.concat_ws("-", "user_id", "day"))
    days = split(days, SEED, patient="user_id")
    failed = (F.col("user_id") * 31 + F.dayofyear("day")) % 61 == 0
    share = lambda c: F.coalesce(F.try_element_at("counts", c), F.lit(0)) / F.col("n")
    shares = F.array_sort(F.array(*[share(F.lit(c)) for c in OUTCOMES]))
    first, second = F.element_at(shares, -1), F.element_at(shares, -2)
    accepted = ~failed & (first >= 0.75) & (first - second >= 0.15)
    records = days.select("sample_id", F.col("user_id").cast("string").alias("patient_group_id"), "partition", "truth", accepted.alias("accepted"), F.when(failed, "budget_not_run").alias("failure"))
    p = days.where(~failed).select("sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("class_id"), share(F.lit(c)).alias("p")) for c in OUTCOMES])).alias("x"))
    return records, p.select("sample_id", "x.class_id", "x.p")


PREDICTIONS_SQL = """d0 AS (SELECT user_id, ts::date AS day, count(*) AS n, arg_min(event_type, row(ts, event_id)) AS first_type FROM events GROUP BY 1, 2),
days AS (SELECT *, user_id::varchar || '-' || day::varchar AS sample_id,
  CASE WHEN b < 6000 THEN 'development' WHEN b < 8000 THEN 'calibration' ELSE 'test' END AS partition, (user_id * 31 + dayofyear(day)) % 61 = 0 AS failed
  FROM (SELECT *, lead(first_type) OVER (PARTITION BY user_id ORDER BY day) AS truth, cast('0x' || substr(sha256('42' || chr(0) || user_id::varchar), 1, 16) AS ubigint) % 10000 AS b FROM d0) WHERE truth IS NOT NULL),
kinds AS (SELECT unnest(['click', 'error', 'purchase', 'view', 'signup']) AS class_id),
cnt AS (SELECT user_id, ts::date AS day, event_type, count(*) AS c FROM events GROUP BY 1, 2, 3),
probs AS (SELECT sample_id, class_id, coalesce(c, 0) / n AS p FROM days CROSS JOIN kinds LEFT JOIN cnt ON cnt.user_id = days.user_id AND cnt.day = days.day AND event_type = class_id WHERE NOT failed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, class_id) AS rk, p - lead(p) OVER (PARTITION BY sample_id ORDER BY p DESC, class_id) AS margin FROM probs),
top AS (SELECT sample_id, class_id AS predicted, p AS p_top, margin, p >= 0.75 AND margin >= 0.15 AS acc FROM ranked WHERE rk = 1),
each AS (SELECT r.sample_id, sum((p - CASE WHEN class_id = truth THEN 1 ELSE 0 END) ** 2) AS brier, -ln(greatest(max(CASE WHEN class_id = truth THEN p END), 1e-15)) AS log_loss, bool_or(rk <= 3 AND class_id = truth) AS in_top3
  FROM ranked r JOIN days USING (sample_id) GROUP BY 1),
rows_ AS (SELECT days.sample_id, days.user_id::varchar AS patient_group_id, days.partition, days.truth, predicted, p_top, margin, coalesce(acc, false) AS accepted, predicted = truth AS correct, in_top3, brier, log_loss, failed
  FROM days LEFT JOIN top USING (sample_id) LEFT JOIN each USING (sample_id)),
test AS (SELECT * FROM rows_ WHERE partition = 'test')"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, class_id, gene, value, role): expression profiles; a fifth of the samples are queries."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("class_id"), F.posexplode("embedding").alias("gene", "value"))
    return e.select("sample_id", "class_id", F.concat(F.lit("G"), F.col("gene")).alias("gene"), F.col("value").cast("double").alias("value"), F.when(F.col("sample_id") % 5 == 0, "query").otherwise("reference").alias("role"))


PROFILES_SQL = """profiles AS (SELECT vec_id AS sample_id, label::varchar AS class_id, 'G' || (i - 1)::varchar AS gene, embedding[i]::double AS value, CASE WHEN vec_id % 5 = 0 THEN 'query' ELSE 'reference' END AS role
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants from events: the context and the alternate base follow from a hash of the event."""
    e = table(spark, sf_dir, "events").withColumn("h", F.translate(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 4), "0123456789abcdef", "ACGTACGTACGTACGT"))
    return e.select(
        F.col("user_id").alias("sample_id"), F.col("event_type").alias("chromosome"), F.col("event_id").alias("position"), F.substring("h", 2, 1).alias("reference"), F.substring("h", 4, 1).alias("alternate"),
        F.substring("h", 1, 3).alias("context"), (F.col("event_type") != "error").alias("somatic"), F.lit("GRCh38").alias("build"),
    )


VARIANTS_SQL = """v0 AS (SELECT *, translate(substr(sha256(event_id::varchar), 1, 4), '0123456789abcdef', 'ACGTACGTACGTACGT') AS h FROM events),
variants AS (SELECT user_id AS sample_id, event_type AS chromosome, event_id AS position, h[2] AS reference, h[4] AS alternate, substr(h, 1, 3) AS context, event_type <> 'error' AS somatic FROM v0)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case findings from conversations: some names blank, some samples shared, for every rule to have work."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("record"), F.concat(F.lit("case-"), F.col("conv_id").cast("string")).alias("case_id"), F.concat(F.lit("p-"), F.floor(F.col("conv_id") / 3).cast("string")).alias("patient_id"),
        F.when(F.col("conv_id") % 11 == 0, "s-shared").otherwise(F.concat(F.lit("s-"), F.col("conv_id").cast("string"))).alias("sample_id"), F.concat(F.lit("f-"), F.col("turn").cast("string")).alias("finding_id"),
        F.when((F.col("conv_id") * 7 + F.col("turn")) % 29 == 0, "").otherwise(F.col("role")).alias("name"), F.col("role").alias("value"),
    )


FINDINGS_SQL = """findings AS (SELECT conv_id * 1000 + turn AS record, 'case-' || conv_id::varchar AS case_id, 'p-' || (conv_id // 3)::varchar AS patient_id,
  CASE WHEN conv_id % 11 = 0 THEN 's-shared' ELSE 's-' || conv_id::varchar END AS sample_id, 'f-' || turn::varchar AS finding_id,
  CASE WHEN (conv_id * 7 + turn) % 29 = 0 THEN '' ELSE role END AS name, role AS value FROM conversations),
scases AS (SELECT case_id, sample_id, min(record) AS record FROM findings GROUP BY 1, 2),
shared AS (SELECT * FROM scases WHERE sample_id IN (SELECT sample_id FROM scases GROUP BY 1 HAVING count(*) > 1)),
twice AS (SELECT record, case_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, finding_id ORDER BY record) AS rn FROM findings WHERE name <> '') WHERE rn > 1),
many AS (SELECT min(record) AS record, case_id FROM findings GROUP BY case_id HAVING count(*) > 64),
issues AS (SELECT record, case_id, 'missing_name' AS issue FROM findings WHERE name = '' UNION ALL SELECT record, case_id, 'duplicate_finding' FROM twice
  UNION ALL SELECT record, case_id, 'shared_sample' FROM shared UNION ALL SELECT record, case_id, 'too_many_findings' FROM many)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mask, value): share of user-days with a large event of one of the mask's types; the value isn't additive."""
    kinds = F.array(*map(F.lit, sorted(OUTCOMES)))
    e = table(spark, sf_dir, "events").where("value > 20").select("user_id", F.to_date("ts").alias("day"), F.pow(F.lit(2.0), F.array_position(kinds, F.col("event_type")) - 1).cast("long").alias("bit"))
    days = e.groupBy("user_id", "day").agg(F.bit_or("bit").alias("have")).groupBy("have").agg(F.count(F.lit(1)).alias("n"))
    total = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct().agg(F.count(F.lit(1)).alias("total"))
    hit = F.sum(F.when(F.col("mask").bitwiseAND(F.col("have")) != 0, F.col("n")).otherwise(0))
    masks = spark.range(32).select(F.col("id").alias("mask")).crossJoin(F.broadcast(days))  # 32 masks x at most 32 kinds of day
    return masks.groupBy("mask").agg(hit.alias("h")).crossJoin(total).select("mask", (F.col("h") / F.col("total")).alias("value"))


GAMES_SQL = """e AS (SELECT user_id, ts::date AS day, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 WHEN 'view' THEN 16 END AS bit, value FROM events),
have AS (SELECT user_id, day, bit_or(bit) AS have FROM e WHERE value > 20 GROUP BY 1, 2),
tot AS (SELECT count(*) AS total FROM (SELECT DISTINCT user_id, day FROM e)),
masks AS (SELECT unnest(range(32)) AS mask),
game AS (SELECT mask, coalesce((SELECT count(*) FROM have WHERE have & mask <> 0), 0) / (SELECT total FROM tot) AS value FROM masks)"""


def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases: flags that are unknown where a customer has no orders or the key says so."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"), F.max(F.col("o_orderstatus") == "F").alias("has_f"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    maybe = lambda m, value: F.when(k % m != 0, value)
    return c.select(
        k.alias("case_id"), maybe(13, (k % 90).cast("int")).alias("age_years"), F.when(k % 13 == 0, F.lit(89)).alias("age_lower_bound"),
        F.when(k % 5 == 0, "lymphoma").when(k % 5 == 1, "neuroendocrine").otherwise("carcinoma").alias("lineage"), F.when(k % 7 == 0, "unassessed").when(k % 7 == 1, "primary_identified").otherwise("muo").alias("stage"),
        F.when(F.col("n").isNotNull(), F.col("most") > 1000).alias("metastatic"), maybe(17, F.col("c_acctbal") > 0).alias("fit_for_treatment"), maybe(19, F.lit(True)).alias("changes_management"),
        F.lit(True).alias("understands_purpose"), maybe(23, F.lit(True)).alias("understands_risks"), F.lit(True).alias("accepts_treatment"), F.col("has_f").alias("marker"), F.col("n").isNotNull().alias("has_orders"),
        F.when(k % 4 == 0, F.array(F.struct(F.lit("imaging").alias("kind"), F.when(k % 8 == 0, "completed").when(k % 12 == 0, "declined").otherwise("planned").alias("status")))).alias("investigations"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecular features from events: users are samples, types are modalities, values above 20 are observed."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "mutation").when(F.col("event_type") == "view", "copy_number").when(F.col("event_type") == "purchase", "age").otherwise("category")
    return e.select(
        F.col("user_id").cast("string").alias("sample_id"), (F.col("user_id") % 50).cast("string").alias("patient_group_id"), F.when(F.col("user_id") % 9 == 0, "real").otherwise("synthetic").alias("data_class"),
        F.concat(F.lit("e"), k).alias("id"), F.col("event_type").alias("name"), F.col("event_type").alias("modality"), kind.alias("kind"), F.when(F.col("value") > 20, "observed").otherwise("not_tested").alias("status"),
        F.concat(F.lit("g"), k % 4).alias("group"), (k % 5 - 2).cast("double").alias("number"), F.when(k % 3 < 2, k % 3 == 0).alias("somatic"), (k % 2 == 0).alias("is_bound"),
    )


FEATURES_SQL = """features AS (SELECT user_id::varchar AS sample_id, (user_id % 50)::varchar AS patient_group_id, CASE WHEN user_id % 9 = 0 THEN 'real' ELSE 'synthetic' END AS data_class, 'e' || event_id::varchar AS id, event_type AS name, event_type AS modality,
  CASE event_type WHEN 'click' THEN 'mutation' WHEN 'view' THEN 'copy_number' WHEN 'purchase' THEN 'age' ELSE 'category' END AS kind, CASE WHEN value > 20 THEN 'observed' ELSE 'not_tested' END AS status, 'g' || (event_id % 4)::varchar AS grp,
  (event_id % 5 - 2)::double AS number, CASE WHEN event_id % 3 < 2 THEN event_id % 3 = 0 END AS somatic, event_id % 2 = 0 AS is_bound FROM events)"""


def planted_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes with faults of every kind in rows that their numbers name."""
    k = F.col("patient_id")
    rows = outcomes(spark, sf_dir)
    bad = rows.withColumn("entry", F.when(k % 211 == 1, -1.0).when(k % 211 == 2, F.lit(None)).otherwise(F.col("entry"))).withColumn("time", F.when(k % 211 == 3, F.col("entry")).when(k % 211 == 4, F.lit(float("nan"))).otherwise(F.col("time")))
    bad = bad.withColumn("event", F.when(k % 211 != 5, F.col("event"))).withColumn("propensity", F.when(k % 211 == 6, 1.0).when(k % 211 == 7, 0.0).otherwise(F.col("propensity")))
    return bad.withColumn("patient_id", F.when(k % 211 == 8, k - 1).when(k % 211 != 9, k))


PLANTED_OUTCOMES_SQL = OUTCOMES_SQL + """,
planted AS (SELECT CASE WHEN k = 8 THEN patient_id - 1 WHEN k <> 9 THEN patient_id END AS patient_id, CASE WHEN k = 1 THEN -1.0 WHEN k <> 2 THEN entry END AS entry,
  CASE WHEN k = 3 THEN entry WHEN k = 4 THEN 'nan'::double ELSE time END AS time, CASE WHEN k <> 5 THEN event END AS event, CASE WHEN k = 6 THEN 1.0 WHEN k = 7 THEN 0.0 ELSE propensity END AS propensity FROM (SELECT *, patient_id % 211 AS k FROM outcomes))"""


def planted_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The predictions with faults: truths that are no outcome, partitions of no name, vectors out of range, failures with answers."""
    records, p = predictions(spark, sf_dir)
    h = F.conv(F.substring(F.md5("sample_id"), 1, 4), 16, 10).cast("long") % 97
    records = records.withColumn("truth", F.when(h == 1, "nobody").otherwise(F.col("truth"))).withColumn("partition", F.when(h == 2, "holdout").otherwise(F.col("partition")))
    records = records.withColumn("failure", F.when(h == 3, "odd").otherwise(F.col("failure")))
    return records, p.withColumn("p", F.when((h == 4) & (F.col("class_id") == "click"), F.col("p") + 1.5).otherwise(F.col("p"))).where(~((h == 5) & (F.col("class_id") == "view")))


PLANTED_PREDICTIONS_SQL = PREDICTIONS_SQL + """,
hd AS (SELECT *, cast('0x' || substr(md5(sample_id), 1, 4) AS bigint) % 97 AS h FROM days),
prec AS (SELECT sample_id, user_id::varchar AS patient_group_id, CASE WHEN h = 1 THEN 'nobody' ELSE truth END AS truth, CASE WHEN h = 2 THEN 'holdout' ELSE partition END AS partition, failed OR h = 3 AS failed FROM hd),
pprob AS (SELECT p.sample_id, p.class_id, CASE WHEN h = 4 AND class_id = 'click' THEN p + 1.5 ELSE p END AS p FROM probs p JOIN hd USING (sample_id) WHERE NOT (h = 5 AND class_id = 'view')),
pvec AS (SELECT sample_id, count(*) AS n, sum(p) AS total, bool_and(p BETWEEN 0 AND 1) AS ranged FROM pprob GROUP BY 1)"""
