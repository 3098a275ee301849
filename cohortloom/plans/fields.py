"""Queries of field parsing, lookups, requests and exports over the generic tables, and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.functions import stats, text
from cohortloom.operators import attribution, cases, evaluation, expression, molecular, releases, rules, scoring, spectra, survival, validation, values
from cohortloom.plans.registry import _E, _F, _FT, _G, _P, _km_sql, query, rounded
from cohortloom.operators.tables import shared_dir, written
from cohortloom.sources import bindings as B
from cohortloom.sources import exports, files

# Texts --------------------------------------------------------------------------------------------------------------

# Spellings that follow from an event's number, in SQL that both engines read alike: {k} is the number, {n} its text.
_SPELLED = [
    "{n}", "'-' || {n} || '.5'", "'1e' || CAST({k} % 5 AS STRING)", "'0x1A'", "'NaN'", "{n} || '.'", "'.' || {n}", "' ' || {n} || ' '", "'+' || {n}", "'n/a'", "' NA '", "''", "{n} || 'd'", "'>' || CAST({k} % 120 AS STRING)",
    "'1' || CAST({k} % 90 AS STRING)", "'Pos'", "' not tested '", "'-'", "'2024-02-' || CAST(10 + {k} % 25 AS STRING)", "'2024-2-1'", "'infinity'",
]


def _spelled(k: str) -> str:
    cases_ = [f"WHEN {k} % {len(_SPELLED)} = {i} THEN {t.format(k=k, n=f'CAST({k} AS STRING)')}" for i, t in enumerate(_SPELLED)]
    return f"CASE {' '.join(cases_)} END"


_RAW_SQL = f"raw AS (SELECT event_id, {_spelled('event_id')} AS t FROM events)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "events").select("event_id", F.expr(_spelled("event_id")).alias("t"))


_NUMBER = r"regexp_full_match({0}, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?')"


@query(f"WITH {_RAW_SQL} SELECT event_id, CASE WHEN {_NUMBER.format('t')} THEN try_cast(ltrim(t, '+') AS double) END AS x FROM raw")
def strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("event_id", text.strict_double(F.col("t")).alias("x"))


@query(f"""WITH {_RAW_SQL}, s AS (SELECT event_id, trim(t) AS t FROM raw), n AS (SELECT *, CASE WHEN {_NUMBER.format('t')} THEN try_cast(ltrim(t, '+') AS double) END AS x FROM s),
m AS (SELECT event_id, x, CASE WHEN lower(t) IN ('', 'na', 'n/a', 'null', '.') THEN 'missing' WHEN x IS NOT NULL AND x >= 0 AND x = floor(x) AND x <= 9007199254740991 THEN 'measured' ELSE 'invalid' END AS status FROM n)
SELECT event_id, status, CASE WHEN status = 'measured' THEN round(ln(1 + x) / ln(2), 6) + 0.0 END AS value FROM m""")  # fmt: skip
def measured_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(expression.measured(_raw(spark, sf_dir), "counts", True, "t").select("event_id", "status", "value"))


@query(f"""WITH {_RAW_SQL} SELECT event_id, CASE lower(trim(t)) WHEN 'pos' THEN 'positive' WHEN '-' THEN 'negative' WHEN 'not tested' THEN 'not_tested' END AS category FROM raw""")
def result_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("event_id", text.category(F.col("t")).alias("category"))


@query(f"""WITH {_RAW_SQL} SELECT event_id, CASE WHEN regexp_full_match(t, '\\d{{1,3}}') AND t::int <= 130 THEN t::int END AS years, CASE WHEN regexp_full_match(t, '>\\d{{1,3}}') THEN substr(t, 2)::int END AS bound FROM raw""")
def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = text.age(F.col("t"))
    return _raw(spark, sf_dir).select("event_id", a["years"].alias("years"), a["lower_bound_exclusive"].alias("bound"))


@query(f"WITH {_RAW_SQL} SELECT event_id, CASE WHEN regexp_full_match(t, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(t AS date) END AS day FROM raw")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("event_id", text.strict_date(F.col("t")).alias("day"))


@query("""SELECT conv_id, turn, regexp_full_match(role, '[A-Za-z0-9_-]{1,64}') AS id_ok, regexp_full_match(sha256(text), '[0-9a-f]{64}') AS sha_ok, trim(text) <> '' AND strlen(text) <= 128 AND NOT regexp_matches(text, '[\\x00-\\x1F\\x7F]') AS label_ok, ceil(strlen(text) / 4)::bigint AS tokens FROM conversations""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.is_id(F.col("role")).alias("id_ok"), text.is_sha256(F.sha2("text", 256)).alias("sha_ok"), text.is_label(F.col("text")).alias("label_ok"), text.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH x AS (SELECT DISTINCT l_quantity / 4 AS x, l_linenumber AS df FROM lineitem), t AS (SELECT x, df, x / 2 AS h, 1.0 / (1.0 + 0.3275911 * x) AS t, 1.0 / (1.0 + 0.3275911 * sqrt(x / 2)) AS r FROM x),
e AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x) AS erfc, r * (0.254829592 + r * (-0.284496736 + r * (1.421413741 + r * (-1.453152027 + r * 1.061405429)))) * exp(-h) AS er, 2 * sqrt(h / pi()) * exp(-h) AS g FROM t)
SELECT x, df, round(erfc, 9) + 0.0 AS erfc, round(least(1.0, CASE df WHEN 1 THEN er WHEN 2 THEN exp(-h) WHEN 3 THEN er + g WHEN 4 THEN exp(-h) * (1 + h) WHEN 5 THEN er + g * (1 + h / 1.5) WHEN 6 THEN exp(-h) * (1 + h + h * h / 2) ELSE er + g * (1 + h / 1.5 * (1 + h / 2.5)) END), 9) + 0.0 AS tail FROM e""")  # fmt: skip
def tail_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 4).alias("x"), F.col("l_linenumber").alias("df")).distinct()
    return rounded(x.select("x", "df", stats.erfc(F.col("x")).alias("erfc"), stats.chi_squared_tail_of(F.col("x"), F.col("df")).alias("tail")), 9)


# Genes --------------------------------------------------------------------------------------------------------------

# Parts as genes: approved unless their number says otherwise; three share an alias, some earlier symbols are another's symbol.
_GENES_SQL = """genes AS (SELECT p_partkey AS k, 'HGNC:' || p_partkey AS hgnc_id FROM part WHERE p_partkey % 11 <> 0),
keys AS (SELECT 'hgnc' AS namespace, hgnc_id AS key, hgnc_id AS gene FROM genes UNION SELECT 'ensembl', 'ENSG' || (1000 + k), hgnc_id FROM genes UNION SELECT 'entrez', (5000 + k)::varchar, hgnc_id FROM genes
  UNION SELECT 'symbol', 'p' || k, hgnc_id FROM genes UNION SELECT 'alias', 'al' || (k // 3), hgnc_id FROM genes UNION SELECT 'alias', 'p' || (k + 1), hgnc_id FROM genes WHERE k % 5 = 0)"""


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return B.table(spark, sf_dir, "part").select(
        F.concat(F.lit("HGNC:"), k).alias("hgnc_id"), F.when(k % 11 == 0, "Withdrawn").otherwise("Approved").alias("status"), F.concat(F.lit("ENSG"), k + 1000).alias("ensembl_gene_id"), (k + 5000).cast("string").alias("entrez_id"),
        F.concat(F.lit("P"), k).alias("symbol"), F.concat(F.lit("Al"), F.floor(k / 3)).alias("alias_symbol"), F.when(k % 5 == 0, F.concat(F.lit("P"), k + 1)).alias("prev_symbol"),
    )


@query(f"WITH {_GENES_SQL} SELECT * FROM keys")
def gene_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expression.dictionary(_genes(spark, sf_dir))


@query(f"""WITH {_GENES_SQL}, a AS (SELECT DISTINCT CASE l_partkey % 6 WHEN 0 THEN 'hgnc:' || l_partkey WHEN 1 THEN 'ENSG' || (1000 + l_partkey) || '.2' WHEN 2 THEN (5000 + l_partkey)::varchar WHEN 3 THEN ' P' || l_partkey || ' ' WHEN 4 THEN 'al' || (l_partkey // 3) ELSE 'none' || l_partkey END AS original, l_partkey AS k FROM lineitem),
q AS (SELECT original, CASE k % 6 WHEN 0 THEN 'hgnc' WHEN 1 THEN 'ensembl' WHEN 2 THEN 'entrez' ELSE 'symbol' END AS namespace, CASE k % 6 WHEN 0 THEN 'HGNC:' || k WHEN 1 THEN 'ENSG' || (1000 + k) WHEN 2 THEN (5000 + k)::varchar ELSE lower(trim(original)) END AS key FROM a),
own AS (SELECT original, count(DISTINCT gene) AS n, min(gene) AS g FROM q LEFT JOIN keys USING (namespace, key) GROUP BY 1), al AS (SELECT original, count(DISTINCT gene) AS n, min(gene) AS g FROM q LEFT JOIN keys ON keys.namespace = 'alias' AND q.namespace = 'symbol' AND keys.key = q.key GROUP BY 1)
SELECT original, CASE WHEN c = 1 THEN 'resolved' WHEN c > 1 THEN 'ambiguous' ELSE 'unmapped' END AS status, CASE WHEN c = 1 THEN g END AS gene, c AS candidates FROM (SELECT original, CASE WHEN own.n > 0 THEN own.n ELSE al.n END AS c, CASE WHEN own.n > 0 THEN own.g ELSE al.g END AS g FROM own JOIN al USING (original))""")  # fmt: skip
def gene_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    asked = F.when(k % 6 == 0, F.concat(F.lit("hgnc:"), k)).when(k % 6 == 1, F.concat(F.lit("ENSG"), k + 1000, F.lit(".2"))).when(k % 6 == 2, (k + 5000).cast("string")).when(k % 6 == 3, F.concat(F.lit(" P"), k, F.lit(" "))).when(k % 6 == 4, F.concat(F.lit("al"), F.floor(k / 3))).otherwise(F.concat(F.lit("none"), k))
    ids = B.table(spark, sf_dir, "lineitem").select(asked.alias("original"))
    return expression.resolved(ids, expression.dictionary(_genes(spark, sf_dir))).select("original", "status", "gene", F.size("candidates").cast("long").alias("candidates"))


@query(f"""{_E}, s AS (SELECT DISTINCT sample_id FROM profiles), l AS (SELECT sample_id FROM s WHERE sample_id % 7 <> 0 UNION ALL SELECT sample_id FROM s WHERE sample_id % 10 = 3 AND sample_id % 7 <> 0 UNION ALL SELECT sample_id + 1000000 FROM s WHERE sample_id % 50 = 1)
SELECT sample_id, 'duplicate label' AS problem FROM l GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT sample_id, 'no label' FROM s WHERE sample_id NOT IN (FROM l) UNION ALL SELECT sample_id, 'no sample' FROM l WHERE sample_id NOT IN (FROM s)""")  # fmt: skip
def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.profiles(spark, sf_dir).select("sample_id").distinct()
    kept = s.where("sample_id % 7 <> 0")
    labels = kept.unionAll(kept.where("sample_id % 10 = 3")).unionAll(s.where("sample_id % 50 = 1").select(F.col("sample_id") + 1000000))
    return expression.label_problems(labels, s)


# Cases and rules ----------------------------------------------------------------------------------------------------


@query(f"{_F} SELECT record, case_id, issue FROM issues ORDER BY record, issue, case_id LIMIT 1000")
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: the first thousand issues by record."""
    return cases.shown_issues(cases.issues(B.findings(spark, sf_dir)))


@query("""WITH l AS (SELECT o_custkey AS case_id, o_orderpriority AS rule_id, arg_max(o_orderstatus, o_orderkey) AS action, arg_max(o_orderkey % 3, o_orderkey) AS basis, arg_max(o_orderkey % 2, o_orderkey) AS version FROM orders GROUP BY 1, 2)
SELECT c_custkey AS case_id, p.rule_id, l.action AS review, CASE WHEN l.action IS NOT NULL THEN l.basis = c_custkey % 3 AND l.version = 1 END AS review_current FROM customer CROSS JOIN (SELECT unnest(['1-URGENT', '5-LOW']) AS rule_id) p LEFT JOIN l ON l.case_id = c_custkey AND l.rule_id = p.rule_id""")  # fmt: skip
def review_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders")
    log = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("rule_id"), F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("action"), (F.col("o_orderkey") % 3).cast("string").alias("basis_sha256"), (F.col("o_orderkey") % 2).cast("string").alias("ruleset_version"))
    items = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("rule_id"), (F.col("c_custkey") % 3).cast("string").alias("basis_sha256"))
    return rules.with_reviews(items, log, "1").drop("basis_sha256")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal > 0 END AS fit, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 90 END AS age FROM customer)
SELECT k AS case_id, 'treatment' AS item, CASE WHEN NOT fit THEN 'not_applicable' WHEN fit AND age < 70 THEN 'recorded' WHEN fit AND age >= 70 THEN 'late' ELSE 'insufficient_information' END AS status FROM c UNION ALL SELECT k, 'note', 'information' FROM c""")  # fmt: skip
def context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.context(B.rule_cases(spark, sf_dir), [rules.Item("treatment", "age_years < 70", "fit_for_treatment", "late"), rules.Item("note", always="information")])


@query("""WITH b AS (SELECT n_name AS class_id, CASE WHEN n_nationkey % 6 = 1 THEN 'Other' ELSE 'r' || n_regionkey END AS broad FROM nation WHERE n_nationkey % 7 <> 2 UNION ALL SELECT 'ELSEWHERE', 'r9')
SELECT n_name AS subject, 'class is not an outcome' AS problem FROM nation WHERE n_nationkey % 8 = 3 UNION ALL SELECT n_name, 'class without a broad group' FROM nation WHERE n_nationkey % 7 = 2
UNION ALL SELECT class_id, 'broad group of an unknown class' FROM b WHERE class_id = 'ELSEWHERE' UNION ALL SELECT broad, 'reserved name' FROM b WHERE lower(broad) = 'other'""")  # fmt: skip
def study_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.table(spark, sf_dir, "nation")
    classes, outcomes = n.select(F.col("n_name").alias("class_id")), n.where("n_nationkey % 8 <> 3").select(F.col("n_name").alias("class_id"))
    broad = n.where("n_nationkey % 7 <> 2").select(F.col("n_name").alias("class_id"), F.when(F.col("n_nationkey") % 6 == 1, "Other").otherwise(F.concat(F.lit("r"), "n_regionkey")).alias("broad"))
    return validation.study_problems(classes, outcomes, broad.unionAll(spark.createDataFrame([("ELSEWHERE", "r9")], "class_id string, broad string")))


@query(f"WITH {B.VARIANTS_SQL} SELECT sample_id, chromosome, position, 'reference mismatch' AS problem FROM variants WHERE context[2] <> CASE WHEN position % 10 = 0 THEN 'A' ELSE reference END UNION ALL SELECT sample_id, chromosome, position, 'another build' FROM variants WHERE position % 9 = 0")
def variant_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = B.variants(spark, sf_dir)
    v = v.withColumn("reference", F.when(F.col("position") % 10 == 0, "A").otherwise(F.col("reference"))).withColumn("build", F.when(F.col("position") % 9 == 0, "GRCh37").otherwise(F.col("build")))
    return spectra.variant_problems(v, "GRCh38")


# Requests and exports -----------------------------------------------------------------------------------------------

_RESPONSE_SQL = """r AS (SELECT event_id AS k, event_id % 11 <> 0 AS model_ok, event_id % 13 = 0 AS none, event_id % 17 = 0 AS extra, (event_id % 101) / 100.0 AS p, event_id % 7 = 0 AS short, event_id % 2 = 0 AS says_a, event_id % 19 = 0 AS over FROM events)"""


@query(f"""WITH {_RESPONSE_SQL} SELECT k AS event_id, CASE WHEN NOT model_ok THEN 'wrong_model' WHEN none THEN 'no_probabilities' WHEN extra THEN 'wrong_options' WHEN over THEN 'out_of_range' WHEN short THEN 'sum_is_not_one' WHEN CASE WHEN says_a THEN p < 1 - p ELSE 1 - p < p END THEN 'choice_is_not_a_maximum' END AS problem, false AS verified FROM r""")
def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    p = (k % 101) / F.lit(100.0)
    q = F.when(k % 7 == 0, F.lit(1.0) - p - F.lit(0.001)).otherwise(F.lit(1.0) - p)
    q = F.when(k % 7 == 0, F.greatest(F.lit(0.0), q)).otherwise(q)
    two = F.create_map(F.lit("a"), F.when((k % 7 == 0) & (p == 1), F.lit(0.5)).otherwise(p), F.lit("b"), q)
    three = F.create_map(F.lit("a"), p, F.lit("b"), q, F.lit("c"), F.lit(0.0))
    beyond = F.create_map(F.lit("a"), p + 1.25, F.lit("b"), F.lit(-0.25) - p)
    made = B.table(spark, sf_dir, "events").select("event_id", F.when(k % 11 != 0, "m").otherwise("x").alias("model"), F.lit("m").alias("expected_model"), F.when(k % 13 == 0, None).when(k % 17 == 0, three).when(k % 19 == 0, beyond).otherwise(two).alias("probabilities"), F.when(k % 2 == 0, "a").otherwise("b").alias("choice"))
    return scoring.offline(made, F.array(F.lit("a"), F.lit("b"))).select("event_id", "problem", "verified")


@query("SELECT sha256('{\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS request_sha256 FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) WHERE o_orderstatus <> 'P'")
def requests_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.requests(B.table(spark, sf_dir, "orders").withColumn("data_class", F.lit("synthetic")), ["o_custkey", "o_orderstatus"])
    memo = rows.where("o_orderstatus = 'P'").select("request_sha256").distinct()
    return scoring.to_score(scoring.synthetic_only(rows), memo).select("request_sha256")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'budget_not_run' END AS failure FROM orders")
def unscored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.sha2(F.concat("o_orderkey", F.lit("")), 256).alias("request_sha256"))
    return scoring.cohort(o, o.where("o_orderstatus <> 'F'").select("request_sha256")).select("o_orderkey", "failure")


@query("SELECT c_custkey, turn, CASE WHEN (c_custkey % 2 = 0) = (turn = 0) THEN 'baseline' ELSE 'candidate' END AS arm FROM customer CROSS JOIN (SELECT unnest([0, 1])::int AS turn)")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired_arms(B.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(f"""{_FT} SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY id) - 1)::int AS slot, CASE WHEN grp IN ('g0', 'g2') THEN id END AS feature_id, CASE WHEN grp IN ('g0', 'g2') THEN status ELSE 'withheld' END AS status, CASE WHEN grp IN ('g0', 'g2') THEN number END AS value FROM features""")
def masked_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.features(spark, sf_dir).withColumnRenamed("id", "feature_id").withColumnRenamed("number", "value")
    return scoring.masked(f, F.array(F.lit("g0"), F.lit("g2")))


@query(f'{_FT} SELECT DISTINCT grp AS "group" FROM features WHERE status = \'observed\'')
def observed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.observed_groups(B.features(spark, sf_dir))


_KINDS = ["signature", "copy_number", "mutation", "age", "category"]


@query("""WITH f AS (SELECT event_type, (hash % 5)::int AS bit, avg(value) / 20 AS amount FROM (SELECT event_type, value, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS hash FROM events) GROUP BY 1, 2),
m AS (SELECT unnest(range(1, 32)) AS mask), k AS (SELECT *, (['signature', 'copy_number', 'mutation', 'age', 'category'])[bit + 1] AS kind FROM f)
SELECT mask, round(least(0.85, greatest(0.01, 0.12 + sum(CASE kind WHEN 'signature' THEN amount * 0.04 WHEN 'copy_number' THEN amount * 0.025 WHEN 'mutation' THEN 0.035 WHEN 'age' THEN 0.015 ELSE 0.01 END))), 9) + 0.0 AS value FROM m JOIN k ON (mask >> bit) & 1 = 1 GROUP BY 1""")  # fmt: skip
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as groups, each of its own kind, with the mean of their values as the amount."""
    bit = F.array_position(F.array(*map(F.lit, sorted(B.OUTCOMES))), F.col("event_type")).cast("int") - 1
    f = B.table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") / 20).alias("amount")).select(bit.alias("bit"), F.element_at(F.array(*map(F.lit, _KINDS)), bit + 1).alias("kind"), "amount")
    return rounded(attribution.linear_scores(attribution.masked_features(attribution.coalitions(spark, 5), f)), 9)


_SHARES = f"""{_G}, f AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS feature, unnest([1, 2, 4, 8, 16]) AS bit),
c AS (SELECT feature, sum((b.value - a.value) / (5 * CASE bit_count(a.mask) WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 1 END)) AS contribution FROM game a JOIN f ON a.mask & bit = 0 JOIN game b ON b.mask = a.mask | bit GROUP BY 1)"""


@query(f"{_SHARES} SELECT 'large' AS class_id, feature, round(contribution, 6) + 0.0 AS contribution, round(contribution * 100, 4) + 0.0 AS percentage_points, 0.1::double AS base, 0.9::double AS \"full\" FROM c")
def attribution_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.attributions(attribution.exact(B.games(spark, sf_dir), sorted(B.OUTCOMES)), "large", 0.1, 0.9))


@query(f"{_SHARES} SELECT feature, row_number() OVER (ORDER BY abs(contribution) DESC, feature)::int AS position FROM c QUALIFY position < 3 OR feature = (SELECT feature FROM c ORDER BY abs(contribution), feature DESC LIMIT 1)")
def figure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = attribution.by_magnitude(attribution.exact(B.games(spark, sf_dir), sorted(B.OUTCOMES)))
    # One of the event types: at most five rows.
    (last,) = [r["feature"] for r in ranked.orderBy(F.desc("position")).limit(1).collect()]
    return attribution.figure_rows(ranked, last, 3).select("feature", "position")


@query("""SELECT user_id::varchar AS sample_id, event_id AS record, event_type AS source_column, 'G' || (event_id % 50) AS original, 'resolved' AS mapping_status, 'G' || (event_id % 50) AS gene, value::varchar AS raw_value, 'measured' AS status, round(value, 6) + 0.0 AS value, 'tpm' AS unit, 'G' || (event_id % 50) || '|X' AS candidates, 'ab' AS source_sha256 FROM events""")
def measurement_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, g = B.table(spark, sf_dir, "events"), F.concat(F.lit("G"), F.col("event_id") % 50)
    rows = e.select(F.col("user_id").cast("string").alias("sample_id"), F.col("event_id").alias("record"), F.col("event_type").alias("source_column"), g.alias("original"), F.lit("resolved").alias("mapping"), g.alias("gene"), F.col("value").cast("string").alias("raw"), F.lit("measured").alias("status"), "value", F.array(g, F.lit("X")).alias("candidates"))
    return rounded(exports.measurements(rows, "tpm", "ab"))


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same cases: the predictions, and as a baseline those that hold each class the likelier the rarer it was."""
    records, p = B.predictions(spark, sf_dir)
    return evaluation.scored(records.withColumn("accepted", F.lit(False)), p.withColumn("p", (1 - F.col("p")) / 4)), evaluation.scored(records, p)


_ARMS_SQL = """lows AS (SELECT sample_id, class_id AS low FROM probs QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY p, class_id) = 1),
arms AS (SELECT 'b' AS arm, r.sample_id, patient_group_id, partition, truth, low AS predicted, false AS accepted, failed FROM rows_ r LEFT JOIN lows USING (sample_id) UNION ALL SELECT 'c', sample_id, patient_group_id, partition, truth, predicted, accepted, failed FROM rows_)"""


@query(f"""{_P}, {_ARMS_SQL}, top AS (SELECT arm, partition, count(*) AS eligible, count(*) FILTER (predicted = truth) / count(*) AS top1, count(*) FILTER (accepted) / count(*) AS coverage FROM arms GROUP BY 1, 2),
cl AS (SELECT arm, partition, class_id, count(*) FILTER (truth = class_id) AS s, count(*) FILTER (predicted = class_id) AS c, count(*) FILTER (truth = class_id AND predicted = class_id) AS h FROM arms CROSS JOIN kinds GROUP BY 1, 2, 3),
ma AS (SELECT arm, partition, avg(coalesce(2.0 * h / nullif(s + c, 0), 0)) AS macro FROM cl WHERE class_id <> 'signup' OR s > 0 GROUP BY 1, 2), al AS (SELECT * FROM top JOIN ma USING (arm, partition))
SELECT partition, b.eligible, round(c.top1 - b.top1, 6) + 0.0 AS delta_top1, round(c.coverage - b.coverage, 6) + 0.0 AS delta_coverage, round(c.macro - b.macro, 6) + 0.0 AS delta_macro_f1 FROM (SELECT * FROM al WHERE arm = 'b') b JOIN (SELECT * FROM al WHERE arm = 'c') c USING (partition)""".replace("top AS (SELECT arm", "tops AS (SELECT arm").replace("FROM top JOIN ma", "FROM tops JOIN ma"))  # fmt: skip
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.paired_report(*_arms(spark, sf_dir), B.named(spark, B.CLASSES), B.named(spark, B.OUTCOMES)))


@query(f"""{_P}, {_ARMS_SQL} SELECT sample_id, b.patient_group_id, b.partition, b.truth, b.predicted AS baseline_top, CASE WHEN b.failed THEN 'budget_not_run' END AS baseline_failure, b.accepted AS baseline_accepted,
  c.predicted AS candidate_top, CASE WHEN c.failed THEN 'budget_not_run' END AS candidate_failure, c.accepted AS candidate_accepted,
  CASE WHEN coalesce(c.predicted = c.truth, false) AND NOT coalesce(b.predicted = b.truth, false) THEN 'gained' WHEN coalesce(b.predicted = b.truth, false) AND NOT coalesce(c.predicted = c.truth, false) THEN 'lost' ELSE 'same' END AS change
FROM (SELECT * FROM arms WHERE arm = 'b') b JOIN (SELECT * FROM arms WHERE arm = 'c') c USING (sample_id)""")  # fmt: skip
def paired_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.paired_cases(*_arms(spark, sf_dir))


@query(f"WITH km AS ({_km_sql('grp', B.OUTCOMES_SQL)}), st AS (SELECT grp, t, coalesce(lag(survival) OVER (PARTITION BY grp ORDER BY t), 1.0) AS s0, survival AS s1 FROM km) SELECT grp, t, 0 AS corner, s0 AS survival FROM st UNION ALL SELECT grp, t, 1, s1 FROM st")
def curve_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(survival.step_points(survival.kaplan_meier(B.outcomes(spark, sf_dir), ["grp"]), ["grp"]))


@query(f"""{_FT} SELECT sample_id, id, CASE WHEN kind = 'copy_number' THEN number WHEN kind = 'age' AND NOT is_bound THEN number END AS x, CASE kind WHEN 'copy_number' THEN name || ' CNA ' || CASE WHEN number < 0 THEN '' ELSE '+' END || number::int WHEN 'age' THEN CASE WHEN is_bound THEN '>' ELSE '' END || number::int || ' years' ELSE name END AS shown,
CASE WHEN kind IN ('mutation', 'copy_number') THEN '["' || kind || '","' || name || '"]' ELSE '["' || kind || '"]' END AS encoding FROM features""")  # fmt: skip
def feature_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return B.features(spark, sf_dir).select(
        "sample_id", "id", molecular.numeric_view(c("kind"), c("number"), c("is_bound")).alias("x"), molecular.displayed(c("kind"), c("number"), F.lit("u"), c("name"), c("is_bound")).alias("shown"), molecular.encoding(c("kind"), F.lit("u"), c("name")).alias("encoding"),
    )


@query(f"""{_P}, w AS (SELECT sample_id, CASE WHEN truth IN ('click', 'view') THEN 'browse' WHEN truth = 'purchase' THEN 'buy' ELSE truth END AS truth, accepted, failed FROM test),
bp AS (SELECT sample_id, CASE WHEN class_id IN ('click', 'view') THEN 'browse' WHEN class_id = 'purchase' THEN 'buy' ELSE class_id END AS class_id, round(sum(p), 9) AS p FROM probs GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC, class_id) AS rk FROM bp), t1 AS (SELECT sample_id, class_id AS predicted FROM br WHERE rk = 1), t3 AS (SELECT DISTINCT sample_id, class_id AS truth, true AS hit FROM br WHERE rk <= 3)
SELECT count(*) AS eligible, count(*) FILTER (predicted IS NULL) AS failed, round(count(*) FILTER (predicted = truth) / count(*), 6) + 0.0 AS top1, round(count(*) FILTER (hit) / count(*), 6) + 0.0 AS top3 FROM w LEFT JOIN t1 USING (sample_id) LEFT JOIN t3 USING (sample_id, truth)""")  # fmt: skip
def broad_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, p = B.predictions(spark, sf_dir)
    groups = spark.createDataFrame(list(B.BROAD.items()), "class_id string, broad string")
    r, q = evaluation.relabelled(records.where("partition = 'test'"), p, groups)
    return rounded(evaluation.summary(evaluation.scored(r, q.withColumn("p", F.round("p", 9)))).select("eligible", "failed", "top1", "top3"))


# Files that Spark writes from the tables and reads again -------------------------------------------------------------


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query("""SELECT 'case-' || conv_id AS case_id, 'f-' || turn AS finding_id, role AS name, sha256(role || chr(10) || '"' || chr(10) || chr(10) || replace(coalesce(text, ''), chr(13), '') || ', end') AS value_sha256, false AS malformed FROM conversations""")
def quoted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as findings whose cells hold quotes, commas and line breaks, and read again in splits."""
    path = _folder(spark, "findings")
    value = F.concat("role", F.lit('\n"\n\n'), F.regexp_replace(F.coalesce("text", F.lit("")), "\r", ""), F.lit(", end"))
    rows = B.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("case-"), "conv_id").alias("case_id"), F.lit("synthetic").alias("data_class"), F.concat(F.lit("f-"), "turn").alias("finding_id"), F.lit("symptom").alias("kind"), F.col("role").alias("name"), value.alias("value"),
    )
    rows.write.option("header", True).option("escape", '"').option("quote", '"').csv(path)
    return files.findings(spark, path).select("case_id", "finding_id", "name", F.sha2("value", 256).alias("value_sha256"), "malformed")


_CONTIGS_SQL = """WITH l AS (SELECT event_id, event_id // 1000 AS c, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS position, translate(substr(sha256(event_id::varchar), 2, 1), '0123456789abcdef', 'ACGTACGTACGTACGT') AS base FROM events),
n AS (SELECT *, lag(base) OVER w AS a, lead(base) OVER w AS b, event_id % 97 = 0 AS lost FROM l WINDOW w AS (PARTITION BY c ORDER BY position))"""


@query(f"""{_CONTIGS_SQL} SELECT CASE WHEN lost THEN 'elsewhere' ELSE 'c' || c END AS chromosome, position, CASE WHEN NOT lost THEN a || base || b END AS context, CASE WHEN lost THEN 'not in the index' WHEN a IS NULL OR b IS NULL THEN 'lacks complete context' END AS problem FROM n GROUP BY ALL""")
def indexed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base an event, a contig a thousand numbers: written as FASTA, indexed, and read by place for every event."""
    path, k = _folder(spark, "contigs"), F.col("event_id")
    base = F.translate(F.substring(F.sha2(k.cast("string"), 256), 2, 1), "0123456789abcdef", "ACGTACGTACGTACGT")
    letters = B.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("c"), F.floor(k / 1000)).alias("chromosome"), base.alias("base"))
    # At most a thousand bases a contig.
    contigs = letters.groupBy("chromosome").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "base"))), lambda x: x["base"]), "").alias("s"))
    lines = contigs.select(F.concat(F.lit(">"), "chromosome", F.lit("\n"), F.regexp_replace(F.lower("s"), "(.{60})(?=.)", "$1\n")).alias("value"))
    lines.write.text(path)
    asked = letters.withColumn("position", F.row_number().over(W.partitionBy("chromosome").orderBy("event_id")).cast("long"))
    asked = asked.select(F.when(F.col("event_id") % 97 == 0, "elsewhere").otherwise(F.col("chromosome")).alias("chromosome"), "position")
    return files.indexed_contexts(asked, written(files.index_of(spark, path), "index"))


# Values, archives and leaks -----------------------------------------------------------------------------------------

_MODES = ["mutation", "copy_number", "signature", "demographic", "expression", "ihc", "histology"]


@query("""WITH e AS (SELECT event_id AS k, (['number', 'category', 'mutation', 'copy_number', 'signature', 'vector', 'age'])[event_id % 7 + 1] AS kind, (['mutation', 'copy_number', 'signature', 'demographic', 'expression', 'ihc', 'histology'])[(event_id // 7) % 7 + 1] AS mode, event_id // 49 AS r FROM events),
v AS (SELECT *, CASE WHEN r % 5 = 0 THEN 'nan'::double ELSE (r % 9 - 2) / 2.0 END AS number, CASE WHEN r % 11 = 0 THEN ' ' WHEN r % 3 = 0 THEN 'fraction' ELSE 'u' END AS units, CASE WHEN r % 6 = 0 THEN 'a b' ELSE 'G-' || r END AS gene, r % 4 AS position, CASE WHEN r % 8 = 0 THEN 'N' ELSE 'AC' END AS ref, CASE WHEN r % 10 = 0 THEN 'AC' ELSE 'T' END AS alt,
  r % 7 - 3 AS call, CASE WHEN r % 4 = 0 THEN 'DBS1' ELSE 'SBS1' END AS sig, r % 140 AS years, r % 5 AS size, CASE WHEN r % 9 = 0 THEN 'x' ELSE sha256(k::varchar) END AS sha, k % 13 <> 0 AS observed, k % 17 <> 0 AS there FROM e),
f AS (SELECT *, CASE kind WHEN 'number' THEN mode IN ('expression', 'ihc', 'copy_number', 'mutation') WHEN 'category' THEN mode IN ('ihc', 'histology', 'demographic') WHEN 'vector' THEN mode IN ('expression', 'signature') WHEN 'age' THEN mode = 'demographic' ELSE mode = kind END AS fit,
  CASE kind WHEN 'number' THEN r % 5 <> 0 AND r % 11 <> 0 AND (mode <> 'mutation' OR (number >= 0 AND number = floor(number))) WHEN 'category' THEN r % 11 <> 0 WHEN 'mutation' THEN r % 6 <> 0 AND position > 0 AND ref <> alt AND ref <> 'N' WHEN 'copy_number' THEN r % 6 <> 0 AND abs(call) <= 2
    WHEN 'signature' THEN sig = 'SBS1' AND r % 5 <> 0 AND number >= 0 AND r % 11 <> 0 AND position > 0 AND (units <> 'fraction' OR number <= 1) WHEN 'vector' THEN size > 0 AND r % 11 <> 0 AND r % 9 <> 0 AND r % 6 <> 0 AND r % 5 <> 0 ELSE years <= 120 END AS ok FROM v),
p AS (SELECT k AS event_id, CASE WHEN observed AND NOT there THEN 'observed without a value' WHEN NOT observed AND there THEN 'a value that was not observed' WHEN there AND NOT fit THEN 'kind does not fit the modality' WHEN there AND NOT ok THEN 'out of bounds' END AS problem FROM f)
SELECT * FROM p WHERE problem IS NOT NULL""")  # fmt: skip
def value_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as features of all kinds in all modalities, with faults in every field that the event's number names."""
    k, r = F.col("event_id"), F.floor(F.col("event_id") / 49)
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    number = F.when(r % 5 == 0, float("nan")).otherwise((r % 9 - 2) / 2.0)
    text = F.when(r % 11 == 0, " ").when(r % 3 == 0, "fraction").otherwise("u")
    name = F.when(r % 6 == 0, "a b").otherwise(F.concat(F.lit("G-"), r))
    entries = F.when(r % 5 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(name, number))
    value = values.tagged(
        at(list(values.FITS), k), number=number, units=text, text=text, gene=name, chromosome=F.lit("1"), position=r % 4, reference=F.when(r % 8 == 0, "N").otherwise("AC"), alternate=F.when(r % 10 == 0, "AC").otherwise("T"), consequence=F.lit("missense"),
        call=r % 7 - 3, signature=F.when(r % 4 == 0, "DBS1").otherwise("SBS1"), catalogue=F.lit("c"), method=F.lit("m"), mutation_count=r % 4, entries=entries, reference_sha256=F.when(r % 9 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)),
        years=r % 140, is_bound=F.lit(False),
    )
    rows = B.table(spark, sf_dir, "events").select("event_id", at(_MODES, F.floor(k / 7)).alias("modality"), F.when(k % 13 != 0, "observed").otherwise("not_tested").alias("status"), F.when(k % 17 != 0, value).alias("value"))
    return values.problems(rows, ["event_id"])


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN (conv_id + turn) % 9 = 0 THEN ' see Case/' || conv_id || '.' ELSE '' END || CASE WHEN (conv_id * 3 + turn) % 11 = 0 THEN ' (P ' || (conv_id // 3) || ')' ELSE '' END || CASE WHEN turn % 4 = 3 THEN ' TYPE  ' || (conv_id % 5) || '!' ELSE '' END AS request FROM conversations),
n AS (SELECT *, ' ' || trim(regexp_replace(lower(request), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM c), s AS (SELECT conv_id, turn, t, unnest(['case', 'patient', 'truth']) AS kind, unnest(['case-' || conv_id, 'p-' || (conv_id // 3), 'Type ' || (conv_id % 5)]) AS value FROM n)
SELECT conv_id, turn, kind, value FROM s WHERE contains(t, ' ' || regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g') || ' ')""")  # fmt: skip
def request_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests, some of which spell out their own case, patient or class in another way of writing."""
    c, t, said = F.col("conv_id"), F.col("turn"), lambda when, x: F.when(when, x).otherwise("")
    rows = B.table(spark, sf_dir, "conversations")
    asked = rows.select("conv_id", "turn", F.concat(
        F.coalesce("text", F.lit("")), said((c + t) % 9 == 0, F.concat(F.lit(" see Case/"), c, F.lit("."))), said((c * 3 + t) % 11 == 0, F.concat(F.lit(" (P "), F.floor(c / 3), F.lit(")"))), said(t % 4 == 3, F.concat(F.lit(" TYPE  "), c % 5, F.lit("!"))),
    ).alias("request"))
    kinds = {"case": F.concat(F.lit("case-"), c), "patient": F.concat(F.lit("p-"), F.floor(c / 3)), "truth": F.concat(F.lit("Type "), c % 5)}
    secrets = rows.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("x")).select("conv_id", "x.*")
    return scoring.leaks(asked, secrets, "conv_id")


# Reference releases --------------------------------------------------------------------------------------------------

_RELEASE_SQL = B.PROFILES_SQL + """,
ids AS (SELECT vec_id AS sample_id, 'g' || (vec_id // 2) AS g, label::varchar AS class_id FROM embeddings),
samples AS (SELECT sample_id, CASE WHEN sample_id % 5 <> 0 THEN g END AS patient_group_id, CASE WHEN sample_id % 97 = 0 THEN 'research' ELSE 'synthetic' END AS data_class, CASE WHEN sample_id % 41 = 0 THEN 'blocked' WHEN sample_id % 43 <> 0 THEN 'pass' END AS qc FROM ids),
lab0 AS (SELECT sample_id, CASE WHEN sample_id % 59 = 0 THEN 'other' ELSE g END AS patient_group_id, class_id, CASE WHEN sample_id % 61 = 0 THEN 'N' ELSE 'n' END || class_id AS cancer_type FROM ids WHERE sample_id % 47 <> 0),
labels_ AS (SELECT * FROM lab0 UNION ALL SELECT * FROM lab0 WHERE sample_id % 53 = 0 UNION ALL SELECT 1000000 + sample_id, patient_group_id, class_id, 'n' || class_id FROM lab0 WHERE sample_id % 83 = 0),
recs AS (SELECT sample_id, CASE WHEN sample_id % 67 = 0 AND gene = 'G4' THEN 'G5' ELSE gene END AS gene, CASE WHEN sample_id % 71 = 0 AND gene = 'G6' THEN 'inf'::double ELSE value END AS value FROM profiles)"""


def _release(spark: SparkSession, sf_dir: str, faults: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, labels, records) of the profiles, with planted faults of every kind or with none."""
    s, g = F.col("sample_id"), F.concat(F.lit("g"), F.floor(F.col("sample_id") / 2))
    odd = lambda k: (s % k == 0) & F.lit(faults)
    ids = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("class_id"))
    samples = ids.select("sample_id", F.when(s % 5 != 0, g).alias("patient_group_id"), F.when(odd(97), "research").otherwise("synthetic").alias("data_class"), F.when(odd(41), "blocked").when(~odd(43), "pass").alias("qc"), F.sha2(s.cast("string"), 256).alias("measurement_sha256"))
    labels = ids.where(~odd(47)).select("sample_id", F.when(odd(59), "other").otherwise(g).alias("patient_group_id"), "class_id", F.concat(F.when(odd(61), "N").otherwise("n"), "class_id").alias("cancer_type"))
    labels = labels.unionByName(labels.where(odd(53))).unionByName(labels.where(odd(83)).withColumn("cancer_type", F.concat(F.lit("n"), "class_id")).withColumn("sample_id", s + 1_000_000))
    records = B.profiles(spark, sf_dir).select("sample_id", F.when(odd(67) & (F.col("gene") == "G4"), "G5").otherwise(F.col("gene")).alias("gene"), F.when(odd(71) & (F.col("gene") == "G6"), float("inf")).otherwise(F.col("value")).alias("value"))
    return samples, labels, records


@query(f"""WITH {_RELEASE_SQL} SELECT sample_id::varchar AS subject, 'duplicate label' AS problem FROM labels_ GROUP BY sample_id HAVING count(*) > 1 UNION ALL SELECT sample_id::varchar, 'no label' FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM labels_)
UNION ALL SELECT sample_id::varchar, 'no sample' FROM labels_ WHERE sample_id NOT IN (SELECT sample_id FROM samples) UNION ALL SELECT sample_id::varchar, 'blocked or absent quality control' FROM samples WHERE qc IS NULL OR qc = 'blocked'
UNION ALL SELECT DISTINCT s.sample_id::varchar, 'patient group conflicts with the sample' FROM samples s JOIN labels_ l USING (sample_id) WHERE s.patient_group_id <> l.patient_group_id
UNION ALL SELECT class_id, 'class has conflicting names' FROM labels_ GROUP BY 1 HAVING count(DISTINCT cancer_type) > 1 UNION ALL SELECT 'release', 'synthetic and research samples together' FROM samples HAVING count(DISTINCT data_class) > 1
UNION ALL SELECT DISTINCT sample_id::varchar, CASE WHEN n > 1 THEN 'duplicate canonical gene' ELSE 'value is not finite' END FROM (SELECT sample_id, gene, count(*) AS n, max(value) AS v FROM recs GROUP BY 1, 2) WHERE n > 1 OR isinf(v)""")  # fmt: skip
def release_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.problems(*_release(spark, sf_dir, True))


@query(f"""WITH {B.PROFILES_SQL}, m AS (SELECT class_id, gene, avg(value) AS mean, count(*) AS members FROM profiles GROUP BY 1, 2)
SELECT class_id, 'n' || class_id AS cancer_type, (SELECT count(*) FROM embeddings WHERE label::varchar = class_id) AS samples, count(*) AS genes, round(sum(mean), 6) + 0.0 AS total, min(members) AS members FROM m GROUP BY 1""")
def release_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release of all profiles: each class with its samples, and its centroid summed up."""
    made = releases.release(*_release(spark, sf_dir, False))
    sums = made["centroids"].groupBy("class_id").agg(F.count(F.lit(1)).alias("genes"), F.sum("mean").alias("total"), F.min("members").alias("members"))
    return rounded(made["classes"].join(sums, "class_id").select("class_id", "cancer_type", "samples", "genes", "total", "members"))


# Clinical contexts ---------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k FROM customer), p AS (
  SELECT k, 'assertions without an assessment' AS problem FROM c WHERE k % 7 = 0 AND k % 14 <> 0 UNION ALL SELECT k, 'invalid assessment' FROM c WHERE k % 7 <> 0 AND (k % 11 = 0 OR k % 13 = 0) UNION ALL SELECT k, 'performance status out of range' FROM c WHERE k % 14 <> 0 AND k % 6 = 5
  UNION ALL SELECT k, 'too many entries' FROM c WHERE k % 14 <> 0 AND k % 101 = 0 UNION ALL SELECT k, 'investigation recorded twice' FROM c WHERE k % 14 <> 0 AND (k % 17 = 0 OR k % 101 = 0)
  UNION ALL SELECT k, 'invalid investigation' FROM c WHERE k % 14 <> 0 AND k % 101 <> 0 AND (k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0) UNION ALL SELECT k, 'invalid ldh' FROM c WHERE k % 14 <> 0 AND k % 2 = 0 AND (k % 31 = 0 OR k % 37 = 0) UNION ALL SELECT k, 'invalid review' FROM c WHERE k % 41 = 0 OR k % 43 = 0)
SELECT k::varchar AS subject, problem FROM p""")  # fmt: skip
def clinical_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clinical contexts, empty ones among them, with faults of every kind in rows that their numbers name."""
    k = F.col("c_custkey")
    full = lambda value: F.when(k % 14 != 0, value)
    assessment = F.struct(F.when(k % 13 == 0, "bad id").otherwise("r-1").alias("reviewer_id"), F.when(k % 11 == 0, "2023-02-29").otherwise("2024-02-29").alias("recorded_on"), F.lit("notes").alias("source"))
    first = F.struct(
        F.lit("imaging").alias("kind"), F.when(k % 19 == 0, "declined").otherwise("completed").alias("status"), F.when(k % 29 == 0, " ").otherwise("letter").alias("source"), F.when(k % 23 == 0, 40_000).otherwise(-3).alias("day"),
        F.lit("clear").alias("result"), F.lit(None).cast("string").alias("reason"),
    )
    second = F.struct(F.when(k % 17 == 0, "imaging").otherwise("biopsy").alias("kind"), F.lit("planned").alias("status"), F.lit("letter").alias("source"), F.lit(None).cast("int").alias("day"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("reason"))
    ldh = F.struct(F.when(k % 31 == 0, -1.0).otherwise(2.0).alias("value"), F.when(k % 37 == 0, "").otherwise("u/l").alias("units"), F.lit("lab").alias("source"), F.lit(0).alias("day"))
    whole = F.struct(F.lit("r-1").alias("reviewer_id"), F.lit("2024-02-29").alias("recorded_on"), F.lit("notes").alias("source"))
    review = F.struct(F.lit("rule").alias("rule_id"), F.lit("v1").alias("ruleset_version"), F.when(k % 41 == 0, None).otherwise("seen").alias("reason"), F.when(k % 43 == 0, "zz").otherwise(F.sha2(k.cast("string"), 256)).alias("basis_sha256"), whole.alias("assessment"))
    rows = B.table(spark, sf_dir, "customer").select(
        k.alias("case_id"), F.when(k % 7 != 0, assessment).alias("assessment"), full(F.lit("muo")).alias("stage"), F.lit("unknown").alias("lineage"), F.lit(None).cast("map<string,boolean>").alias("features"),
        full(F.when(k % 101 == 0, F.array_repeat(second, 33)).otherwise(F.array(first, second))).alias("investigations"), full((k % 6).cast("int")).alias("ecog"), full(F.when(k % 2 == 0, ldh)).alias("ldh"), F.lit(None).cast("struct<value:double,units:string,source:string,day:int>").alias("albumin"), F.array(review).alias("reviews"),
    )
    return validation.clinical_problems(rows)

