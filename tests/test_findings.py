"""Queries against their SQL on tables of a few odd rows, and the sizes of their tasks."""

import duckdb
from pyspark.sql import functions as F

from cohortloom.operators import expression, survival
from cohortloom.plans import fields, registry  # noqa: F401  the queries of `fields` register themselves
from cohortloom.sources import bindings

SMALLEST = "/root/testdata/sf0.001"


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the tables, sorted."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(folder))
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    return sorted(map(repr, map(tuple, got.select(names).collect()))), sorted(map(repr, want.fetchall()))


def test_rules_of_customers_without_orders(spark, tmp_path):
    """Keys of every remainder by 3, with orders, with orders of unknown price, and without any."""
    customers = spark.range(1, 200).selectExpr("id AS c_custkey", "CAST(id % 5 - 2 AS DOUBLE) AS c_acctbal")
    orders = spark.range(1, 200).where("id % 4 <> 0").selectExpr("id AS o_orderkey", "id AS o_custkey", "CASE id % 3 WHEN 0 THEN 'F' ELSE 'O' END AS o_orderstatus", "CASE WHEN id % 7 <> 3 THEN CAST(id * 20 AS DOUBLE) END AS o_totalprice")
    got, want = against_sql(spark, tmp_path, "rule_status", customer=customers, orders=orders)
    assert got == want and len(got) == 5 * 199


def largest_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_orders_are_dealt_by_their_number(spark, monkeypatch):
    """More rows make more tasks and no larger ones, whatever number of partitions a shuffle has."""
    orders = spark.read.parquet(f"{SMALLEST}/orders.parquet").count()
    rows = orders + spark.read.parquet(f"{SMALLEST}/lineitem.parquet").count()
    monkeypatch.setattr(bindings, "TASK_ROWS", rows // 50, raising=False)
    monkeypatch.setattr(survival, "TASK_PATIENTS", orders // 50, raising=False)
    assert largest_task(bindings.outcomes(spark, SMALLEST)) < 2.5 * orders / 50


def test_outcome_problems_in_small_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bindings, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(survival, "TASK_PATIENTS", 50, raising=False)
    tables = {t: spark.read.parquet(f"{SMALLEST}/{t}.parquet") for t in ("orders", "lineitem")}
    got, want = against_sql(spark, tmp_path, "outcome_problems", **tables)
    assert got == want and sum("duplicate" in x and "None" in x for x in got) == 1


def test_ids_that_are_absent_once_or_twice(spark):
    schema = "patient_id long, entry double, time double, event boolean, propensity double"
    ok = (0.0, 1.0, True, 0.5)
    found = lambda ids: sorted(map(tuple, survival.problems(spark.createDataFrame([(i, *ok) for i in ids], schema)).collect()), key=repr)
    assert found([1, 2]) == [] and found([1, None]) == [(None, "missing patient")] and found([]) == []
    assert found([1, 1, None, None]) == [(1, "duplicate patient"), (None, "duplicate patient"), (None, "missing patient"), (None, "missing patient")]


def test_genes_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    parts = spark.read.parquet(f"{SMALLEST}/part.parquet")
    monkeypatch.setattr(expression, "TASK_GENES", parts.count() // 25, raising=False)
    got, want = against_sql(spark, tmp_path, "gene_keys", part=parts)
    assert got == want
    assert largest_task(registry.queries()["gene_keys"](spark, str(tmp_path))) < 3 * len(want) / 25


def test_keys_of_a_gene_in_several_rows_are_there_once(spark):
    schema = "hgnc_id string, status string, ensembl_gene_id string, entrez_id string, symbol string, alias_symbol string, prev_symbol string"
    rows = [("HGNC:1", "Approved", None, "7", "A", "b|B", None)] * 2 + [("HGNC:1", "Approved", "E", "7", "A", "c", "b"), ("HGNC:2", "Approved", None, None, "A", "b", None)]
    got = sorted(map(tuple, expression.dictionary(spark.createDataFrame(rows, schema)).collect()))
    one = [("entrez", "7"), ("hgnc", "HGNC:1"), ("ensembl", "E"), ("symbol", "a"), ("alias", "b"), ("alias", "c")]
    assert got == sorted([(*k, "HGNC:1") for k in one] + [("hgnc", "HGNC:2", "HGNC:2"), ("symbol", "a", "HGNC:2"), ("alias", "b", "HGNC:2")])
