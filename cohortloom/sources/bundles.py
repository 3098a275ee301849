"""Bundles: data first, manifest last, never over one another, verified when opened.

A bundle is a folder of Parquet tables and a manifest with each table's rows and an order-free checksum. The manifest
is written last, so a folder without one is not a bundle. Reproducing rebuilds a table and compares it both ways.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.text import fingerprint


class BundleError(ValueError):
    pass


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum over the rows' fingerprints that doesn't depend on their order."""
    part = F.conv(F.substring(fingerprint(*sorted(df.columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("s")).first()
    return got["n"], got["s"]


PARTS = 64


def digests(df: DataFrame, key: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """(part, rows, digest) of a table: a sum over the fingerprints of each part's rows, free of their order.

    A row's part follows from its key (all columns if none is given), so that a difference names its part.
    """
    row = fingerprint(*sorted(df.columns))
    place = row if key is None else fingerprint(*sorted(key))
    number = lambda c, at: F.conv(F.substring(c, at, 15), 16, 10).cast("decimal(38,0)")
    part = (number(place, 40) % parts).cast("int").alias("part")
    sums = df.select(part, number(row, 1).alias("a"), number(row, 16).alias("b")).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("part", "rows", F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("digest"))


def _parts(df: DataFrame, key: list[str] | None) -> dict[str, list]:
    """The digests as a document: at most PARTS entries."""
    return {str(r["part"]): [r["rows"], r["digest"]] for r in digests(df, key).collect()}


def _inside(spark: SparkSession, path: str, name: str) -> None:
    """A table is a plain name, and its folder, its files and the bundle's manifest are no links."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*", name):
        raise BundleError("a table name leaves the bundle")
    fs, where = _fs(spark, f"{path}/{name}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    if not fs.exists(where):
        raise BundleError(f"{name} is not in the bundle")
    entries = context.util().listStatus(where) if fs.getFileStatus(where).isDirectory() else []
    for at in [where, *[e.getPath() for e in entries]]:
        if context.getFileLinkStatus(at).isSymlink():
            raise BundleError(f"{name} is or holds a link")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write(tables: dict[str, DataFrame], path: str, kind: str, partition_by: dict[str, list[str]] | None = None, keys: dict[str, list[str]] | None = None) -> dict:
    """Write each table (an existing one is an error), then the manifest; `keys`: what parts of a table go by."""
    spark = next(iter(tables.values())).sparkSession
    manifest = {"kind": kind, "tables": {}}
    for name, df in tables.items():
        df.write.mode("error").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path}/{name}")
        key = (keys or {}).get(name)
        parts = _parts(spark.read.schema(df.schema).parquet(f"{path}/{name}"), key)
        manifest["tables"][name] = {"rows": sum(n for n, _ in parts.values()), "parts": parts, "key": key, "schema": df.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/_manifest")
    return manifest


def read(spark: SparkSession, path: str, kind: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """Tables of a bundle; with `verify`, each is compared with the manifest."""
    from pyspark.sql.types import StructType

    fs, where = _fs(spark, f"{path}/_manifest")
    if not fs.exists(where):
        raise BundleError("no manifest: the bundle was not finished")
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    if kind is not None and manifest["kind"] != kind:
        raise BundleError(f"a bundle of kind {manifest['kind']}")
    found = {}
    for name, entry in manifest["tables"].items():
        _inside(spark, path, name)
        df = spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{path}/{name}")
        if verify and "parts" not in entry and checksum(df) != (entry["rows"], entry["checksum"]):
            raise BundleError(f"{name} differs from the manifest")
        if verify and "parts" in entry:
            now = _parts(df, entry["key"])
            odd = sorted((int(k) for k in now.keys() | entry["parts"].keys() if now.get(k) != entry["parts"].get(k)))
            if odd:
                raise BundleError(f"{name} differs from the manifest in parts {', '.join(map(str, odd))} of {PARTS}")
        found[name] = df
    return found


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side; empty if a rebuild gives the same."""
    names = left.columns
    return left.exceptAll(right.select(names)).withColumn("side", F.lit("left")).unionByName(right.select(names).exceptAll(left).withColumn("side", F.lit("right")))


def export(df: DataFrame, path: str, sep: str = ",") -> None:
    """One table as CSV or TSV with a header."""
    df.write.mode("error").option("header", True).option("sep", sep).csv(path)
