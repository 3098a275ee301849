"""Typed values of molecular features: one struct of seven kinds, what each kind must hold, and the modalities it may stand in.

The value is a struct whose fields a kind uses or leaves null. Which kinds fit which modality is a table of its own, joined
by both, so a caller may bring another; bounds of the fields are expressions by kind. Problems are data: a feature without
one is valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds and the modalities that may hold them.
FITS = {
    "number": ["expression", "ihc", "copy_number", "mutation"],
    "category": ["ihc", "histology", "demographic"],
    "mutation": ["mutation"],
    "copy_number": ["copy_number"],
    "signature": ["signature"],
    "vector": ["expression", "signature"],
    "age": ["demographic"],
}
MOST_ENTRIES, MOST_YEARS, ALLELE_BYTES = 512, 120, 256
FIELDS = {
    "number": "double", "units": "string", "text": "string", "gene": "string", "chromosome": "string", "position": "long", "reference": "string", "alternate": "string", "consequence": "string",
    "call": "int", "signature": "string", "catalogue": "string", "method": "string", "mutation_count": "long", "entries": "map<string,double>", "reference_sha256": "string", "years": "int", "is_bound": "boolean",
}


def tagged(kind: Column, **fields: Column) -> Column:
    """A value of a kind with the fields that are given; unknown fields are an error."""
    if set(fields) - set(FIELDS):
        raise ValueError(f"no fields of a value: {sorted(set(fields) - set(FIELDS))}")
    return F.struct(kind.alias("kind"), *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def fits(spark: SparkSession) -> DataFrame:
    """(kind, modality) that go together."""
    return spark.createDataFrame([(k, m) for k, ms in FITS.items() for m in ms], "kind string, modality string")


def _text(c: Column, most: int) -> Column:
    return (F.trim(c) != "") & (F.octet_length(c) <= most) & ~F.rlike(c, F.lit(r"[\x00-\x1F\x7F-\x9F]"))


def _name(c: Column) -> Column:
    return F.rlike(c, F.lit(r"\A[A-Za-z0-9_.-]{1,128}\z"))


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def _all(checks: list[Column]) -> Column:
    """Every check holds; a check on an absent field does not."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def bounds(value: Column, modality: Column) -> Column:
    """Whether a value's fields are within the bounds of its kind."""
    v = {n: value[n] for n in FIELDS}
    allele = lambda c: F.rlike(c, F.lit(rf"\A[ACGT]{{1,{ALLELE_BYTES}}}\z"))
    whole = (modality != "mutation") | ((v["number"] >= 0) & (v["number"] == F.floor(v["number"])))
    rules = {
        "number": [_finite(v["number"]), _text(v["units"], 80), whole],
        "category": [_text(v["text"], 256)],
        "mutation": [_name(v["gene"]), _name(v["chromosome"]), v["position"] > 0, _text(v["consequence"], 128), v["reference"] != v["alternate"], allele(v["reference"]), allele(v["alternate"])],
        "copy_number": [_name(v["gene"]), v["call"].between(-2, 2)],
        "signature": [
            _name(v["signature"]), F.startswith(v["signature"], F.lit("SBS")), _finite(v["number"]), v["number"] >= 0, _text(v["units"], 128), _text(v["catalogue"], 128), _text(v["method"], 128),
            v["mutation_count"] > 0, (v["units"] != "fraction") | (v["number"] <= 1),
        ],
        "vector": [
            F.size(v["entries"]).between(1, MOST_ENTRIES), _text(v["units"], 128), F.rlike(v["reference_sha256"], F.lit(r"\A[0-9A-Fa-f]{64}\z")),
            F.forall(F.map_keys(v["entries"]), _name), F.forall(F.map_values(v["entries"]), lambda x: F.coalesce(_finite(x), F.lit(False))),
        ],
        "age": [v["years"].between(0, MOST_YEARS), v["is_bound"].isNotNull()],
    }
    out = F.lit(False)
    for kind, checks in rules.items():
        out = F.when(value["kind"] == kind, _all(checks)).otherwise(out)
    return out


def problems(features: DataFrame, key: list[str], matrix: DataFrame | None = None) -> DataFrame:
    """(key..., problem) of features (key..., modality, status, value) that can't be used.

    An observed feature has a value that fits its modality and its kind's bounds; any other has none.
    """
    allowed = (matrix or fits(features.sparkSession)).select(F.col("kind").alias("__kind"), F.col("modality").alias("__modality"), F.lit(True).alias("__fits")).distinct()
    joined = features.join(F.broadcast(allowed) if matrix is None else allowed, (F.col("value.kind") == F.col("__kind")) & (F.col("modality") == F.col("__modality")), "left")
    observed, there = F.col("status") == "observed", F.col("value").isNotNull()
    problem = (
        F.when(observed.isNull(), "no status").when(observed & ~there, "observed without a value").when(~observed & there, "a value that was not observed")
        .when(there & F.col("__fits").isNull(), "kind does not fit the modality").when(there & ~bounds(F.col("value"), F.col("modality")), "out of bounds")
    )
    return joined.select(*key, problem.alias("problem")).where("problem is not null")
