"""Expression matrices: quality control, class centroids and correlation ranking.

Long form throughout: (sample_id, record, gene, raw) before, (sample_id, gene, value) after mapping. Everything is an
aggregation or an equality join on gene; dictionaries and centroids are small dimensions, joined by shuffle unless
Spark's own size rules make them broadcasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortloom.functions.stats import ratio
from cohortloom.functions.text import ascii_lower, finite, is_missing, strict_double, stripped
from cohortloom.operators.tables import tasks_for

COUNT_LIMIT = float(2**53 - 1)
EPSILON = 2.220446049250313e-16
# Genes whose keys one task makes distinct.
TASK_GENES = 100_000


def log2_1p(x: Column) -> Column:
    return F.log1p(x) / F.lit(0.6931471805599453)


def unit_ok(x: Column, unit: Column) -> Column:
    """Counts are whole and exact, TPM and FPKM are not negative, log values are any finite number."""
    return finite(x) & F.when(unit == "counts", (x >= 0) & (x == F.floor(x)) & (x <= COUNT_LIMIT)).when(unit.isin("tpm", "fpkm"), x >= 0).otherwise(True)


def measured(records: DataFrame, unit: str = "tpm", log: bool = False, raw: str = "raw") -> DataFrame:
    """Adds status (missing, invalid, measured) and value (transformed if `log`) of every record."""
    text = stripped(F.col(raw).cast("string"))
    x = strict_double(text)
    ok = F.coalesce(unit_ok(x, F.lit(unit)), F.lit(False))
    status = F.when(is_missing(text), "missing").when(ok, "measured").otherwise("invalid")
    return records.withColumn("status", status).withColumn("value", F.when(status == "measured", log2_1p(x) if log else x))


def dictionary(table: DataFrame) -> DataFrame:
    """(namespace, key, gene) of the approved genes of a dictionary: hgnc, ensembl, entrez, symbol, alias and previous names.

    Rows are dealt by gene before their keys are made, so equal keys of a gene meet in one task of about `TASK_GENES`.
    """
    dealt = table.repartition(tasks_for(table.sparkSession, table.count(), TASK_GENES), "hgnc_id")
    ok = dealt.where((F.col("status") == "Approved") & F.rlike("hgnc_id", F.lit(r"\AHGNC:\d+\z")))
    one = lambda space, key: F.struct(F.lit(space).alias("namespace"), key.alias("key"))
    many = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: one("alias", ascii_lower(stripped(x))))
    keys = F.concat(
        F.array(one("hgnc", F.col("hgnc_id")), one("ensembl", F.col("ensembl_gene_id")), one("entrez", F.col("entrez_id").cast("string")), one("symbol", ascii_lower(F.col("symbol")))),
        many(F.col("alias_symbol")), many(F.col("prev_symbol")),
    )
    return ok.select(F.col("hgnc_id").alias("gene"), F.explode(keys).alias("k")).select("k.*", "gene").where("key is not null and key <> ''").distinct()


def resolved(ids: DataFrame, keys: DataFrame, original: str = "original") -> DataFrame:
    """(original, status, gene, candidates) of each distinct id; aliases count only if no symbol matches."""
    name = stripped(F.col(original))
    space = F.when(F.rlike(name, F.lit(r"\A(?i:HGNC):\d+\z")), "hgnc").when(F.rlike(name, F.lit(r"\AENSG\d+(\.\d+)?\z")), "ensembl").when(F.rlike(name, F.lit(r"\A\d+\z")), "entrez").otherwise("symbol")
    key = F.when(space == "ensembl", F.regexp_replace(name, r"\.\d+$", "")).when(space == "symbol", ascii_lower(name)).when(space == "hgnc", F.upper(name)).otherwise(name)
    asked = ids.select(F.col(original).alias("original"), space.alias("namespace"), key.alias("key")).distinct()
    # One join: a symbol is asked for as symbol and as alias, and the first that has hits wins.
    spaces = F.when(F.col("namespace") == "symbol", F.array(F.lit("symbol"), F.lit("alias"))).otherwise(F.array("namespace"))
    each = asked.select("original", "key", F.explode(spaces).alias("namespace"))
    hits = each.join(keys, ["namespace", "key"], "left").groupBy("original", "namespace").agg(F.array_sort(F.collect_set("gene")).alias("c"))
    best = hits.groupBy("original").agg(F.max(F.when(F.col("namespace") != "alias", F.col("c"))).alias("own"), F.max(F.when(F.col("namespace") == "alias", F.col("c"))).alias("alias"))
    found = F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("alias", "own"))
    status = F.when(F.size(found) == 1, "resolved").when(F.size(found) > 1, "ambiguous").otherwise("unmapped")
    return best.select("original", status.alias("status"), F.when(F.size(found) == 1, found[0]).alias("gene"), found.alias("candidates"))


def quality_control(records: DataFrame) -> DataFrame:
    """One row a sample from (sample_id, record, original, mapping, gene, status, value).

    A record is a duplicate if its raw id or its canonical gene was seen before it in the sample.
    """
    again = lambda c: F.col(c).isNotNull() & (F.row_number().over(W.partitionBy("sample_id", c).orderBy("record")) > 1)
    flagged = records.withColumn("duplicate", again("original") | again("gene"))
    c = F.count_if
    counted = flagged.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("total"), *[c(F.col("status") == s).alias(s) for s in ("measured", "missing", "invalid")], c(F.col("value") == 0).alias("zero"),
        *[c(F.col("mapping") == s).alias(s) for s in ("resolved", "ambiguous", "unmapped")], c("duplicate").alias("duplicate"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    rate = ratio(F.col("resolved"), F.col("total"))
    verdict = F.when((F.col("measured") == 0) | (F.col("invalid") > 0) | (F.col("duplicate") > 0), "blocked").when((F.col("missing") > 0) | (F.col("ambiguous") > 0) | (F.col("unmapped") > 0), "warning").otherwise("pass")
    return counted.select("*", rate.alias("mapping_rate"), verdict.alias("qc"))


def common_genes(values: DataFrame) -> DataFrame:
    """Genes measured in every sample."""
    n = values.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("__n"))
    return values.groupBy("gene").agg(F.count_distinct("sample_id").alias("__have")).join(F.broadcast(n), F.col("__have") == F.col("__n"), "left_semi").select("gene")


def label_problems(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, problem): labels and samples must match one to one, and a patient group may have one class only."""
    twice = labels.groupBy("sample_id").count().where("count > 1").select("sample_id", F.lit("duplicate label").alias("problem"))
    missing = samples.select("sample_id").distinct().join(labels, "sample_id", "left_anti").select("sample_id", F.lit("no label").alias("problem"))
    extra = labels.join(samples, "sample_id", "left_anti").select("sample_id", F.lit("no sample").alias("problem"))
    return twice.unionByName(missing).unionByName(extra)


def centroids(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(class_id, gene, mean, members) over the genes that all samples have."""
    kept = values.select("sample_id", "gene", "value").join(labels.select("sample_id", "class_id"), "sample_id").join(common_genes(values), "gene", "left_semi")
    return kept.groupBy("class_id", "gene").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("members"))


def pearson(pairs: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(by..., n, r): scaled by the largest magnitude, then one aggregation of centred moments; null below three pairs or without variance."""
    size = pairs.groupBy(*by).agg(F.max(F.abs(x)).alias("__sx"), F.max(F.abs(y)).alias("__sy"))
    scaled = pairs.join(size, by).select(*by, ratio(F.col(x), F.col("__sx")).alias("a"), ratio(F.col(y), F.col("__sy")).alias("b"))
    sums = scaled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("a", "b").alias("__ab"), F.var_pop("a").alias("__aa"), F.var_pop("b").alias("__bb"))
    good = (F.col("n") >= 3) & (F.col("__aa") * F.col("n") > EPSILON) & (F.col("__bb") * F.col("n") > EPSILON)
    r = F.when(good, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio(F.col("__ab"), F.sqrt("__aa") * F.sqrt("__bb")))))
    return sums.select(*by, "n", r.alias("r"))


def overlapping(queries: DataFrame, members: DataFrame) -> DataFrame:
    """Query samples that share a sample id, a measurement hash or a patient group with the reference: three equality joins."""
    found = None
    for key in ("sample_id", "measurement_sha256", "patient_group_id"):
        one = queries.where(F.col(key).isNotNull()).join(members.select(key).distinct(), key, "left_semi").select(queries["sample_id"], F.lit(key).alias("overlap"))
        found = one if found is None else found.unionByName(one)
    return found


def compare(queries: DataFrame, reference: DataFrame, least_genes: int = 3, least_overlap: float = 0.5, blocked: DataFrame | None = None) -> DataFrame:
    """(sample_id, class_id, n, r, position, status): each query against every centroid, by r, then class.

    Status: incompatible (in `blocked`), insufficient_data (too few shared genes), undefined_similarity or compared.
    """
    genes = reference.select("gene").distinct().agg(F.count(F.lit(1)).alias("__g"))
    pairs = queries.select("sample_id", "gene", F.col("value").alias("x")).join(reference.select("class_id", "gene", F.col("mean").alias("y")), "gene")
    r = pearson(pairs, ["sample_id", "class_id"]).crossJoin(F.broadcast(genes))  # one row
    bad = (F.col("n") < least_genes) | (F.col("n") < least_overlap * F.col("__g"))
    status = F.when(bad, "insufficient_data").when(F.col("r").isNull(), "undefined_similarity").otherwise("compared")
    if blocked is not None:
        # One row a query sample and class on the left.
        r = r.join(blocked.select("sample_id", F.lit(True).alias("__no")).distinct(), "sample_id", "left")
        status = F.when(F.col("__no"), "incompatible").otherwise(status)
    kept = r.select("sample_id", "class_id", "n", F.when(status == "compared", F.col("r")).alias("r"), status.alias("status"))
    order = W.partitionBy("sample_id").orderBy(F.desc_nulls_last("r"), F.asc("class_id"))  # classes of one sample
    return kept.select("*", F.row_number().over(order).alias("position"))


def matches(values: DataFrame, text: str = "") -> DataFrame:
    """One row: how many values `explore` has to choose from."""
    return values.where(F.contains(ascii_lower(F.col("gene")), ascii_lower(F.lit(text)))).agg(F.count(F.lit(1)).alias("matches"))


def explore(values: DataFrame, text: str = "", limit: int = 100) -> DataFrame:
    """The largest values of genes whose id contains the text, letters in either case; the limit is the feature."""
    if not 1 <= limit <= 1000:
        raise ValueError("a limit of 1 to 1,000")
    return values.where(F.contains(ascii_lower(F.col("gene")), ascii_lower(F.lit(text)))).orderBy(F.desc_nulls_last("value"), "gene", "sample_id").limit(limit)


def percentile_of(background: DataFrame, value: float) -> DataFrame:
    """Share of the background below the value, ties by half, in percent."""
    return background.agg((F.avg(F.when(F.col("value") < value, 1.0).when(F.col("value") == value, 0.5).otherwise(0.0)) * 100).alias("percentile"))
