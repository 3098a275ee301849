"""Readers of cohort files: JSON, JSON lines, CSV/TSV findings, expression tables, molecular tables, MAF, VCF, FASTA.

Headers are sniffed on the driver from a file's first line; everything else is read by Spark. Row numbers are given
before any shuffle, with the header as record 1, so that an issue points to its line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from cohortloom.operators.running import running
from cohortloom.operators.tables import written

# Columns of a findings table.
FINDING_COLUMNS = [
    "case_id", "patient_id", "sample_id", "institution_id", "data_class", "age_years", "sex_at_birth", "specimen_site", "evidence_cutoff", "finding_id",
    "kind", "name", "value", "status", "units", "assay", "timepoint", "reference_build", "known_primary",
]
FINDING_REQUIRED = ["case_id", "data_class", "finding_id", "kind", "name", "value"]
FEATURE_COLUMNS = [
    "sample_id", "id", "name", "modality", "value", "units", "status", "gene", "chromosome", "position", "reference", "alternate", "consequence", "somatic",
    "catalogue", "method", "mutation_count", "reference_build", "assay", "coverage", "group", "depends_on", "reference_sha256",
]
FEATURE_REQUIRED = ["sample_id", "id", "name", "modality", "value", "status", "group"]
GENE_NAMES = ("gene", "gene_id", "gene_symbol", "symbol", "hgnc_id", "ensembl_gene_id")
VALUE_NAMES = ("expression", "value", "tpm", "fpkm", "count", "counts")
SAMPLE_NAMES = ("sample_id", "sample")
LINE_BYTES = 16 << 10
SOURCE_BYTES = 64 << 20
SAMPLES_MOST = 512
LINES_A_BLOCK = 1 << 16
SPLITS_SENT = 100_000
WINDOW_BYTES = 1 << 16


class SourceError(ValueError):
    """A file that can't be read as what it should be."""


def snapshot(spark: SparkSession, path: str, most: int = SOURCE_BYTES) -> DataFrame:
    """(path, length, sha256) of files; no content is an error, an oversized file is one when it is read."""
    found = spark.read.format("binaryFile").load(path)
    if not found.where("length > 0").limit(1).count():
        raise SourceError("empty source")
    large = F.when(F.col("length") > most, F.raise_error(F.lit("oversized source")).cast("long")).otherwise(F.col("length"))
    return found.select("path", large.alias("length"), F.sha2("content", 256).alias("sha256"))


def header(spark: SparkSession, path: str, comment: str | None = None) -> str:
    """The first line that isn't a comment."""
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.startswith("value", F.lit(comment)))
    first = lines.limit(1).collect()
    if not first or not first[0][0]:
        raise SourceError("the table has no header")
    return first[0][0].lstrip("﻿")


def _columns(line: str, sep: str) -> list[str]:
    names = [c.strip().strip('"') for c in line.split(sep)]
    if len(set(names)) != len(names):
        raise SourceError("a column is named twice")
    return names


def numbered(rows: DataFrame, first: int = 1, file: str | None = None) -> DataFrame:
    """Adds `record`: the place of each row in its text file, whatever splits it is read in; and the file's path, if a name is given for it.

    A split's rows are in order and its start is known, so the splits' counts give what comes before each: one row a split,
    summed by file, and sent along only while they are few.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"))
    splits = placed.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__low"))
    before = W.partitionBy("__file").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)  # one row a split
    moves = written(splits.select("__file", "__start", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low") + first).alias("__move")), "splits")
    moves = F.broadcast(moves) if moves.limit(SPLITS_SENT + 1).count() <= SPLITS_SENT else moves
    out = placed.join(moves, ["__file", "__start"]).withColumn("record", F.col("__id") + F.col("__move"))
    return (out.withColumn(file, F.col("__file")) if file else out).drop("__file", "__start", "__id", "__move")


def _line_ends(value: Column) -> tuple[Column, Column]:
    """Whether a quoted cell is open after a line of CSV, if none was open before it, and if one was.

    A quote opens a cell only as its first character, a doubled quote stays inside, and what follows a closing quote up to
    the comma belongs to the cell.
    """
    tail = lambda v: F.regexp_replace(v, r'\A(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+', "")
    opened = lambda v: F.rlike(tail(v), F.lit(r'\A"(?:[^"]++|"")*+\z'))
    closed = F.rlike(value, F.lit(r'\A(?:[^"]++|"")*+"'))
    rest = F.regexp_replace(value, r'\A(?:[^"]++|"")*+"[^,]*+', "")
    return opened(value), ~closed | ((rest != "") & opened(F.substring(rest, F.lit(2), F.length(rest))))


def _carried(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds what comes before each row of a group: __set (the last settled state, else null) and __odd (whether it was flipped since).

    Each row settles a state (`fix` true or false) or leaves it (`fix` null, `flip` false) or turns it round (`flip` true).
    """
    here = W.partitionBy(*by).orderBy(order)
    so_far = F.sum(F.col("flip").cast("long")).over(here.rowsBetween(W.unboundedPreceding, 0))
    counted = rows.withColumn("__flips", so_far)
    past = here.rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("fix").isNotNull(), F.struct("fix", "__flips")), ignorenulls=True).over(past)
    flips = F.coalesce(F.max("__flips").over(past), F.lit(0)) - F.coalesce(last["__flips"], F.lit(0))
    return counted.withColumn("__set", last["fix"]).withColumn("__odd", flips % 2 == 1).drop("__flips")


def csv_records(lines: DataFrame, block: int | None = None) -> DataFrame:
    """(path, record, text) of the records of CSV files from their lines (path, record, value): quoted cells may hold line breaks.

    Whether a line starts inside a quoted cell follows from all lines before it. Every line either settles that, keeps it
    or turns it round, whichever it was; these compose, so blocks of lines are summed up, the blocks run along the file (a
    row each), and each line takes its block's state. Lines that are records of their own are not moved; only those of a
    record with line breaks come together. Blank lines are no records; records are numbered from 1, with the header.
    """
    free, inside = _line_ends(F.col("value"))
    at = lines.select("path", "record", "value", F.floor(F.col("record") / (block or LINES_A_BLOCK)).alias("__block"), free.alias("__free"), inside.alias("__inside"))
    same = F.col("__free") == F.col("__inside")
    kinds = at.withColumn("fix", F.when(same, F.col("__free"))).withColumn("flip", ~same & F.col("__free"))
    local = _carried(kinds, ["path", "__block"], "record")
    ends = local.groupBy("path", "__block").agg(F.max_by(F.struct("__set", "__odd", "fix", "flip"), "record").alias("e"))
    done = F.coalesce(F.col("e.fix"), F.col("e.__set") != (F.col("e.__odd") != F.col("e.flip")))
    blocks = ends.select("path", "__block", done.alias("fix"), (F.col("e.fix").isNull() & F.col("e.__set").isNull() & (F.col("e.__odd") != F.col("e.flip"))).alias("flip"))
    # One row a block of lines.
    starts = _carried(blocks, ["path"], "__block").select("path", "__block", (F.coalesce("__set", F.lit(False)) != F.col("__odd")).alias("__start"))
    state = F.coalesce("__set", F.col("__start")) != F.col("__odd")
    stated = local.join(starts, ["path", "__block"]).withColumn("__in", state)
    after = F.when(F.col("__in"), F.col("__inside")).otherwise(F.col("__free"))
    marked = stated.select("path", F.col("record").alias("line"), "value", "__block", "__in", after.alias("__open")).where(F.col("__in") | (F.trim(F.regexp_replace("value", "\r$", "")) != ""))
    begun = running(marked.withColumn("__one", (~F.col("__in")).cast("double")), ["path"], F.col("__block"), "line", {"__record": "__one"})
    begun = begun.withColumn("record", F.col("__record").cast("long"))
    whole = begun.where(~F.col("__in") & ~F.col("__open")).select("path", "record", F.col("value").alias("text"))
    parts = begun.where(F.col("__in") | F.col("__open")).groupBy("path", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return whole.unionByName(parts)


def _table(spark: SparkSession, path: str, sep: str, names: list[str], comment: str | None = None) -> DataFrame:
    """All columns as text, with `record` (the line in the file, header and comments included) and `malformed` (rows of another width)."""
    lines = numbered(spark.read.text(path))
    said = lines.where(~F.startswith("value", F.lit(comment))) if comment else lines
    top = said.agg(F.min("record")).first()[0]
    body = said.where((F.col("record") > (top or 0)) & (F.trim("value") != ""))
    return _parsed(body.select("record", F.regexp_replace("value", r"\r$", "").alias("text")), sep, names)


def _parsed(rows: DataFrame, sep: str, names: list[str], options: dict | None = None) -> DataFrame:
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("__bad", T.StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"} | (options or {})
    parsed = rows.select("record", F.from_csv("text", _ddl(schema), options).alias("r"))
    return parsed.select("r.*", "record").withColumn("malformed", F.col("__bad").isNotNull()).drop("__bad")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` STRING" for f in schema.fields)


def findings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of a findings table, all 19 columns, absent ones null; `record` is the record's number, 1 for the header.

    Quoted cells may hold line breaks (`csv_records`); a file is read in as many splits as it has.
    """
    names = _columns(header(spark, path), sep)
    if set(names) - set(FINDING_COLUMNS) or set(FINDING_REQUIRED) - set(names):
        raise SourceError("unknown or missing columns")
    if sep == ",":
        records = csv_records(numbered(spark.read.option("lineSep", "\n").text(path), file="path"))
        rows = _parsed(records.where("record > 1").select("record", F.regexp_replace("text", r"\r\z", "").alias("text")), sep, names, {"escape": '"', "multiLine": "true"})
    else:
        rows = _table(spark, path, sep, names)
    return rows.select(*[(F.col(c) if c in names else F.lit(None).cast("string").alias(c)) for c in FINDING_COLUMNS], "record", "malformed")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, most: int = LINE_BYTES) -> DataFrame:
    """(record, issue, row): oversized lines, bad JSON and unknown fields are issues; the scan goes on."""
    lines = numbered(spark.read.text(path)).select("record", F.regexp_replace("value", r"\r$", "").alias("line")).where("trim(line) <> ''")
    parsed = F.from_json("line", schema)
    allowed = F.array(*map(F.lit, schema.fieldNames()))
    keys = F.json_object_keys("line")
    issue = F.when(F.octet_length("line") > most, "oversized").when(keys.isNull(), "invalid_json").when(F.size(F.array_except(keys, allowed)) > 0, "unknown_field")
    return lines.select("record", issue.alias("issue"), F.when(issue.isNull(), parsed).alias("row"))


def json_document(spark: SparkSession, path: str, schema: T.StructType, most: int = LINE_BYTES) -> DataFrame:
    """As json_lines, for a file that is one document."""
    text = spark.read.text(path, wholetext=True).select(F.lit(1).cast("long").alias("record"), F.col("value").alias("line"))
    keys = F.json_object_keys("line")
    issue = F.when(F.octet_length("line") > most, "oversized").when(keys.isNull(), "invalid_json").when(F.size(F.array_except(keys, F.array(*map(F.lit, schema.fieldNames())))) > 0, "unknown_field")
    return text.select("record", issue.alias("issue"), F.when(issue.isNull(), F.from_json("line", schema)).alias("row"))


@dataclass(frozen=True)
class Layout:
    sep: str
    names: list[str]
    gene: str
    value: str | None
    sample: str | None


def expression_layout(spark: SparkSession, path: str) -> Layout:
    """Exactly one separator must give two or more columns with a gene column; a value column makes it long, else it is wide."""
    line = header(spark, path)
    fits = []
    for sep in (",", "\t"):
        names = [c.strip().strip('"') for c in line.split(sep)]
        gene = [n for n in names if n.lower() in GENE_NAMES]
        if len(names) >= 2 and len(gene) == 1:
            fits.append((sep, names, gene[0]))
    if len(fits) != 1:
        raise SourceError("the separator or the gene column is not clear")
    sep, names, gene = fits[0]
    _columns(line, sep)
    value = [n for n in names if n.lower() in VALUE_NAMES]
    sample = [n for n in names if n.lower() in SAMPLE_NAMES]
    long = len(value) == 1 and len(names) <= 3
    if not long and len(names) - 1 > SAMPLES_MOST:
        raise SourceError("too many samples")
    return Layout(sep, names, gene, value[0] if long else None, sample[0] if long and sample else None)


def expression(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """(sample_id, record, source_column, original, raw), long tables as they are and wide ones unpivoted."""
    at = expression_layout(spark, path)
    rows = _table(spark, path, at.sep, at.names)
    if at.value:
        if not at.sample and sample is None:
            raise SourceError("a long table without a sample column needs a sample")
        return rows.select((F.col(at.sample) if at.sample else F.lit(sample)).alias("sample_id"), "record", F.lit(at.value).alias("source_column"), F.col(at.gene).alias("original"), F.col(at.value).alias("raw"))
    others = [n for n in at.names if n != at.gene]
    return rows.unpivot([F.col(at.gene).alias("original"), F.col("record")], others, "sample_id", "raw").select("sample_id", "record", F.col("sample_id").alias("source_column"), "original", "raw")


def gene_table(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "\t", _columns(header(spark, path), "\t"))


def features(spark: SparkSession, path: str, sep: str = "\t", sample: str | None = None) -> DataFrame:
    """Rows of a molecular feature table with typed values; any malformed row is an error when read, the filter by sample comes after numbering."""
    names = _columns(header(spark, path), sep)
    if set(names) - set(FEATURE_COLUMNS) or set(FEATURE_REQUIRED) - set(names):
        raise SourceError("unknown or missing columns")
    rows = _table(spark, path, sep, names).where(F.when(F.col("malformed"), F.raise_error(F.lit("malformed feature row")).cast("boolean")).otherwise(True))
    rows = rows.select(*[(F.col(c) if c in names else F.lit(None).cast("string").alias(c)) for c in FEATURE_COLUMNS], "record")
    if sample is not None:
        rows = rows.where(F.col("sample_id") == sample)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    from cohortloom.functions.text import category, strict_double

    number = strict_double(blank("value"))
    mode = F.col("modality")
    observed = F.col("status") == "observed"
    value = F.struct(
        F.when(mode.isin("mutation", "fusion"), "mutation").when(mode == "copy_number", "copy_number").when(mode == "signature", "signature").when(number.isNotNull(), "number").otherwise("category").alias("kind"),
        number.alias("number"), F.when(mode == "copy_number", number.cast("int")).alias("call"), F.when(number.isNull(), F.coalesce(category(F.col("value")), F.col("value"))).alias("category"),
    )
    depends = F.filter(F.transform(F.split(F.coalesce(blank("depends_on"), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn("typed", F.when(observed, value)).withColumn("depends", depends)


def feature_problems(rows: DataFrame) -> DataFrame:
    """(sample_id, id, problem): duplicates, values without or against their status, bounds by modality, dependencies across groups."""
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    t = F.col("typed")
    one = F.coalesce(
        F.when((F.col("status") == "observed") & blank & ~F.col("modality").isin("mutation", "fusion"), "observed without a value"),
        F.when((F.col("status") != "observed") & ~blank, "value without observation"),
        F.when(F.col("reference_build").isNotNull() & (F.trim("reference_build") != "") & ~F.col("reference_build").isin("GRCh37", "GRCh38"), "unknown build"),
        F.when((F.col("modality") == "copy_number") & (F.col("status") == "observed") & ~F.coalesce(t["number"].between(-2, 2) & (t["number"] == F.floor(t["number"])), F.lit(False)), "copy number outside -2 to 2"),
        F.when((F.col("modality") == "signature") & (F.col("status") == "observed") & ~F.coalesce(t["number"].between(0, 1), F.lit(False)), "fraction outside 0 to 1"),
    )
    row = rows.select("sample_id", "id", one.alias("problem")).where("problem is not null")
    twice = rows.groupBy("sample_id", "id").count().where("count > 1").select("sample_id", "id", F.lit("duplicate feature").alias("problem"))
    asks = rows.select("sample_id", "id", "group", F.explode("depends").alias("on"))
    has = rows.select(F.col("sample_id").alias("s"), F.col("id").alias("on"), F.col("group").alias("g"))
    lost = asks.join(has, (asks["sample_id"] == has["s"]) & (asks["on"] == has["on"]) & asks["group"].eqNullSafe(has["g"]), "left_anti").select("sample_id", "id", F.lit("dependency outside its group").alias("problem"))
    total = rows.where((F.col("modality") == "signature") & (F.col("status") == "observed")).groupBy("sample_id", "assay", "catalogue").agg(F.sum("typed.number").alias("n"), F.count_distinct("group").alias("g"), F.min("id").alias("id"))
    over = total.where((F.col("n") > 1 + 1e-6) | (F.col("g") > 1)).select("sample_id", "id", F.lit("fractions of a catalogue exceed one or cross groups").alias("problem"))
    return row.unionByName(twice).unionByName(lost).unionByName(over)


def maf(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, record, chromosome, position, reference, alternate, gene, consequence, somatic, build) of a MAF table."""
    names = _columns(header(spark, path, "#"), "\t")
    need = {"Tumor_Sample_Barcode", "NCBI_Build", "Hugo_Symbol", "Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2", "Variant_Classification"}
    if need - set(names):
        raise SourceError("missing MAF columns")
    rows = _table(spark, path, "\t", names, comment="#")
    status = F.col("Mutation_Status") if "Mutation_Status" in names else F.lit("Somatic")
    return rows.select(
        F.col("Tumor_Sample_Barcode").alias("sample_id"), "record", F.regexp_replace("Chromosome", "^chr", "").alias("chromosome"), F.col("Start_Position").try_cast("long").alias("position"),
        F.upper("Reference_Allele").alias("reference"), F.upper("Tumor_Seq_Allele2").alias("alternate"), F.col("Hugo_Symbol").alias("gene"), F.col("Variant_Classification").alias("consequence"),
        (F.lower(status) == "somatic").alias("somatic"), build_name(F.col("NCBI_Build")).alias("build"),
    )


def build_name(text):
    return F.when(text.isin("37", "GRCh37", "hg19"), "GRCh37").when(text.isin("38", "GRCh38", "hg38"), "GRCh38")


def vcf(spark: SparkSession, path: str, build: str) -> DataFrame:
    """Passed, biallelic variants of a VCF with one sample; INFO needs GENE and CONSEQUENCE, SOMATIC is a flag, repeated keys: the last wins."""
    lines = numbered(spark.read.text(path))
    names = header(spark, path, "##").lstrip("#").split("\t")
    if len(names) != 10 or names[0] != "CHROM":
        raise SourceError("a VCF with one sample has ten columns")
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).select("record", f.alias("f")).where(F.size("f") == 10)
    info = F.split(F.col("f")[7], ";")
    of = lambda key: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(info, lambda x: F.startswith(x, F.lit(f"{key}="))), lambda x: F.substring(x, len(key) + 2, 1 << 30))), -1)
    genotype = F.split(F.split(F.col("f")[9], ":")[0], r"[/|]")
    kept = rows.where((F.col("f")[6] == "PASS") & ~F.contains(F.col("f")[4], F.lit(",")) & F.array_contains(genotype, "1") & of("GENE").isNotNull() & of("CONSEQUENCE").isNotNull())
    return kept.select(
        F.lit(names[9]).alias("sample_id"), "record", F.regexp_replace(F.col("f")[0], "^chr", "").alias("chromosome"), F.col("f")[1].try_cast("long").alias("position"), F.upper(F.col("f")[3]).alias("reference"),
        F.upper(F.col("f")[4]).alias("alternate"), of("GENE").alias("gene"), of("CONSEQUENCE").alias("consequence"), F.array_contains(info, "SOMATIC").alias("somatic"), F.lit(build).alias("build"),
    )


def vcf_problems(spark: SparkSession, path: str) -> DataFrame:
    """(record, problem) of lines that `vcf` can't take as variants: another width than the header, or a position that is no number."""
    lines = numbered(spark.read.text(path)).where(~F.startswith("value", F.lit("#")))
    f = F.split("value", "\t")
    problem = F.when(F.size(f) != 10, "another width than the header").when(f[1].try_cast("long").isNull(), "position is no number")
    return lines.select("record", problem.alias("problem")).where("problem is not null")


def sample_counts(rows: DataFrame) -> DataFrame:
    """(sample_id, n) of any of the tables."""
    return rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).orderBy("sample_id")


def _contig_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contig, at, bases) of every sequence line with its zero-based place in the contig, and (contig, chromosome, length).

    Lines are read in splits. How many headers and bases come before a line are running sums in blocks of lines, so a
    contig is never one row and no line is read twice.
    """
    lines = numbered(spark.read.text(path)).select("record", F.startswith("value", F.lit(">")).alias("head"), F.col("value"))
    bases = F.when(F.col("head"), F.lit("")).otherwise(F.upper(F.regexp_replace("value", r"\s", "")))
    sized = lines.select("record", "head", F.regexp_extract("value", r"\A>\s*(\S+)", 1).alias("name"), bases.alias("bases")).withColumn("__h", F.col("head").cast("double")).withColumn("__n", F.length("bases").cast("double"))
    block = F.floor(F.col("record") / LINES_A_BLOCK)
    run = running(sized.withColumn("__all", F.lit(0)), ["__all"], block, "record", {"__heads": "__h", "__end": "__n"})
    placed = run.select(F.col("__heads").cast("long").alias("contig"), "head", "name", "bases", F.col("__end").cast("long").alias("end"))
    first = placed.where("head").select("contig", F.col("name").alias("chromosome"), F.col("end").alias("start"))
    body = placed.where("not head and bases <> ''")
    ends = body.groupBy("contig").agg(F.max("end").alias("last"))
    contigs = first.join(ends, "contig").select("contig", "chromosome", "start", (F.col("last") - F.col("start")).alias("length"))
    return body.join(contigs.select("contig", "start"), "contig").select("contig", (F.col("end") - F.length("bases") - F.col("start")).alias("at"), "bases"), contigs.drop("start")


def fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """(chromosome, chunk, sequence): bases k*size+1 .. (k+1)*size of each contig and one more on each side; N before the first.

    Each line goes to the chunks that it overlaps, and a chunk is put together from its own lines.
    """
    lines, contigs = _contig_lines(spark, path)
    end = F.col("at") + F.length("bases")
    low, high = F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - 1) / size)), F.floor(end / size)
    each = lines.select("contig", "at", "bases", F.explode(F.sequence(low, high)).alias("chunk"))
    start = F.greatest(F.col("at"), F.col("chunk") * size - 1)
    stop = F.least(end, (F.col("chunk") + 1) * size + 1)
    piece = F.substring("bases", (start - F.col("at") + 1).cast("int"), (stop - start).cast("int"))
    pieces = each.where(stop > start).groupBy("contig", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start.alias("s"), piece.alias("p")))), lambda x: x["p"]), "").alias("s"))
    whole = pieces.join(contigs, "contig").where(F.col("chunk") * size < F.col("length"))
    return whole.select("chromosome", "chunk", F.concat(F.when(F.col("chunk") == 0, "N").otherwise(""), F.col("s")).alias("sequence"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, length, offset, line_bases, line_bytes) of a .fai index; a malformed line is an error when read."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> ''").select(f.alias("f"))
    number = lambda k: F.col("f")[k].try_cast("long")
    good = (F.size("f") == 5) & (number(1) >= 0) & (number(2) >= 0) & (number(3) > 0) & (number(4) >= number(3))
    rows = rows.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit("malformed index line")).cast("boolean")))
    return rows.select(F.col("f")[0].alias("chromosome"), *[number(k).alias(n) for k, n in ((1, "length"), (2, "offset"), (3, "line_bases"), (4, "line_bytes"))])


def index_problems(spark: SparkSession, path: str, index: str) -> DataFrame:
    """(chromosome, problem) where a .fai index and its FASTA differ in contigs or lengths."""
    _, contigs = _contig_lines(spark, path)
    both = fasta_index(spark, index).select("chromosome", F.col("length").alias("said")).join(contigs.select("chromosome", "length"), "chromosome", "full_outer")
    problem = F.when(F.col("said").isNull(), "not in the index").when(F.col("length").isNull(), "not in the sequence").when(F.col("said") != F.col("length"), "another length")
    return both.select("chromosome", problem.alias("problem")).where("problem is not null")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, chromosome, length, offset, line_bases, line_bytes) of the contigs of FASTA files, one or a folder of them; an odd line width is an error when read.

    A line's place in bytes is a running sum over its file in blocks of lines.
    """
    lines = numbered(spark.read.option("lineSep", "\n").text(path), file="path")
    sized = lines.select("path", "record", F.startswith("value", F.lit(">")).alias("head"), F.regexp_extract("value", r"\A>\s*(\S+)", 1).alias("name"), F.octet_length("value").alias("n"), F.length(F.regexp_replace("value", r"\s", "")).alias("bases"))
    sized = sized.withColumn("__n", (F.col("n") + 1).cast("double")).withColumn("__h", F.col("head").cast("double"))
    run = running(sized, ["path"], F.floor(F.col("record") / LINES_A_BLOCK), "record", {"__end": "__n", "__contig": "__h"})
    body = run.where("not head and bases > 0").groupBy("path", "__contig").agg(F.sum("bases").cast("long").alias("length"), F.min_by(F.struct("bases", "n"), "record").alias("first"), F.max("record").alias("last"), F.max("bases").alias("widest"))
    heads = run.where("head").select("path", "__contig", "name", F.col("__end").cast("long").alias("offset"))
    # All lines but a contig's last must be as wide as its first.
    odd = run.where("not head and bases > 0").join(body, ["path", "__contig"]).where((F.col("record") < F.col("last")) & (F.col("bases") != F.col("first.bases"))).select("path", "__contig", F.lit(True).alias("odd")).distinct()
    both = heads.join(body, ["path", "__contig"]).join(odd, ["path", "__contig"], "left")
    wrong = F.coalesce(F.col("odd"), F.lit(False)) | (F.col("widest") > F.col("first.bases"))
    length = F.when(wrong, F.raise_error(F.lit("lines of a contig differ in width")).cast("long")).otherwise(F.col("length"))
    return both.select("path", F.col("name").alias("chromosome"), length.alias("length"), "offset", F.col("first.bases").cast("long").alias("line_bases"), (F.col("first.n") + 1).cast("long").alias("line_bytes"))


class Windows:
    """Bytes of files by place, read in windows; `read` counts the bytes that were asked for."""

    def __init__(self, size: int):
        self.size, self.read, self.path, self.start, self.data, self.file = size, 0, None, -1, b"", None

    def bytes_at(self, path: str, places: list[int]) -> bytes | None:
        """The bytes at rising places that lie close together; None beyond the end of the file."""
        window = places[0] // self.size * self.size
        if path != self.path:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            self.path, self.start, self.file = path, -1, system.open_input_file(inner)
        if window != self.start or places[-1] >= window + len(self.data):
            more = max(self.size, places[-1] + 1 - window)
            self.start, self.data = window, self.file.read_at(more, window)
            self.read += len(self.data)
        found = bytes(self.data[p - window] for p in places if p - window < len(self.data))
        return found if len(found) == len(places) else None


def indexed_contexts(positions: DataFrame, index: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """(chromosome, position, context, problem) of distinct positions: the base and both neighbours, read by place from the files that the index names.

    index: (path, chromosome, length, offset, line_bases, line_bytes). Distinct positions are dealt by file and window of
    bytes, and a task reads the windows that hold its positions and nothing else; a window has no more positions than bytes.
    A position off the contig's inside, or on a contig that the index lacks, has a problem and no context.
    """
    few = index.limit(SPLITS_SENT + 1).count() <= SPLITS_SENT
    asked = positions.select("chromosome", "position").distinct().join(F.broadcast(index) if few else index, "chromosome", "left")
    problem = F.when(F.col("length").isNull(), "not in the index").when((F.col("position") < 2) | (F.col("position") >= F.col("length")), "lacks complete context")
    place = lambda k: F.expr(f"offset + (position - {k}) div line_bases * line_bytes + (position - {k}) % line_bases")
    placed = asked.withColumn("problem", problem).withColumn("__window", F.when(problem.isNull(), F.expr(f"(offset + (position - 2) div line_bases * line_bytes + (position - 2) % line_bases) div {window}")))
    good = placed.where("problem is null").select("path", "chromosome", "position", "__window", *[place(k).alias(f"__{2 - k}") for k in (2, 1, 0)])
    dealt = good.repartition("path", "__window").sortWithinPartitions("path", "__window", "__0")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = Windows(window)
        for batch in batches:
            found = [files.bytes_at(path, [a, b, c]) for path, a, b, c in zip(batch["path"], batch["__0"], batch["__1"], batch["__2"])]
            text = [None if x is None else x.decode("ascii", "replace").upper() for x in found]
            yield pd.DataFrame({"chromosome": batch["chromosome"], "position": batch["position"], "context": text, "problem": [None if x else "beyond the file" for x in text]})

    kind = positions.schema["chromosome"].dataType.simpleString()
    read_rows = dealt.mapInPandas(read, f"chromosome {kind}, position long, context string, problem string")
    return read_rows.unionByName(placed.where("problem is not null").select("chromosome", F.col("position").cast("long").alias("position"), F.lit(None).cast("string").alias("context"), "problem"))
