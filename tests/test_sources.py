import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.sources import bundles, files


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_findings(spark, tmp_path):
    path = put(tmp_path, "f.csv", 'case_id,data_class,finding_id,kind,name,value\nc1,synthetic,f1,k,n,"two\nlines"\nc2,synthetic,f1,k,n\nc3,synthetic,f1,k,n,v,extra\n')
    got = {r["case_id"]: (r["malformed"], r["value"]) for r in files.findings(spark, path).collect()}
    assert got["c1"] == (False, "two\nlines") and got["c2"][0] and got["c3"][0]
    for bad in ("case_id,case_id,data_class,finding_id,kind,name,value\n", "case_id,name\n", "case_id,data_class,finding_id,kind,name,value,else\n"):
        with pytest.raises(files.SourceError):
            files.findings(spark, put(tmp_path, "bad.csv", bad))


def test_json(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    path = put(tmp_path, "x.jsonl", '{"a":1}\r\n\n{"a":2,"zz":3}\nnot json\n{"b":"' + "x" * 20_000 + '"}\n{"b":"y"}\n')
    got = [(r["issue"], r["row"]) for r in files.json_lines(spark, path, schema).orderBy("record").collect()]
    assert [i for i, _ in got] == [None, "unknown_field", "invalid_json", "oversized", None] and got[0][1]["a"] == 1
    assert files.json_document(spark, put(tmp_path, "d.json", '{\n"a": 5\n}'), schema).first()["row"]["a"] == 5


def test_expression_tables(spark, tmp_path):
    wide = put(tmp_path, "w.tsv", "gene\ts1\ts2\nA\t1\t2\nB\t3\tNA\n")
    got = {(r["sample_id"], r["original"], r["record"]): r["raw"] for r in files.expression(spark, wide).collect()}
    assert got == {("s1", "A", 2): "1", ("s2", "A", 2): "2", ("s1", "B", 3): "3", ("s2", "B", 3): "NA"}
    long = put(tmp_path, "l.csv", "sample_id,gene,expression\ns1,A,1\n")
    assert files.expression(spark, long).first()["raw"] == "1"
    assert files.expression(spark, put(tmp_path, "o.csv", "gene,tpm\nA,1\n"), sample="q").first()["sample_id"] == "q"
    with pytest.raises(files.SourceError):
        files.expression(spark, put(tmp_path, "n.csv", "name,s1\nA,1\n"))


def test_features(spark, tmp_path):
    head = "sample_id\tid\tname\tmodality\tvalue\tstatus\tgroup\tdepends_on\tassay\tcatalogue\n"
    path = put(tmp_path, "m.tsv", head + "s\ta\tA\tcopy_number\t2\tobserved\tg1\t\t\t\ns\tb\tB\tsignature\t0.7\tobserved\tg2\ta\tx\tc\ns\tc\tC\tsignature\t0.6\tobserved\tg2\tb\tx\tc\ns\td\tD\tcategory\tv\tnot_tested\tg2\t\t\t\ns\te\tE\tcopy_number\t5\tobserved\tg2\t\t\t\n")
    rows = files.features(spark, path)
    assert rows.where("id = 'a'").first()["typed"]["call"] == 2
    found = {(r["id"], r["problem"]) for r in files.feature_problems(rows).collect()}
    assert found == {("b", "dependency outside its group"), ("b", "fractions of a catalogue exceed one or cross groups"), ("d", "value without observation"), ("e", "copy number outside -2 to 2")}
    assert files.features(spark, path, sample="none").count() == 0 and files.sample_counts(rows).first()["n"] == 5


def test_variants(spark, tmp_path):
    maf = put(tmp_path, "x.maf", "#v\nTumor_Sample_Barcode\tNCBI_Build\tHugo_Symbol\tChromosome\tStart_Position\tReference_Allele\tTumor_Seq_Allele2\tVariant_Classification\ns\thg19\tTP53\tchr17\t9\tc\ta\tMissense\n")
    r = files.maf(spark, maf).first()
    assert (r["build"], r["chromosome"], r["position"], r["reference"], r["somatic"]) == ("GRCh37", "17", 9, "C", True)
    body = "1\t5\t.\tA\tG\t9\tPASS\tGENE=X;CONSEQUENCE=a;CONSEQUENCE=b;SOMATIC\tGT\t0/1\n1\t6\t.\tA\tG,T\t9\tPASS\tGENE=X;CONSEQUENCE=a\tGT\t0/1\n1\t7\t.\tA\tG\t9\tq10\tGENE=X;CONSEQUENCE=a\tGT\t0/1\n1\t8\t.\tA\tG\t9\tPASS\tGENE=X;CONSEQUENCE=a\tGT\t0/0\n"
    vcf = put(tmp_path, "x.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n" + body)
    got = files.vcf(spark, vcf, "GRCh38").collect()
    assert [(r["position"], r["consequence"], r["somatic"], r["sample_id"]) for r in got] == [(5, "b", True, "s1")]


def test_fasta(spark, tmp_path):
    from cohortloom.operators.spectra import with_context

    path = put(tmp_path, "g.fa", ">one first\nACGTA\nCGTAC\nGT\n>two\nTTTT\n")
    chunks = files.fasta_chunks(spark, path, 4)
    sequence = "ACGTACGTACGT"
    at = spark.createDataFrame([("one", i) for i in range(2, 12)], "chromosome string, position long")
    got = {r["position"]: r["context"] for r in with_context(at, chunks, 4).collect()}
    assert got == {i: sequence[i - 2 : i + 1] for i in range(2, 12)}


def test_bundles(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    path = str(tmp_path / "bundle")
    bundles.write({"t": df}, path, "demo")
    assert bundles.read(spark, path, "demo")["t"].count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        bundles.write({"t": df}, path, "demo")
    df.write.mode("append").parquet(f"{path}/t")
    with pytest.raises(bundles.BundleError):
        bundles.read(spark, path)
    with pytest.raises(bundles.BundleError):
        bundles.read(spark, str(tmp_path / "none"))
    assert bundles.differences(df, df).count() == 0 and bundles.differences(df, df.where("k = 1")).first()["side"] == "left"
    bundles.export(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert files.snapshot(spark, put(tmp_path, "s.txt", "abc")).first()["sha256"].startswith("ba7816bf")
    with pytest.raises(files.SourceError, match="empty"):
        files.snapshot(spark, put(tmp_path, "e.txt", ""))
    with pytest.raises(Exception, match="oversized"):
        files.snapshot(spark, put(tmp_path, "s.txt", "abc"), most=2).select(F.sum("length")).collect()
