import json

import pytest
from pyspark.sql import functions as F

from cohortloom.plans.study import study_report
from cohortloom.sources import bundles, files, runs


def test_documents_are_written_once_or_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "a.json")
    runs.save_new(spark, path, '{"x": 1}')
    with pytest.raises(runs.RunError):
        runs.save_new(spark, path, "{}")
    runs.replace(spark, path, '{"x": 2}')
    assert runs.read_json(spark, path) == {"x": 2}
    with pytest.raises(runs.RunError, match="more than 3 bytes"):
        runs.read_json(spark, path, 3)
    runs.replace(spark, path, "secret content")
    with pytest.raises(runs.RunError) as e:
        runs.read_json(spark, path)
    assert "secret" not in str(e.value)


def test_lock_and_resume(spark, tmp_path):
    path = str(tmp_path / "run")
    with runs.locked(spark, path, "a"):
        with pytest.raises(runs.RunError, match="holds the lock"), runs.locked(spark, path, "b"):
            pass
    with pytest.raises(KeyError), runs.locked(spark, path, "c"):
        raise KeyError
    with runs.locked(spark, path, "d"):
        pass
    runs.configured(spark, path, {"seed": 1, "attempts": 5})
    runs.configured(spark, path, {"seed": 1, "attempts": 9})
    for bad, why in (({"seed": 2, "attempts": 9}, "change seed"), ({"seed": 1, "attempts": 8}, "lower attempts"), ({"seed": 1, "attempts": 9, "extra": 0}, "change extra")):
        with pytest.raises(runs.RunError, match=why):
            runs.configured(spark, path, bad)


def test_bundles_by_kind(spark, tmp_path):
    f = spark.createDataFrame([("s", "x", 1.0), ("s", "y", None)], "sample_id string, id string, value double")
    run = spark.createDataFrame([("s", "class", 0.9)], "sample_id string, predicted string, p_top double")
    runs.export_run(f, run, str(tmp_path / "i"))
    kind, found = runs.open_any(spark, str(tmp_path / "i"))
    assert kind == "inference" and found["inference"].first()["predicted"] == "class"
    bundles.write({"features": f.withColumn("id", F.lit("z")), "inference": found["inference"]}, str(tmp_path / "forged"), "inference")
    with pytest.raises(bundles.BundleError, match="other features"):
        runs.open_any(spark, str(tmp_path / "forged"))
    cases = spark.createDataFrame([("c", [("f", "v")])], "case_id string, findings array<struct<finding_id:string,value:string>>")
    runs.write_cases(cases, cases.select("case_id"), cases.select("case_id", F.lit("test").alias("partition")), str(tmp_path / "c"))
    kind, found = runs.open_any(spark, str(tmp_path / "c"))
    assert kind == "cases" and found["splits"].first()["partition"] == "test" and json.loads(spark.read.text(str(tmp_path / "c" / "cases.jsonl")).first()[0])["case_id"] == "c"
    runs.write_dataset(f, spark.createDataFrame([("G", "HGNC:1")], "original string, gene string"), f.select("sample_id").distinct(), str(tmp_path / "d"))
    assert runs.open_any(spark, str(tmp_path / "d"))[1]["records"].count() == 2 and (tmp_path / "d" / "records" / "sample_id=s").is_dir()
    source = tmp_path / "old.json"
    source.write_bytes(b'{"a":\r\n 1}')
    made = runs.adopt(spark, str(source), str(tmp_path / "o"))
    assert (tmp_path / "o" / "source").read_bytes() == source.read_bytes() and made["length"] == 10 and runs.kind_of(spark, str(tmp_path / "o")) == "adopted"
    text = runs.run_markdown(run, f.withColumn("modality", F.lit("m")).withColumn("status", F.lit("observed")), spark.createDataFrame([("x|y", -0.2)], "feature string, contribution double"))
    assert "| class |" in text and "x\\|y" in text


def test_synthetic_study(spark):
    one, two = runs.synthetic_study(spark), runs.synthetic_study(spark)
    for name in one:
        assert not bundles.differences(one[name], two[name]).count()
    assert one["records"].count() == 528 and one["outcomes"].count() == 180 and one["records"].select("truth").distinct().count() == 22
    classes = one["records"].select(F.col("truth").alias("class_id")).distinct()
    report = study_report(one["records"], one["probabilities"], classes, classes, replicates=100)
    assert report["problems"].count() == 0 and report["detailed"]["summary"].first()["top1"] > 0.4


def test_records_are_lines_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "t.tsv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("#note\nid\tvalue\n" + "".join(f"k{i}\t{i}\n" if i % 7 else f"k{i}\t{i}\textra\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files._table(spark, path, "\t", ["id", "value"], "#")
        assert rows.rdd.getNumPartitions() > 4
        got = {r["id"]: (r["record"], r["malformed"]) for r in rows.collect()}
        assert len(got) == 5000 and all(got[f"k{i}"] == (i + 3, i % 7 == 0) for i in range(5000))
        fasta = str(tmp_path / "f.fa")
        body = {"c1": "ACGTN" * 3000, "c2": "GATTACA", "empty": "", "c3": "T" * 4097}
        with open(fasta, "w", encoding="utf-8") as f:
            for name, bases in body.items():
                f.write(f">{name} text > here\n" + "".join(bases[i : i + 61] + "\n" for i in range(0, len(bases), 61)))
        chunks = {(r["chromosome"], r["chunk"]): r["sequence"] for r in files.fasta_chunks(spark, fasta, 100).collect()}
        assert chunks == {(n, k): ("N" + b)[k * 100 : k * 100 + 102] for n, b in body.items() for k in range(-(-len(b) // 100))}
        index = str(tmp_path / "f.fai")
        with open(index, "w", encoding="utf-8") as f:
            f.write("c1\t15000\t16\t61\t62\nc2\t8\t99\t61\t62\nc9\t1\t0\t61\t62\n")
        assert {(r["chromosome"], r["problem"]) for r in files.index_problems(spark, fasta, index).collect()} == {("c2", "another length"), ("c3", "not in the index"), ("c9", "not in the sequence")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_vcf_problems(spark, tmp_path):
    path = str(tmp_path / "v.vcf")
    with open(path, "w", encoding="utf-8") as f:
        f.write("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n1\t5\t.\tA\tC\t.\tPASS\tG\tGT\t0/1\n1\tx\t.\tA\tC\t.\tPASS\tG\tGT\t0/1\n1\t5\t.\n")
    assert [(r["record"], r["problem"]) for r in files.vcf_problems(spark, path).orderBy("record").collect()] == [(4, "position is no number"), (5, "another width than the header")]
