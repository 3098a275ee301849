from cohortloom.operators import scoring, validation
from cohortloom.sources import bindings as B
from cohortloom.sources import exports


def problems(df):
    return {(r["subject"], r["problem"]) for r in df.collect()}


def test_cases(spark):
    schema = "case_id string, schema_version int, age_years int, age_lower_bound int, findings array<struct<finding_id:string,name:string,value:string,status:string>>"
    rows = [("ok", 2, 5, None, [("f", "n", "v", "observed")]), ("bad id", 9, 200, 89, [("f", " ", "v", "not_tested"), ("f", "n", None, None)]), ("none", 1, None, None, [])]
    got = problems(validation.case_problems(spark.createDataFrame(rows, schema)))
    assert got == {("bad id", p) for p in ("invalid case id", "unknown schema", "finding without status", "value against status", "finding id used twice", "invalid finding name", "age and bound together", "age out of range")} | {("none", "no findings")}
    schema = "case_id string, ecog int, investigations array<struct<kind:string,date:string>>, reviews array<struct<reason:string>>"
    got = problems(validation.context_problems(spark.createDataFrame([("c", 7, [("a", "2024-02-30"), ("a", None)], [("",)]), ("d", 1, [("a", "2024-02-29")], [])], schema)))
    assert got == {("c", p) for p in ("investigation recorded twice", "invalid date", "review without a reason", "performance status out of range")}


def test_releases_and_studies(spark):
    members = spark.createDataFrame([("s1", "p1", "a"), ("s2", "p1", "b"), ("s2", "p2", "b")], "sample_id string, patient_group_id string, class_id string")
    centroids = spark.createDataFrame([("a", f"g{i}", float(i), 1) for i in range(3)] + [("b", "g0", 1.0, 1), ("c", "g0", 1.0, 1)], "class_id string, gene string, mean double, members long")
    assert problems(validation.reference_problems(members, centroids)) == {("p1", "patient group in several classes"), ("s2", "sample listed twice"), ("b", "too few genes"), ("c", "class without members or centroid")}
    broad = spark.createDataFrame([("a", "unknown"), ("z", "unknown")], "class_id string, broad string")
    got = problems(validation.study_problems(B.named(spark, ["a", "b"]), B.named(spark, ["a"]), broad))
    assert got == {("b", "class is not an outcome"), ("b", "class without a broad group"), ("z", "broad group of an unknown class"), ("unknown", "reserved name"), ("study", "fewer than two broad groups")}


def test_runs_resume_and_keep_every_case(spark, tmp_path):
    rows = scoring.requests(spark.createDataFrame([("synthetic", i) for i in range(6)], "data_class string, ordinal long"), ["ordinal"])
    memo, tried = str(tmp_path / "memo"), str(tmp_path / "tried")
    first = scoring.run(rows, lambda s: s, scoring.Budget(4, 10_000), memo, tried)
    assert first.count() == 4
    assert scoring.cohort(rows, first).where("failure = 'budget_not_run'").count() == 2
    assert scoring.run(rows, lambda s: s, scoring.Budget(4, 10_000), memo, tried).count() == 6
    arms = scoring.paired_arms(rows).orderBy("ordinal", "turn").select("arm").limit(4).collect()
    assert [r["arm"] for r in arms] == ["baseline", "candidate", "candidate", "baseline"]
    f = spark.createDataFrame([("m", "observed", "g"), ("m", "observed", "h"), ("n", "failed", "g")], "modality string, status string, group string")
    assert {(r["modality"], r["status"], r["n"]) for r in scoring.inventory(f).collect()} == {("m", "observed", 2), ("n", "failed", 1)}
    assert [r["group"] for r in scoring.observed_groups(f).collect()] == ["g", "h"]


def test_exports(spark):
    df = spark.createDataFrame([("a|b", 0.25, None), ("*c*", -0.5, "x")], "feature string, contribution double, note string")
    assert "a\\|b | 0.2500 |  |" in exports.markdown_table(df) and "More than 1 rows." in exports.markdown_table(df, 1)
    first = exports.attributions(df, "k", 0.1, 0.2).first()
    assert (first["feature"], first["percentage_points"]) == ("*c*", -50.0)
    assert exports.study_markdown({"t": df, "cox_unavailable": "no events", "d": {"t": df, "rows": df}}).count("\\*c\\*") == 2
    records = spark.createDataFrame([("s", 2, "s", "TP53", "resolved", "HGNC:1", "1", "measured", 1.0, ["HGNC:1"])], "sample_id string, record long, source_column string, original string, mapping string, gene string, raw string, status string, value double, candidates array<string>")
    assert len(exports.measurements(records, "tpm", "ab").columns) == 12


EVIDENCE = (
    "case_id string, schema_version int, age_lower_bound int, specimen_site string, metadata struct<patient_id:string,sample_id:string,institution_id:string,evidence_cutoff:string>, clinical string, "
    "findings array<struct<finding_id:string,value:string,source:struct<source_id:string,source_sha256:string,record:long,field:string>,observation:struct<status:string,units:string,assay:string,timepoint:string,reference_build:string>>>"
)


def test_evidence(spark):
    source, seen, meta = ("s1", "ab" * 32, 2, "value"), ("observed", None, "ihc", None, None), ("p", None, None, "2024")
    rows = [
        ("plain", 1, None, None, None, None, [("f", "v", None, None)]), ("two", 2, 89, "liver", meta, None, [("f", "v", source, seen)]), ("three", 3, None, None, meta, "context", []),
        ("old", 1, None, None, meta, None, [("f", "v", None, None)]), ("bare", 2, None, None, None, None, [("f", "v", None, None)]), ("no context", 3, None, None, meta, None, []), ("context", 2, None, None, meta, "c", []),
        ("bound", 2, 120, " ", ("bad id", None, None, "x\ny"), None, []), ("source", 2, None, None, meta, None, [("f", "v", ("s1", "zz", 0, ""), seen)]), ("seen", 2, None, None, meta, None, [("f", "v", source, ("observed", " ", None, None, None))]),
        ("tested", 2, None, None, meta, None, [("f", "v", source, ("not_tested", None, None, None, None))]), ("empty", 2, None, None, meta, None, [("f", " ", source, seen)]),
    ]
    got = problems(validation.evidence_problems(spark.createDataFrame(rows, EVIDENCE)))
    assert got == {
        ("old", "evidence metadata in schema 1"), ("bare", "schema without evidence metadata"), ("no context", "clinical context and schema disagree"), ("context", "clinical context and schema disagree"),
        *(("bound", p) for p in ("age bound out of range", "invalid specimen site", "invalid metadata id", "invalid evidence cutoff")), ("source", "invalid source"), ("seen", "invalid observation"),
        ("tested", "status against the recorded value"), ("empty", "finding value empty or too long"),
    }, got
    assert validation.evidence_problems(spark.createDataFrame([], EVIDENCE)).count() == 0


def test_absent_clinical_parts(spark):
    a, m = "struct<reviewer_id:string,recorded_on:string,source:string>", "struct<value:double,units:string,source:string,day:int>"
    schema = f"case_id string, assessment {a}, stage string, lineage string, features map<string,boolean>, investigations array<struct<kind:string,status:string,source:string,day:int,result:string,reason:string>>, ecog int, ldh {m}, albumin {m}, reviews array<struct<rule_id:string,ruleset_version:string,reason:string,basis_sha256:string,assessment:{a}>>"
    who = ("r", "2024-01-31", "notes")
    rows = [
        ("nothing", None, None, None, None, None, None, None, None, None), ("who", who, "muo", "unknown", {"x": None}, [("a", "pending", "s", None, None, None)], 0, (0.0, "u", "s", None), None, []),
        ("alone", None, None, None, {"x": True}, None, None, None, None, []), ("no result", who, None, None, None, [("a", "completed", "s", None, None, None)], None, None, None, None), ("no status", who, None, None, None, [("a", None, "s", None, "r", None)], None, None, (float("nan"), "u", "s", 1), None),
    ]
    got = problems(validation.clinical_problems(spark.createDataFrame(rows, schema)))
    assert got == {("alone", "assertions without an assessment"), ("no result", "invalid investigation"), ("no status", "invalid albumin")}, got
