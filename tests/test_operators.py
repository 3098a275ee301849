import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import text
from cohortloom.operators import attribution, cases, expression, rules, scoring, spectra


def test_strict_text(spark):
    values = ["1d", "0x1", ".", "1e3", ".5", "1.", "abc", " 7", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(text.strict_double(F.col("v"))).collect()]
    assert got == [None, None, None, 1000.0, 0.5, 1.0, None, None, None]
    one = spark.createDataFrame([(">89", "2024-02-30", "2024-02-29", "a b", "Pos", "x" * 9)], "a string, d string, e string, i string, c string, t string")
    r = one.select(text.age(F.col("a")).alias("a"), text.strict_date(F.col("d")).alias("d"), text.strict_date(F.col("e")).alias("e"), text.is_id(F.col("i")).alias("i"), text.category(F.col("c")).alias("c"), text.token_estimate(F.col("t")).alias("t")).first()
    assert r["a"]["lower_bound_exclusive"] == 89 and r["a"]["years"] is None and r["d"] is None and str(r["e"]) == "2024-02-29" and not r["i"] and r["c"] == "positive" and r["t"] == 3


def test_quality_control(spark):
    df = spark.createDataFrame([("s", i + 2, f"g{i}", v) for i, v in enumerate(["0", "NA", "NaN", "inf", "-1", ""])], "sample_id string, record long, original string, raw string")
    rows = expression.measured(df).withColumn("mapping", F.lit("resolved")).withColumn("gene", F.col("original"))
    q = expression.quality_control(rows).first()
    assert (q["measured"], q["zero"], q["missing"], q["invalid"], q["qc"]) == (1, 1, 2, 3, "blocked")
    got = [r["value"] for r in expression.measured(spark.createDataFrame([("0",), ("3",), ("7",)], "raw string"), log=True).orderBy("value").collect()]
    assert np.allclose(got, [0, 2, 3])


def test_gene_resolution(spark):
    table = spark.createDataFrame(
        [("HGNC:1", "TP53", "Approved", "ENSG01", "7157", "P53|shared", ""), ("HGNC:2", "KRAS", "Approved", "ENSG02", "3845", "shared|TP53", "OLD"), ("HGNC:3", "GONE", "Withdrawn", None, None, "", "")],
        "hgnc_id string, symbol string, status string, ensembl_gene_id string, entrez_id string, alias_symbol string, prev_symbol string",
    )
    keys = expression.dictionary(table)
    asked = spark.createDataFrame([(x,) for x in ["tp53", "Shared", "ENSG02.7", "3845", "old", "gone", "HGNC:1"]], "original string")
    got = {r["original"]: (r["status"], r["gene"], len(r["candidates"])) for r in expression.resolved(asked, keys).collect()}
    assert got == {
        "tp53": ("resolved", "HGNC:1", 1), "Shared": ("ambiguous", None, 2), "ENSG02.7": ("resolved", "HGNC:2", 1), "3845": ("resolved", "HGNC:2", 1), "old": ("resolved", "HGNC:2", 1), "gone": ("unmapped", None, 0), "HGNC:1": ("resolved", "HGNC:1", 1),
    }


def test_pearson(spark):
    rows = [("a", x, y) for x, y in ((1, 30), (2, 20), (3, 10))] + [("b", 1, y) for y in (1, 2, 3)] + [("c", x * 1e300, -x * 1e300) for x in (1, 2, 3)] + [("d", 1, 2), ("d", 2, 3)]
    df = spark.createDataFrame([(g, float(x), float(y)) for g, x, y in rows], "g string, x double, y double")
    got = {r["g"]: r["r"] for r in expression.pearson(df, ["g"]).collect()}
    assert abs(got["a"] + 1) < 1e-12 and got["b"] is None and abs(got["c"] + 1) < 1e-12 and got["d"] is None


def test_reference_gates(spark):
    ref = spark.createDataFrame([("k", f"g{i}", float(i)) for i in range(6)], "class_id string, gene string, mean double")
    q = spark.createDataFrame([("full", f"g{i}", float(i)) for i in range(6)] + [("thin", "g0", 1.0), ("flat", "g1", 2.0), ("flat", "g2", 2.0), ("flat", "g3", 2.0)], "sample_id string, gene string, value double")
    got = {r["sample_id"]: r["status"] for r in expression.compare(q, ref, blocked=spark.createDataFrame([("none",)], "sample_id string")).collect()}
    assert got == {"full": "compared", "thin": "insufficient_data", "flat": "undefined_similarity"}
    a = spark.createDataFrame([("s1", "h1", "p1"), ("s2", "h2", "p2")], "sample_id string, measurement_sha256 string, patient_group_id string")
    b = spark.createDataFrame([("s9", "h1", "p9"), ("s8", "h8", "p2")], "sample_id string, measurement_sha256 string, patient_group_id string")
    assert {(r[0], r[1]) for r in expression.overlapping(a, b).collect()} == {("s1", "measurement_sha256"), ("s2", "patient_group_id")}
    labels = spark.createDataFrame([("s1", "k"), ("s1", "k"), ("s7", "k")], "sample_id string, class_id string")
    assert {r["problem"] for r in expression.label_problems(labels, a).collect()} == {"duplicate label", "no label", "no sample"}


def test_spectrum(spark):
    df = spark.createDataFrame([("s", "1", 5, "C", "A", "ACA", True, "GRCh38"), ("s", "1", 6, "G", "T", "TGT", True, "GRCh38"), ("s", "1", 7, "C", "A", "ACA", False, "GRCh38")], "sample_id string, chromosome string, position long, reference string, alternate string, context string, somatic boolean, build string")
    got = spectra.spectrum(df)
    assert got.count() == 96 and {(r["number"], r["n"]) for r in got.where("n > 0").collect()} == {(0, 2)}
    assert spectra.CHANNELS[0] == "A[C>A]A" and len(set(spectra.CHANNELS)) == 96
    assert {r["problem"] for r in spectra.variant_problems(df.unionAll(df), "GRCh37").collect()} == {"duplicate variant", "another build"}
    chunks = spark.createDataFrame([("1", 0, "NACGTA"), ("1", 1, "TACC")], "chromosome string, chunk long, sequence string")
    at = spark.createDataFrame([("1", 2), ("1", 4)], "chromosome string, position long")
    assert {r["position"]: r["context"] for r in spectra.with_context(at, chunks, 4).collect()} == {2: "ACG", 4: "GTA"}


def test_refit(spark):
    counts = [30 if c.startswith("A[C>A]A") else 70 if c.startswith("A[C>A]C") else 0 for c in spectra.CHANNELS]
    s = spark.createDataFrame([("s", c, i, n) for i, (c, n) in enumerate(zip(spectra.CHANNELS, counts))], "sample_id string, channel string, number int, n long")
    cat = spark.createDataFrame([(k, c, float(i == j)) for j, k in enumerate(("A", "B")) for i, c in enumerate(spectra.CHANNELS)], "signature string, channel string, weight double")
    got = {r["signature"]: (r["exposure"], r["cosine"]) for r in spectra.refit(s, cat).collect()}
    assert abs(got["A"][0] - 30) < 1e-6 and abs(got["B"][0] - 70) < 1e-6 and abs(got["A"][1] - 1) < 1e-9
    assert spectra.catalogue_problems(cat).count() == 0
    rng = np.random.default_rng(3)
    m, y = rng.random((96, 6)), rng.random((40, 96)) * 50
    x, made, took, done = spectra.nnls(m, y)
    g = (made - y) @ m
    # The descent ends when no exposure moves by 1e-9 of the total, so a gradient is at most that times the matrix of products.
    slack = (np.abs(m.T @ m).sum(axis=0) * spectra.CHANGE)[None, :] * y.sum(axis=1)[:, None]
    assert done.all() and (took > 1).all() and (x >= 0).all() and (g > -slack).all() and (np.abs(g)[x > 0] <= slack[x > 0]).all()
    assert all(np.allclose(spectra.nnls(m, y[i : i + 1])[0][0], x[i]) for i in (0, 7, 39))
    assert not spectra.nnls(m, y, sweeps=1)[3].any()


def test_refit_says_whether_it_converged_and_refuses_bad_catalogues(spark):
    s = spark.createDataFrame([(k, c, i, i % (k + 3)) for k in range(3) for i, c in enumerate(spectra.CHANNELS)], "sample_id long, channel string, number int, n long")
    cat = spark.createDataFrame([(k, c, ((i * (j + 2)) % 7) / sum((x * (j + 2)) % 7 for x in range(96))) for j, k in enumerate(("A", "B")) for i, c in enumerate(spectra.CHANNELS)], "signature string, channel string, weight double")
    got = spectra.refit(s, cat).collect()
    assert len(got) == 6 and all(r["converged"] and 0 <= r["relative_residual"] < 1 and r["iterations"] > 0 and r["mutations"] >= 50 for r in got)
    with pytest.raises(ValueError, match="96 channels"):
        spectra.refit(s, cat.where("channel <> 'A[C>A]A' or signature = 'A'"))
    with pytest.raises(ValueError, match="sum to one"):
        spectra.refit(s, cat.withColumn("weight", cat.weight * 2))
    assert spectra.refit(s.limit(0), cat).count() == 0


def test_exact_attribution(spark):
    def v(m):
        x, y = m & 1, m >> 1 & 1
        return 0.1 + 0.2 * x + 0.3 * y + 0.2 * x * y

    values = attribution.coalitions(spark, 3).collect()
    table = spark.createDataFrame([(r["mask"], v(r["mask"])) for r in values], "mask long, value double")
    got = {r["feature"]: r["contribution"] for r in attribution.exact(table, ["x", "y", "dummy"]).collect()}
    assert np.allclose([got["x"], got["y"], got["dummy"]], [0.3, 0.4, 0.0])
    a = attribution.additivity(table, attribution.exact(table, ["x", "y", "dummy"]), 3).first()
    assert abs(a["residual"]) < 1e-12 and abs(a["full"] - 0.8) < 1e-12
    s = {r["feature"]: r["contribution"] for r in attribution.sampled(attribution.permutation_prefixes(spark, 3, 6), table, ["x", "y", "dummy"]).collect()}
    assert abs(sum(s.values()) - 0.7) < 1e-12 and abs(s["dummy"]) < 1e-12
    st = attribution.stability(attribution.exact(table, ["x", "y", "dummy"]), attribution.exact(table, ["x", "y", "dummy"]), 2).first()
    assert st["rmse"] == 0 and abs(st["spearman"] - 1) < 1e-12 and st["top_k_overlap"] == 1
    assert attribution.plan_size(3) == 8 and attribution.plan_size(3, 2) == 16


def test_background_and_linear_scorer(spark):
    hybrids = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.3), (1, 1, 0.35), (1, 2, 0.35), (2, 1, 0.65), (2, 2, 0.65), (3, 1, 0.8), (3, 2, 0.8)], "mask long, background_id long, value double")
    got = {r["feature"]: r["contribution"] for r in attribution.exact(attribution.background_values(hybrids), ["x", "y"]).collect()}
    assert np.allclose([got["x"], got["y"]], [0.15, 0.45])
    f = spark.createDataFrame([(0, "signature", 0.5), (1, "mutation", None), (2, "copy_number", 2.0)], "bit int, kind string, amount double")
    shown = attribution.masked_features(spark.createDataFrame([(5,), (2,)], "mask long"), f)
    assert {r["mask"]: round(r["value"], 6) for r in attribution.linear_scores(shown).collect()} == {5: 0.19, 2: 0.155}


def test_cases(spark):
    df = spark.createDataFrame(
        [(2, "c1", "p1", "s1", "f1", "n", "v"), (3, "c1", "p1", "s1", "f1", "n", "v"), (4, "c2", "p1", "s2", "f1", "", "v"), (5, "c3", "p1", "s3", "f1", "n", "v"), (6, "c4", "p2", "s3", "f1", "n", "v"), (7, "c5", "p3", "s5", "f1", "n", "v"), (8, "c6", "p3", "s6", "f1", "n", "v"), (9, "c6", "p4", "s6", "f2", "n", "v"), (10, "c 7", "p", "s7", "f", "n", "v")],
        "record long, case_id string, patient_id string, sample_id string, finding_id string, name string, value string",
    )
    assert [r["case_id"] for r in cases.assembled(df).collect()] == ["c5"]
    assert {r["issue"] for r in cases.issues(df).collect()} == {"duplicate_finding", "missing_name", "shared_sample", "conflicting_metadata", "invalid_case_id"}
    m = cases.migrated(cases.assembled(df).withColumn("record", F.lit(7)), "ab").first()
    assert m["schema_version"] == 2 and m["findings"][0]["status"] == "observed"
    assert cases.shown_issues(cases.issues(df)).first()["record"] == 3
    s = {r["patient_id"]: r["partition"] for r in cases.split(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), (None, "x")], "patient_id string, inst string"), holdout="x", institution="inst").collect()}
    assert s["a"] == "test" and s[None] == "unassigned"


def test_kleene_rules(spark):
    df = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    for r in df.select("a", "b", rules.all_of(F.col("a"), F.col("b")).alias("all"), rules.any_of(F.col("a"), F.col("b")).alias("any")).collect():
        v = [r["a"], r["b"]]
        assert r["all"] == (False if False in v else None if None in v else True)
        assert r["any"] == (True if True in v else None if None in v else False)


def test_reviews_go_stale(spark):
    items = spark.createDataFrame([("c", "r1", "b1"), ("c", "r2", "b1")], "case_id string, rule_id string, basis_sha256 string")
    log = spark.createDataFrame([("c", "r1", 1, "dismiss", "b0", "v1"), ("c", "r1", 2, "accept", "b1", "v1"), ("c", "r2", 1, "accept", "b0", "v1")], "case_id string, rule_id string, position long, action string, basis_sha256 string, ruleset_version string")
    got = {r["rule_id"]: (r["review"], r["review_current"]) for r in rules.with_reviews(items, log, "v1").collect()}
    assert got == {"r1": ("accept", True), "r2": ("accept", False)}
    assert not rules.with_reviews(items, log, "v2").where("review_current").count()


def test_scoring_memo_and_budget(spark):
    df = scoring.requests(spark.createDataFrame([("synthetic", i % 5) for i in range(20)], "data_class string, x long"), ["x"])
    memo = scoring.score(scoring.to_score(df.where("x = 0"), spark.createDataFrame([], "request_sha256 string, response string")), lambda s: s.str.len().astype(str))
    todo = scoring.to_score(scoring.synthetic_only(df), memo)
    assert todo.count() == 4 and memo.count() == 1
    sent, rest = scoring.within_budget(todo, scoring.Budget(3, 100))
    assert sent.count() == 3 and rest.count() == 1
    assert scoring.uncertain(sent, memo).count() == 3
    with pytest.raises(Exception, match="synthetic"):
        scoring.synthetic_only(df.withColumn("data_class", F.lit("real"))).count()
    r = spark.createDataFrame([("m", "m", {"a": 0.6, "b": 0.4}, "a"), ("m", "m", {"a": 0.6, "b": 0.4}, "b"), ("m", "x", {"a": 1.0}, "a"), ("m", "m", {"a": 0.9, "b": 0.4}, "a"), ("m", "m", None, "a")], "model string, expected_model string, probabilities map<string,double>, choice string")
    got = [x["problem"] for x in scoring.offline(r, F.array(F.lit("a"), F.lit("b"))).collect()]
    assert got == [None, "choice_is_not_a_maximum", "wrong_model", "sum_is_not_one", "no_probabilities"]
    slots = scoring.masked(spark.createDataFrame([("s", "f2", "observed", "v", "g2"), ("s", "f1", "observed", "w", "g1")], "sample_id string, feature_id string, status string, value string, group string"), F.array(F.lit("g1"))).orderBy("slot").collect()
    assert [(x["feature_id"], x["status"]) for x in slots] == [("f1", "observed"), (None, "withheld")]


TOY_RULES = [
    ("wash", "flag.muddy", "soap", True, False, None), ("weigh", "kilos IS NULL OR kilos > 20", None, None, None, None), ("groom", "flag.long_hair AND NOT flag.asleep", "comb", True, True, "flag.owner_agrees"),
]


def toy(spark, flags, found=(), kilos=10, in_scope=True, managed=True, basis=True):
    table = spark.createDataFrame(TOY_RULES, "rule_id string, when string, target string, investigation boolean, restricted boolean, discussion string")
    loaded = rules.load(table)
    df = spark.createDataFrame([("c", kilos, flags, list(found), in_scope, managed, basis)], "case_id string, kilos int, flags map<string,boolean>, investigations array<struct<kind:string,status:string>>, in_scope boolean, managed boolean, stage_basis boolean")
    return {r["rule_id"]: r["status"] for r in rules.evaluate(rules.with_flags(df, loaded), loaded).collect()}


def test_rules_of_a_table(spark):
    assert toy(spark, {"muddy": True}) == {"wash": "needs_review", "weigh": "not_applicable", "groom": "insufficient_information"}
    assert toy(spark, {"muddy": True, "long_hair": False}, [("soap", "completed"), ("comb", "planned")]) == {"wash": "recorded", "weigh": "not_applicable", "groom": "conflict"}
    assert toy(spark, {"muddy": True}, [("soap", "declined")], kilos=30)["weigh"] == "needs_review"
    assert toy(spark, {"muddy": True}, managed=False)["wash"] == "blocked" and toy(spark, {"muddy": True}, [("soap", "pending")])["wash"] == "pending"
    assert toy(spark, {"muddy": True}, basis=None)["wash"] == "insufficient_information"
    full = {"muddy": None, "long_hair": True, "asleep": False}
    assert [toy(spark, full | {"owner_agrees": x})["groom"] for x in (True, False, None)] == ["needs_review", "needs_review", "insufficient_information"]
    assert set(toy(spark, {"muddy": True}, in_scope=False).values()) == {"not_applicable"}
    for bad in ([("a", "true"), ("a", "false")], [(None, "true")], [("a", None)]):
        with pytest.raises(ValueError):
            rules.load(spark.createDataFrame(bad, "rule_id string, when string"))


def test_stage_basis(spark):
    rows = [("muo", "carcinoma", None, None, None, None, None), ("confirmed_cup", "carcinoma", True, None, True, True, True), ("confirmed_cup", "carcinoma", None, True, True, True, True), ("provisional_cup", "unknown", True, None, True, None, None), ("provisional_cup", "lymphoma", True, None, True, None, None)]
    names = ("histology_confirmed", "cytology_confirmed", "initial_workup_complete", "specialist_review_complete", "further_investigations_complete")
    df = spark.createDataFrame(rows, "stage string, lineage string, " + ", ".join(f"{n} boolean" for n in names))
    assert [r[0] for r in df.select(rules.stage_basis()).collect()] == [True, True, None, None, False]


def test_reviews_are_appended(spark):
    log = spark.createDataFrame([("c", "r1", 1, "dismiss", "b0", "v1")], "case_id string, rule_id string, position long, action string, basis_sha256 string, ruleset_version string")
    new = spark.createDataFrame([("c", "r1", "accept", "b1", "v1"), ("d", "r1", "accept", "b0", "v1")], "case_id string, rule_id string, action string, basis_sha256 string, ruleset_version string")
    got = {(r["case_id"], r["position"], r["action"]) for r in rules.appended(log, new).collect()}
    assert got == {("c", 1, "dismiss"), ("c", 2, "accept"), ("d", 1, "accept")}


def test_context_items(spark):
    df = spark.createDataFrame([("c", True, None), ("d", False, True), ("e", None, False), ("f", True, False)], "case_id string, open boolean, done boolean")
    got = {(r["case_id"], r["item"]): r["status"] for r in rules.context(df, [rules.Item("task", "done", "open", "late"), rules.Item("note", always="information")]).collect()}
    assert [got[c, "task"] for c in "cdef"] == ["insufficient_information", "not_applicable", "insufficient_information", "late"] and got["d", "note"] == "information"
