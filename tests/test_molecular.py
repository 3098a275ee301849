import pytest
from pyspark.sql import functions as F

from cohortloom.operators import attribution, molecular
from cohortloom.operators.bootstrap import MASK, draws, indexes, passed_over

FEATURES = "sample_id string, patient_group_id string, data_class string, id string, name string, modality string, kind string, status string, group string, number double, somatic boolean, is_bound boolean"


def features(spark):
    rows = [
        ("s1", "p1", "synthetic", "v1", "TP53", "variant", "mutation", "observed", "g1", None, True, None), ("s1", "p1", "synthetic", "v2", "KRAS", "variant", "mutation", "observed", "g2", None, None, None), ("s1", "p1", "synthetic", "c1", "MYC", "copy number", "copy_number", "observed", "g2", 2.0, None, None),
        ("s1", "p1", "synthetic", "a1", "age", "clinical", "age", "observed", "g3", 89.0, None, True), ("s2", "p2", "real", "c1", "MYC", "copy number", "copy_number", "withheld", "g1", -2.0, None, None), ("s2", "p2", "real", "v9", "BRAF", "variant", "mutation", "not_tested", "g5", None, False, None),
    ]
    return spark.createDataFrame(rows, FEATURES)


def test_gate_merges_low_and_ambiguous(spark):
    df = spark.createDataFrame([("live", "named", 0.8, 0.3, 0.9, 0.1), ("live", "named", 0.5, 0.1, 0.9, 0.1), ("demo", "other", 0.8, 0.3, 0.7, 0.3)], "source string, predicted_kind string, p_top double, margin double, support double, conflict double")
    got = [(r["reasons"], r["status"]) for r in molecular.gate(df).collect()]
    assert got == [([], "review_required"), (["low_or_ambiguous"], "abstained"), (["not_live", "unresolved_class", "insufficient_support", "conflicting_evidence"], "abstained")]


def test_evidence_holds_what_is_named(spark):
    df = spark.createDataFrame([("c", "patient", 60, "label", [("f", "k", "n", "v", "where it is from")])], "case_id string, patient_id string, age_years int, known_primary string, findings array<struct<finding_id:string,kind:string,name:string,value:string,source:string>>")
    r = molecular.evidence(df).select(F.to_json("evidence").alias("j")).first()["j"]
    assert "patient" not in r and "label" not in r and "where it is from" not in r and '"age_years":60' in r and '"value":"v"' in r


def test_meaning_of_what_is_observed(spark):
    got = {(r["sample_id"], r["id"]): r["meaning"] for r in molecular.with_meaning(features(spark)).collect()}
    assert got == {("s1", "v1"): "somatic as annotated", ("s1", "v2"): "origin not resolved", ("s1", "c1"): "amplification", ("s1", "a1"): "older than the stated years", ("s2", "c1"): None, ("s2", "v9"): None}


def test_readiness_and_window(spark):
    got = {r["sample_id"]: r for r in molecular.readiness(features(spark), spark.createDataFrame([("s1", "x" * 100)], "sample_id string, request string")).collect()}
    assert (got["s1"]["features"], got["s1"]["observed"], got["s1"]["request_bytes"], got["s1"]["ready"]) == (4, 4, 100, True)
    assert got["s2"]["blockers"] == ["no_request", "not_synthetic", "nothing_observed"] and got["s2"]["unavailable"] == 2
    df = spark.createDataFrame([(4 * 64_000, 0, 0), (4 * 64_000 + 1, 0, 0), (10, 4 * 31_000, 4000), (10, 4 * 31_000, 4001)], "r int, s int, q int")
    text = lambda c: F.repeat(F.lit("x"), F.col(c))
    assert [r[0] for r in df.select(molecular.context_problem(text("r"), text("s"), text("q"))).collect()] == [None, "request_exceeds_window", None, "state_and_question_exceed_window"]


def test_merge_and_attach(spark):
    f = features(spark).where("sample_id = 's1'")
    both = molecular.merged([f.where("kind = 'mutation'"), f.where("kind <> 'mutation'").drop("somatic")])
    assert both.count() == 4 and set(both.columns) == set(f.columns)
    with pytest.raises(Exception, match="the sets differ"):
        molecular.merged([f, f.withColumn("patient_group_id", F.lit("p9"))]).count()
    with pytest.raises(Exception, match="the sets differ"):
        molecular.merged([f, features(spark)]).count()
    compared = spark.createDataFrame([("s1", "b", 0.5, "compared"), ("s1", "a", 0.7, "compared"), ("s1", "z", None, "insufficient_data"), ("s2", "a", None, "incompatible")], "sample_id string, class_id string, r double, status string")
    got = {r["sample_id"]: r for r in molecular.attached_comparison(features(spark), compared, "ab").where("kind = 'vector'").collect()}
    assert got["s1"]["vector"] == {"a": 0.7, "b": 0.5} and got["s1"]["status"] == "observed" and got["s2"]["vector"] is None and got["s2"]["status"] == "not_available"
    fit = spark.createDataFrame([("s1", "S1", 12.0, True), ("s1", "S2", 3.0, True)], "sample_id string, signature string, exposure double, converged boolean")
    rows = {r["id"]: r for r in molecular.attached_signatures(features(spark).where("sample_id = 's1'"), fit).collect()}
    assert {k for k, r in rows.items() if r["group"] == molecular.DERIVED_GROUP} == {"v1", "v2", "c1", "derived-S1", "derived-S2"} and rows["derived-S1"]["depends"] == ["v1", "v2"] and rows["derived-S2"]["number"] == 3.0
    with pytest.raises(Exception, match="a fit without"):
        molecular.attached_signatures(features(spark), fit.withColumn("converged", F.lit(False))).collect()
    names = spark.createDataFrame([("a", "Alpha", "top")], "class_id string, name string, parent string")
    assert [(r["class_id"], r["class_name"], r["class_parent"]) for r in molecular.labelled(compared.where("sample_id = 's1'"), names).select("class_id", "class_name", "class_parent").orderBy("class_id").collect()] == [("a", "Alpha", "top"), ("b", None, None), ("z", None, None)]


def test_hybrids_and_other_targets(spark):
    query = spark.createDataFrame([("x", 0, 1.0), ("y", 1, 2.0), ("z", 1, 3.0)], "feature_id string, bit int, value double")
    background = spark.createDataFrame([(b, f, -10.0 * b) for b in (1, 2) for f in "xyz"], "background_id long, feature_id string, value double")
    got = {(r["mask"], r["background_id"], r["feature_id"]): r["value"] for r in attribution.hybrids(attribution.coalitions(spark, 2), query, background).collect()}
    assert len(got) == 4 * 2 * 3 and got[0, 1, "x"] == -10.0 and got[1, 2, "x"] == 1.0 and got[1, 2, "z"] == -20.0 and got[3, 1, "z"] == 3.0
    linear = [(m, {"a": 0.1 + 0.2 * (m & 1) + 0.3 * (m >> 1), "b": 0.9 - 0.2 * (m & 1) - 0.3 * (m >> 1)}) for m in range(4)]
    memo = spark.createDataFrame(linear, "mask long, probabilities map<string,double>")
    for target, sign in (("a", 1), ("b", -1)):
        values = attribution.retargeted(memo, target)
        c = {r["feature"]: round(r["contribution"], 9) for r in attribution.exact(values, ["x", "y"]).collect()}
        assert c == {"x": 0.2 * sign, "y": 0.3 * sign}
    with pytest.raises(Exception, match="lacks the class"):
        attribution.retargeted(memo, "c").collect()


def test_more_groups_than_a_mask_holds(spark):
    p = attribution.permutation_prefixes(spark, 70, 3)
    keys = p.select(F.explode(F.array("before", "after")).alias("mask")).distinct()
    w = [0.01 * (k + 1) for k in range(70)]
    values = keys.withColumn("value", F.aggregate(F.filter(F.split("mask", ","), lambda x: x != ""), F.lit(0.0), lambda a, x: a + 0.01 * (x.cast("int") + 1)))
    got = {r["feature"]: r["contribution"] for r in attribution.sampled(p, values, [f"f{k}" for k in range(70)]).collect()}
    assert len(got) == 70 and all(abs(got[f"f{k}"] - w[k]) < 1e-9 for k in range(70))
    with pytest.raises(ValueError):
        attribution.permutation_prefixes(spark, 513, 1)


def test_figure_rows_ring_and_unlike_features(spark):
    c = spark.createDataFrame([(f"f{k:02}", "m" if k % 2 else "n", 1.0 - k / 20) for k in range(15)], "feature string, modality string, contribution double")
    ranked = attribution.by_magnitude(c)
    shown = lambda s: sorted(r["feature"] for r in attribution.figure_rows(ranked, s).collect())
    first = [f"f{k:02}" for k in range(10)]
    assert shown(None) == shown("f03") == shown("none") == first and shown("f12") == [*first[:9], "f12"]
    assert [r["feature"] for r in attribution.ring_order(c).orderBy("ring").collect()][:7] == [f"f{k:02}" for k in range(1, 15, 2)]
    with pytest.raises(Exception, match="of other features"):
        attribution.stability(c, c.where("feature <> 'f01'")).collect()


def test_mid_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), (None, 2.0), (None, 1.0)], "g string, v double")
    got = sorted((r["g"] or "", r["v"] or 0.0, r["mid_rank"]) for r in attribution.mid_ranks(df, ["g"], "v").collect())
    assert got == [("", 1.0, 0.0), ("", 2.0, 1.0), ("a", 0.0, 0.0), ("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", 3.0, 2.5), ("b", 5.0, 0.0)]


def test_draws_that_are_passed_over():
    """With a bound that passes over about half of all draws, indexes are those of a loop that draws again."""
    of = (1 << 63) + 11
    bound, want, at = MASK - MASK % of, [], 0
    while len(want) < 500:
        v = int(draws(7, at, 1)[0])
        at += 1
        if v < bound:
            want.append(v % of)
    skipped = passed_over(7, 500, of, block=64)
    assert len(skipped) > 100
    got = [int(x) for start in range(0, 500, 50) for x in indexes(7, start, 50, of, skipped).view("uint64")]
    assert got == want and passed_over(42, 100_000, 1000) == []


def test_backgrounds_that_can_stand_in(spark):
    kind = "sample_id string, patient_group_id string, data_class string, id string, name string, `group` string, status string, encoding string, value double"
    row = lambda s, p, i, d="synthetic", e="n": (s, p, d, i, i, "g", "observed", e, 1.0)
    query = spark.createDataFrame([row("q", "p0", "x"), row("q", "p0", "y")], kind)
    good = [row("a", "p1", "x"), row("a", "p1", "y"), row("b", "p2", "x"), row("b", "p2", "y")]
    problems = lambda rows, part="development", name="r1": {(r["sample_id"], r["problem"]) for r in molecular.background_problems(query, spark.createDataFrame(rows, kind), part, name).collect()}
    assert problems(good) == set()
    assert problems(good, "test") == problems(good, name=" ") == {(None, "not a named release of the development partition")}
    assert problems([row("a", "p0", "x"), row("a", "p0", "y")]) == {("a", "patient of the query")}
    assert problems([row("a", "p1", "x", "real"), row("a", "p1", "z", "real")]) == {("a", "another data class"), ("a", "feature ids differ")}
    assert problems([*good, row("c", "p2", "x", e="m"), row("c", "p2", "y")]) == {("b", "patient listed twice"), ("c", "patient listed twice"), ("c", "features differ in what must be the same")}
    assert problems([row(f"s{k}", f"p{k + 1}", i) for k in range(65) for i in "xy"]) == {(None, "not 1 to 64 samples")}


def test_documents_for_readers(spark):
    import json

    from cohortloom.sources import exports

    assert exports.escaped_xml("a<b & 'c'\x00\x0b\ufffe>\"") == "a&lt;b &amp; &apos;c&apos;&gt;&quot;"
    df = spark.createDataFrame([("x", 0.5)], "c string, v double")
    assert json.loads(exports.report_json({"t": df, "d": {"u": df, "why": "none"}})) == {"t": [{"c": "x", "v": 0.5}], "d": {"u": [{"c": "x", "v": 0.5}], "why": "none"}}
    with pytest.raises(ValueError, match="more than 2 rows"):
        exports.report_json({"t": spark.range(3)}, 2)
