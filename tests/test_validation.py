import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark import fixedvalues as fv
from tallymark.functions import geometry, vectors
from tallymark.functions.documents import document_key, stem
from tallymark.operators import provenance as pv
from tallymark.operators import reporting as rp
from tallymark.operators import validation as vd


def forgery(spark, *rows):
    return spark.createDataFrame(
        list(rows), "id string, label int, origin string, fabrication string, tamper string, mask_path string"
    )


def test_legacy_rows_then_rules(spark):
    df = pv.forgery_migrate_legacy(
        forgery(
            spark,
            ("old0", 0, "authentic", None, None, None),
            ("old1", 1, "script", None, "splice", "m"),
            ("infer", 1, "public_dataset", None, "splice", "m"),
            ("odd", 1, "elsewhere", None, "splice", "m"),
            ("wrong", 0, "public_dataset", "script", None, None),
            ("nomask", 1, "public_dataset", "manual", "splice", None),
        )
    )
    rows = {r.id: (r.origin, r.fabrication) for r in df.collect()}
    assert rows["old0"] == ("dev_fixture", "authentic")
    assert rows["old1"] == ("synthetic_generated", "script")
    assert rows["infer"] == ("public_dataset", "script")
    found = {(r.id, r.rule) for r in vd.forgery_row_rules(df).collect()}
    assert found == {("odd", "fabrication_missing"), ("wrong", "authentic_label_mismatch"), ("nomask", "mask_missing")}
    with pytest.raises(vd.ValidationError, match="wrong"):
        vd.require_clean(vd.forgery_row_rules(df.where("id = 'wrong'")), "manifest")


def test_trial_valid_needs_rows_and_only_field(spark):
    def valid(*origins):
        df = spark.createDataFrame([(o,) for o in origins], "origin string")
        return pv.trial_valid(df).first().trial_valid

    assert valid() is False
    assert valid("field_collected", " field_collected ") is True
    assert valid("field_collected", None) is False
    assert valid("field_collected", " ") is False
    assert valid("field_collected", "dev_fixture") is False


def test_severity_and_under_variation(spark):
    df = spark.createDataFrame([("public_dataset",), ("synthetic_generated",), (None,)], "origin string")
    assert pv.most_severe_origin(df).first().banner_origin == "public_dataset"
    assert pv.most_severe_origin(df.where("origin is null")).first().banner_origin is None
    assert pv.has_dev_fixture(df.limit(0)).first()[0] is False

    def flag(*rows):
        schema = "same boolean, capture_a string, capture_b string, pair_warning string"
        return pv.under_variation_flag(spark.createDataFrame(list(rows), schema)).first().under_variation

    assert flag((True, "scan", "photo", None)) and flag((False, None, None, "under_variation:x"))
    assert flag((True, "doc", "selfie", "single_image_augment_forbidden"))
    assert not flag((False, "scan", "photo", None), (True, "doc", "photo", None), (True, None, "photo", None))


def test_expected_counts_relaxed(spark):
    df = spark.createDataFrame([(0, "field_collected"), (1, "field_collected")], "label int, origin string")
    label = {"label_0": F.col("label") == 0}
    assert vd.expected_counts(df, {"total": 2, "label_0": 1}, label).count() == 0
    bad = vd.expected_counts(df, {"total": 3, "label_0": 1}, label).collect()
    assert [(r.name, r.expected, r.actual) for r in bad] == [("total", 3, 2)]
    mixed = df.withColumn("origin", F.lit("dev_fixture"))
    assert vd.expected_counts(mixed, {"total": 3}).count() == 0
    assert vd.expected_counts(df.limit(0), {"total": 3}).count() == 1


def test_responses_and_fatal(spark):
    rows = [("ok", {"score": "0.5"}), ("none", {"score": None}), ("text", {"score": "x"}), ("gone", {"a": "1"})]
    df = spark.createDataFrame(rows, "id string, response map<string,string>")
    found = {(r.id, r.rule) for r in vd.response_contract(df, [], "score").collect()}
    assert found == {("none", "null_value"), ("text", "not_numeric"), ("gone", "missing_score")}
    lenient = {(r.id, r.rule) for r in vd.response_contract(df, [], "score", nullable=True).collect()}
    assert lenient == {("text", "not_numeric"), ("gone", "missing_score")}
    with pytest.raises(vd.FatalRowsError, match="3 failed"):
        vd.abort_on_fatal(vd.response_contract(df, [], "score"), ["id"])
    vd.abort_on_fatal(df.limit(0), ["id"])


def test_endpoints_and_freeze(spark):
    seen = spark.createDataFrame([("ocr", "ocr"), ("face", "ocr"), ("forgery", None)], "name string, service string")
    out = {r.name: r.reason for r in vd.endpoint_identity_check(seen).collect()}
    assert out == {"ocr": None, "face": "wrong_service", "forgery": "wrong_service", "identity": "missing"}
    from tallymark.operators.fingerprint import freeze_record

    frozen = freeze_record(spark, "none", "d", {"face": None, "forgery": 0.87}, 42, "unknown", True)
    assert {r.rule for r in pv.freeze_strict_rules(frozen).collect()} == {"model_missing", "commit_unknown", "tree_dirty"}
    fine = freeze_record(spark, "abc", "d", {}, 42, "c0ffee", False)
    assert pv.freeze_strict_rules(fine).count() == 0


def test_check_digits(spark):
    # 236 with check digit 3 is the usual worked example.
    rows = [("2363", True), ("2364", False), ("0", True), ("12340", True), ("12341", False)]
    df = spark.createDataFrame(rows, "n string, want boolean")
    for r in df.withColumn("got", vd.check_digit_valid(F.col("n"))).collect():
        assert r.got == r.want, r
    every = spark.range(1000).select(F.format_string("%03d", "id").alias("n"))
    # Exactly one check digit fits each body.
    assert every.where(vd.check_digit_valid(F.col("n"))).count() == 100
    texts = spark.createDataFrame([("a 123456789012 b 1234567890123 c123456789013",)], "text string")
    assert vd.idnumber_checksum_scan(texts).first().candidates == 2


def test_quality_gate(spark):
    df = spark.createDataFrame(
        [(10.0, 10.0, -31.0, 26.0, "fullframe_fallback", 0.01), (50.0, 60.0, 0.0, 0.0, "fullframe_fallback", 0.2)],
        "face_side_px double, laplacian_var double, yaw_deg double, pitch_deg double, detect_source string, eye_distance_ratio double",
    )
    first, second = vd.quality_gate(df).collect()
    assert first.flags == ["face_too_small", "too_blurry", "yaw_out_of_range", "pitch_out_of_range", "fullframe_fallback"]
    assert not first.passed and second.passed and second.flags == ["fullframe_fallback"]
    first, second = vd.quality_gate(df, eye_variant=True).collect()
    assert "eye_distance_too_small" in first.flags and second.flags == [] and second.passed


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0]), ([1.0], None)], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine_unit(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.5, 0.0, None]
    one = spark.createDataFrame([("", "x"), ("a", "b"), ("", "")], "a string, b string")
    assert [r[0] for r in one.select(vectors.missing_reason(F.col("a"), F.col("b"))).collect()] == ["x", "a;b", "no_face_detected"]
    urls = spark.createDataFrame([("data:image/png;base64,aGk=",), ("aGk=",), ("***",)], "u string")
    assert [r[0] and bytes(r[0]) for r in urls.select(vectors.decode_data_url(F.col("u"))).collect()] == [b"hi", b"hi", None]


def test_geometry(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 4.0], [2.0, 4.0]],)], "m array<array<double>>")
    row = df.select(geometry.yaw_deg(F.col("m")).alias("y"), geometry.pitch_deg(F.col("m")).alias("p")).first()
    assert row.y == pytest.approx(30.0, abs=1e-3) and row.p == pytest.approx(8.0, abs=1e-3)
    quads = spark.createDataFrame([([[3.0, 1.0], [0.0, 5.0]],), ([[1.0, 1.0]],)], "q array<array<double>>")
    assert [r[0] for r in quads.select(geometry.quad_to_box(F.col("q"))).collect()] == [[0.0, 1.0, 3.0, 5.0], None]


def test_document_key(spark):
    rows = [
        ("x/authentic/auth_0007.jpg", None, None, "auth_0007"),
        ("img/fg_train_v2_easy_0044.png", None, None, "0044"),
        ("img/fg_auth_0042.png", "", 1, "auth_0042"),
        ("img/fg_0001.png", "auth_0009.jpg", 1, "auth_0009"),
        ("img/a.b.png", "midv2020", 0, "a.b"),
        ("img/none.png", None, 1, None),
    ]
    df = spark.createDataFrame(rows, "path string, source string, label int, want string")
    for r in df.withColumn("got", document_key(F.col("path"), F.col("source"), F.col("label"))).collect():
        assert r.got == r.want, r
    assert spark.range(1).select(stem(F.lit("a/.hidden"))).first()[0] == ".hidden"


def test_latency_summary_of_nothing_passes(spark):
    df = spark.createDataFrame([], "elapsed_ms double, success boolean")
    out = rp.latency_summary(df).first()
    assert (out.n, out.mean_seconds, out.passed) == (0, 0.0, True)


@pytest.mark.parametrize("values", [[1.0] * 9, [0.1 * i for i in range(37)], [0.0, 0.3, 0.3, 0.6, 0.9, 1.0], [5.0]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = rp.score_histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=min(20, max(5, len(values))))
    assert [r.n for r in got] == counts.tolist()
    assert [r.lo for r in got] + [got[-1].hi] == pytest.approx(edges.tolist())
    assert rp.score_histogram(df.limit(0), "v").count() == 0


def test_ablation(spark):
    df = spark.createDataFrame([("none", 0.2), ("a", 0.2 - 5e-7), ("b", 0.1), ("c", None)], "ablation string, cer_field double")
    out = {r.ablation: r.decision for r in rp.ablation_vs_baseline(df).collect()}
    assert out == {"a": "drop", "b": "keep", "c": "drop"}
    assert rp.ablation_vs_baseline(df.where("ablation <> 'none'")).count() == 0


def test_gate_summary_na(spark):
    cer = spark.createDataFrame([(0.21,)], "cer_field double")
    faces = spark.createDataFrame([(0.9, 0.9, False)], "sensitivity double, accuracy double, infeasible boolean")
    rows = {r.metric: (r.value, r.status) for r in rp.gate_summary(spark, cer=cer, faces=faces).collect()}
    assert rows["cer"] == (0.21, "FAIL") and rows["tpr"] == (None, "N/A")
    assert rows["accuracy"] == (0.9, "PASS") and rows["seconds"][1] == "N/A"


def test_fixed_tables_are_small():
    assert len(fv.SCRIPT_BY_PREFIX) == 10 and not math.isnan(fv.TARGETS["cer_max"])
