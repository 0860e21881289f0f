"""Whole evaluations: scope, samples, voided runs, and the shape of heavy plans."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import ranking, splits
from tallymark.operators.cer import EmptyScopeError
from tallymark.operators.fingerprint import dataset_fingerprint
from tallymark.operators.validation import FatalRowsError, complete_scores, fatal_report, unscored
from tallymark.plans import evaluations


def records(spark, n=12):
    rows = [
        (f"{('scan', 'photo', 'other')[i % 3]}_{i}", i, ("alb_id", "rus_x")[i % 2], None, {"a": "abcd"}, "public_dataset", {"a": "abcd" if i % 4 else "abxx"}, "")
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows,
        "id string, row_index long, doc_type string, script string, gt_fields map<string,string>, origin string,"
        " hyp_fields map<string,string>, page string",
    )
    return df.drop("hyp_fields", "page"), df.select("id", "hyp_fields", "page")


def test_documents_scope_samples_and_breakdown(spark):
    manifest, told = records(spark)
    with pytest.raises(EmptyScopeError):
        evaluations.evaluate_documents(manifest, told, scripts=["hebrew"])
    done = evaluations.evaluate_documents(manifest, told)
    assert done.result.first().n == 12 and done.result.first().cer_field == pytest.approx(0.125)
    levels = {(r.level, r.key): (r.n, r.script) for r in done.detail["breakdown"].collect()}
    assert levels == {
        ("overall", ""): (12, None), ("script", "latin"): (6, None), ("script", "cyrillic"): (6, None),
        ("country", "alb"): (6, "latin"), ("country", "rus"): (6, "cyrillic"),
    }
    assert [(r.origin, r.n) for r in done.detail["origins"].collect()] == [("public_dataset", 12)]
    sampled = evaluations.evaluate_documents(manifest, told, max_samples=4)
    assert {r.country: r["count"] for r in sampled.detail["items"].groupBy("country").count().collect()} == {"alb": 2, "rus": 2}
    legacy = evaluations.evaluate_documents(manifest, told, max_samples=5, sample_mode="legacy")
    assert sorted(r.id for r in legacy.detail["items"].collect()) == ["photo_1", "photo_4", "photo_7", "scan_0", "scan_3"]
    with pytest.raises(ValueError, match="sample mode"):
        evaluations.evaluate_documents(manifest, told, max_samples=4, sample_mode="random")
    assert evaluations.evaluate_documents(manifest, told, max_samples=12).result.first().n == 12


def test_a_failed_record_voids_every_metric(spark):
    manifest, told = records(spark)
    broken = told.withColumn("error", F.when(F.col("id") == "scan_3", "timeout"))
    with pytest.raises(FatalRowsError, match="1 failed calls:\n  scan_3, timeout"):
        evaluations.evaluate_documents(manifest, broken)
    pairs = manifest.select("id", (F.col("row_index") % 2 == 0).alias("same"), "origin", F.lit(None).cast("string").alias("pair_warning"),
                            F.lit("photo").alias("capture_a"), F.lit("doc").alias("capture_b"))
    similar = pairs.select("id", F.lit(0.5).alias("similarity"), F.lit("b").alias("backend"))
    assert evaluations.evaluate_faces(pairs, similar).result.first().n == 12
    with pytest.raises(FatalRowsError, match="2 failed calls"):
        evaluations.evaluate_faces(pairs, similar.where("id NOT IN ('scan_0', 'photo_1')"))


def test_failures_are_met_before_any_later_condition(spark):
    """A condition on the score, which a failed record does not meet, must not hide the record."""
    manifest = spark.range(5)
    scores = manifest.select("id", F.when(F.col("id") != 2, F.col("id") * 1.0).alias("score"))
    checked = complete_scores(manifest, scores, "id", "score")
    with pytest.raises(Exception, match="failed record 2: null score"):
        checked.where("score IS NOT NULL AND score > 3").count()
    report = fatal_report(unscored(manifest, scores.where("id <> 4"), "id", "score"), ["id"], shown=1).collect()
    assert [(r.id, r.reason, r.n_failed) for r in report] == [(2, "null score", 2)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_shapes_of_plans(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("name"), F.md5(F.col("id").cast("string")).alias("digest"))
    assert exchanges(dataset_fingerprint(rows, "name", "digest")) == 3
    scores = spark.range(100).selectExpr("id % 3 AS g", "id / 100.0D AS score", "int(id % 2) AS label")
    gate = ranking.roc_gate(scores, ["g"])
    plan = gate._jdf.queryExecution().executedPlan().toString()
    # The counts were cut and written: the plan starts from those, and joins chunks, not groups.
    assert "Range (" not in plan and "_chunk" in plan
    names = spark.range(10).select(F.col("id").cast("string").alias("path"))
    some = names.where("path < '5'").withColumn("label", F.lit(0))
    held = splits.train_minus_eval(names, some)
    assert exchanges(held) == 0 and held.count() == 5
    assert splits.train_minus_eval(names, names.withColumn("label", F.lit(0))).count() == 5
