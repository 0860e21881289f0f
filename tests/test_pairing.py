from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymark.operators import pairing, provenance


def ids(spark, n):
    return spark.createDataFrame([(f"p{i:03d}",) for i in range(n)], "id string")


@pytest.mark.parametrize("n,n_diff", [(2, 5), (3, 2), (4, 6), (5, 7), (6, 15), (6, 14), (9, 30), (10, 23), (23, 200), (1, 3)])
def test_diff_pairs_are_distinct_and_balanced(spark, n, n_diff):
    rows = pairing.diff_pairs(ids(spark, n), n_diff, 42).collect()
    want = min(n_diff, n * (n - 1) // 2)
    assert len(rows) == want
    assert all(r.identity_a != r.identity_b for r in rows)
    assert len({frozenset((r.identity_a, r.identity_b)) for r in rows}) == want
    assert sorted(r.pair for r in rows) == list(range(1, want + 1))
    if want:
        degree = Counter(i for r in rows for i in (r.identity_a, r.identity_b))
        counts = [degree.get(f"p{i:03d}", 0) for i in range(n)]
        assert max(counts) - min(counts) <= 2


def test_sorted_sides(spark):
    rows = pairing.diff_pairs(ids(spark, 12), 40, 7, sides="sorted").collect()
    assert len(rows) == 40 and all(r.identity_a < r.identity_b for r in rows)


def test_same_pairs_in_capture_order(spark):
    df = spark.createDataFrame(
        [("a", "scan", "a/s2"), ("a", "scan", "a/s1"), ("a", "photo", "a/p"), ("a", "video_frame", "a/v"), ("b", "scan", "b/s")],
        "identity string, capture string, path string",
    )
    rows = {(r.capture_a, r.capture_b): (r.img_a, r.img_b) for r in pairing.same_pairs(df).collect()}
    assert rows == {
        ("photo", "scan"): ("a/p", "a/s1"),
        ("photo", "video_frame"): ("a/p", "a/v"),
        ("scan", "video_frame"): ("a/s1", "a/v"),
    }


def bands(spark, same, diff, origin):
    df = spark.createDataFrame([(same, diff)], "n_same long, n_diff long")
    return {r.rule for r in pairing.pair_count_bands(df, origin).collect()}


def test_pair_count_bands(spark):
    assert bands(spark, 200, 200, "field_collected") == set()
    assert bands(spark, 100, 200, "field_collected") == {"same_band"}
    assert bands(spark, 200, 100, "field_collected") == {"diff_band"}
    assert bands(spark, 251, 250, "field_collected") == {"same_band", "total_band"}
    assert bands(spark, 10, 10, "dev_fixture") == set()
    assert bands(spark, 0, 0, "dev_fixture") == {"same_missing"}
    assert bands(spark, 2, 0, "dev_fixture") == {"diff_missing"}
    assert bands(spark, 1, 0, "dev_fixture") == set()


def test_diff_target_clamp(spark):
    def clamp(same, diff, origin):
        return spark.range(1).select(pairing.diff_target_clamp(F.lit(same), F.lit(diff), origin)).first()[0]

    assert clamp(150, 150, "field_collected") == 150
    assert clamp(250, 400, "field_collected") == 250
    assert clamp(200, 10, "field_collected") == 150
    assert clamp(4, 100, "public_dataset") == 6
    assert clamp(4, -1, "public_dataset") == 0


def test_capture_pick(spark):
    paths = [
        "a/doc.jpg", "a/doc/z.png", "a/selfie.jpg",  # folder before file
        "b/photo.jpg", "b/id.jpg", "b/live/1.jpg", "b/live/0.jpg",  # id before photo
        "c/one.jpg", "c/two.jpg", "c/three.jpg",  # first two by name
        "d/doc.jpg",  # a single image
        "e/doc.jpg", "e/other.jpg",  # one side missing: first two
        ".hidden/doc.jpg", ".hidden/selfie.jpg",
    ]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    out = {r.identity: (r.doc, r.selfie) for r in pairing.identity_capture_pick(df).collect()}
    assert out == {
        "a": ("a/doc/z.png", "a/selfie.jpg"),
        "b": ("b/id.jpg", "b/live/0.jpg"),
        "c": ("c/one.jpg", "c/three.jpg"),
        "e": ("e/doc.jpg", "e/other.jpg"),
    }


def test_pair_manifest(spark):
    people = spark.createDataFrame([(f"p{i}", f"a{i}", f"b{i}") for i in range(6)], "identity string, img_a string, img_b string")
    rows = pairing.pair_manifest(people, 6, 1, "dev_fixture", ("doc", "selfie")).collect()
    assert len({r.id for r in rows}) == 12 and sum(r.same for r in rows) == 6
    for r in rows:
        if r.same:
            assert r.img_a[1:] == r.img_b[1:] == r.identity_id[1:]
        else:
            assert (r.img_a, r.img_b) == ("a" + r.identity_a[1:], "b" + r.identity_b[1:])


def test_scored_pairs_with_nulls(spark):
    df = spark.createDataFrame(
        [("x", 0.9, True), ("x", None, True), ("x", 0.1, False), ("y", None, True)],
        "backend string, similarity double, same boolean",
    )
    out = {r.backend: r for r in pairing.scored_pair_sweep(df).collect()}
    assert (out["x"].n, out["x"].n_scored, out["x"].null_count) == (3, 2, 1)
    assert not out["x"].infeasible and out["x"].recommended == 0.11
    assert out["y"].infeasible and out["y"].n_scored == 0


def test_trial_rules(spark):
    def rules(rows, **kw):
        df = spark.createDataFrame(rows, "id string, same boolean, origin string, pair_warning string")
        return {r.rule for r in provenance.trial_rules(df, **kw).collect()}

    assert rules([], face_threshold=0.5) == {"manifest_missing", "threshold_without_manifest"}
    one = [("1", True, "public_dataset", "under_variation:x")]
    assert {"origin_not_field", "under_variation", "threshold_on_non_field", "total_band"} <= rules(one, face_threshold=0.4)
    field = [(str(i), i < 200, "field_collected", None) for i in range(400)]
    assert rules(field) == set()
    assert rules(field, face_threshold=0.4, last_run_blocked=True) == {"last_run_blocked"}
    assert rules(field, last_run_origins=["public_dataset"]) == {"last_run_not_field"}
