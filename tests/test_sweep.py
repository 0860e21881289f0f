import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallymark.operators import sweep as sw
from tallymark.sources.sinks import sweep_csv_write

GRID = [round(i * 0.01, 2) for i in range(101)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, score double, label int")


def confusion(rows, t, higher=True):
    tp = fp = tn = fn = 0
    for _, s, y in rows:
        hit = s >= t if higher else s <= t
        tp, fp = tp + (hit and y == 1), fp + (hit and y == 0)
        tn, fn = tn + (not hit and y == 0), fn + (not hit and y == 1)
    return tp, fp, tn, fn


def tricky(seed=3, n=400):
    rng = random.Random(seed)
    special = [0.29, 0.57, 0.1 * 3, 0.0, 1.0, -0.2, 1.7, math.nan, -0.0, math.inf, -math.inf]
    special += [float(np.nextafter(t, 0)) for t in (0.29, 0.57, 0.3, 1.0)]
    special += [float(np.nextafter(t, 2)) for t in (0.29, 0.57, 0.3, 1.0)] + GRID
    scores = special + [rng.random() for _ in range(n)]
    return [("a", s, rng.randint(0, 1)) for s in scores]


def test_every_threshold_equals_brute_force(spark):
    rows = tricky()
    for higher in (True, False):
        out = sw.threshold_sweep(frame(spark, rows), ["g"], higher_is_positive=higher).collect()
        assert len(out) == 101
        for r in out:
            assert (r.tp, r.fp, r.tn, r.fn) == confusion(rows, r.threshold, higher), r.threshold


def test_confusion_at_one_threshold(spark):
    rows = tricky()
    for higher in (True, False):
        for t in (0.29, 0.123456, 1.0):
            r = sw.confusion(frame(spark, rows), t, ["g"], higher_is_positive=higher).first()
            assert (r.tp, r.fp, r.tn, r.fn) == confusion(rows, t, higher)


def test_null_scores_are_left_out_and_grid_is_exact(spark):
    out = sw.threshold_sweep(frame(spark, [("a", None, 1), ("a", 0.5, 1)]), ["g"]).collect()
    assert sorted(r.threshold for r in out) == GRID
    assert all(r.tp + r.fn == 1 for r in out)


def test_zero_denominators(spark):
    out = {r.threshold: r for r in sw.threshold_sweep(frame(spark, [("a", 0.5, 0)])).collect()}
    r = out[0.9]
    assert (r.tpr, r.precision, r.f1, r.fpr, r.accuracy) == (0.0, 0.0, 0.0, 0.0, 1.0)


def points(spark, rows):
    return spark.createDataFrame(rows, "threshold double, tpr double, f1 double")


def test_maximin_prefers_margin_then_metric_then_lower_threshold(spark):
    # The same worst margin at 0.2 and 0.3; the worst metric is larger at 0.3.
    rows = [(0.1, 0.5, 0.5), (0.2, 0.9, 0.9), (0.3, 0.9, 0.9), (0.4, 0.8, 0.95)]
    best = sw.maximin_threshold(points(spark, rows), {"tpr": 0.6, "f1": 0.6}).first()
    assert best.recommended == 0.2 and best.min_margin == (0.9 - 0.6) / 0.6
    assert (best.t_min, best.t_max, best.infeasible) == (0.2, 0.4, False)
    rows = [(0.2, 0.9, 0.75), (0.3, 1.0, 0.75)]
    best = sw.maximin_threshold(points(spark, rows), {"tpr": 0.5, "f1": 0.5}).first()
    assert best.recommended == 0.2


def test_maximin_zero_target_and_infeasible(spark):
    rows = [(0.1, 0.7, 0.0), (0.2, 0.8, 0.0)]
    best = sw.maximin_threshold(points(spark, rows), {"tpr": 0.5, "f1": 0.0}).first()
    assert best.recommended == 0.2 and best.margin_f1 == math.inf
    none = sw.maximin_threshold(points(spark, rows), {"tpr": 0.9, "f1": 0.5}).first()
    assert none.infeasible and none.recommended is None and none.t_min is None
    assert not sw.thin_margin_warning(
        sw.maximin_threshold(points(spark, rows), {"tpr": 0.9}), {"tpr": 0.9}
    ).first().thin


def test_at_tpr_floor_is_zero_when_positives_exist(spark):
    swept = sw.threshold_sweep(frame(spark, [("a", 0.7, 1), ("a", 0.2, 0)]))
    assert sw.at_tpr_floor(swept).first().threshold == 0.0


def test_domain_gate(spark):
    def gate(rows, cross=True):
        df = spark.createDataFrame(rows, "domain string, infeasible boolean, tpr double")
        return sw.domain_gate(df, require_cross=cross).first()

    both = gate([("in_domain", False, 0.9), ("cross_domain", True, 0.1)])
    assert (both.gate_domain, both.infeasible, both.tpr) == ("cross_domain", True, 0.1)
    single = gate([("in_domain", False, 0.9)])
    assert single.missing_cross_domain and single.infeasible
    assert not gate([("in_domain", False, 0.9)], cross=False).infeasible
    assert gate([("z", False, 0.9), ("b", False, 0.8)], cross=False).gate_domain == "b"


def test_sweep_csv(spark, tmp_path):
    swept = sw.threshold_sweep(frame(spark, [("a", 0.7, 1), ("a", 0.2, 0)]), ["g"])
    sweep_csv_write(swept, str(tmp_path / "s"), ["tpr", "f1"], ["g"])
    files = list((tmp_path / "s").glob("*.csv"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 1 and len(lines) == 102
    assert lines[0] == "g,threshold,tpr,f1" and lines[1] == "a,0.00,1.000000,0.666667"


def test_sweep_shuffles_counts_not_rows(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") / 1000).alias("score"), (F.col("id") % 2).alias("label")
    )
    plan = sw.threshold_sweep(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count_if" in plan or "partial_count" in plan
    assert "Join" not in plan
