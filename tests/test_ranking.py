import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import ranking as rk


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, score double, label int")


def auc(rows):
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    if not pos or not neg:
        return 0.0
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def gate(rows, tpr_min=0.88, fpr_max=0.348):
    pos = sum(y == 1 for _, _, y in rows)
    neg = sum(y == 0 for _, _, y in rows)
    best = (False, None, 0.0, 1.0)
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tpr = sum(s >= t and y == 1 for _, s, y in rows) / pos if pos else 0.0
        fpr = sum(s >= t and y == 0 for _, s, y in rows) / neg if neg else 0.0
        if tpr >= tpr_min and fpr <= fpr_max:
            return (True, t, tpr, fpr)
        if tpr >= tpr_min and fpr < best[3]:
            best = (False, t, tpr, fpr)
    return best


def samples():
    rng = random.Random(5)
    out = {}
    for i in range(6):
        n, levels = rng.randint(5, 120), rng.choice([3, 20, 1000])
        shift = rng.choice([0.0, 0.2, 0.5])
        out[f"g{i}"] = [
            (f"g{i}", round(rng.random() * levels) / levels + shift * y, y)
            for y in (rng.randint(0, 1) for _ in range(n))
        ]
    out["tied"] = [("tied", 0.5, i % 2) for i in range(10)]
    out["pos"] = [("pos", 0.1 * i, 1) for i in range(5)]
    out["neg"] = [("neg", 0.1 * i, 0) for i in range(5)]
    return out


def test_auc_and_gate_equal_brute_force(spark):
    by_group = samples()
    df = frame(spark, [r for rows in by_group.values() for r in rows])
    aucs = {r.g: r.auc for r in rk.rank_auc(df, ["g"]).collect()}
    gates = {r.g: r for r in rk.roc_gate(df, ["g"]).collect()}
    for g, rows in by_group.items():
        assert aucs[g] == pytest.approx(auc(rows), abs=1e-12), g
        r = gates[g]
        assert (r.passed, r.threshold, r.tpr, r.fpr) == gate(rows), g
    assert aucs["tied"] == 0.5 and aucs["pos"] == 0.0


def test_ungrouped(spark):
    rows = [r for rows in samples().values() for r in rows]
    assert rk.rank_auc(frame(spark, rows)).first().auc == pytest.approx(auc(rows), abs=1e-12)
    r = rk.roc_gate(frame(spark, rows)).first()
    assert (r.passed, r.threshold, r.tpr, r.fpr) == gate(rows)


def test_one_large_group_spreads_over_chunks(spark):
    df = spark.range(4000).select((F.col("id") * 37 % 4001 / 4001).alias("score"), (F.col("id") % 2).alias("label"))
    counts = rk.score_counts(df)
    chunks = rk.score_chunks(rk.cut_counts(counts, chunks=16)).collect()
    assert len(chunks) >= 12
    assert max(c.pos + c.neg for c in chunks) < 4000 / 4


def test_tie_rank(spark):
    rows = [("a", s, 1) for s in (0.1, 0.1, 0.1, 0.4, 0.4, 0.9)]
    out = {r.score: r.mean_rank for r in rk.tie_rank(frame(spark, rows), ["g"]).collect()}
    assert out == {0.1: 2.0, 0.4: 4.5, 0.9: 6.0}


def test_best_checkpoint_takes_earliest_tie(spark):
    df = spark.createDataFrame(
        [("r", 1, 0.2, 0.8), ("r", 2, 0.3, 0.7), ("r", 3, 0.3, 0.9), ("r", 4, 0.3, 0.9)],
        "run string, epoch int, width double, auc double",
    )
    assert rk.best_checkpoint(df).first().epoch == 3


def test_collapse_streak_and_stop(spark):
    stds = [0.1, 0.0, 0.2, 0.0, 0.0, 0.0, 0.3]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(stds)], "run string, epoch int, score_std double")
    out = rk.collapse_streak(df)
    assert [r.streak for r in out.orderBy("epoch").collect()] == [0, 1, 0, 1, 2, 3, 0]
    assert rk.collapse_stop(out).first().stop_epoch == 4


def test_seed_summary(spark):
    # Published figures of three seeds.
    rows = [(7, False, 0.92, 0.821), (13, False, 0.88, 0.811), (42, False, 0.93, 0.798)]
    df = spark.createDataFrame(rows, "seed int, infeasible boolean, tpr double, f1 double")
    out = rk.seed_summary(df).first()
    assert (out.tpr_min, out.f1_min, out.pass_by_minimum) == (0.88, 0.798, True)
    assert not rk.seed_summary(df.limit(0)).first().pass_by_minimum
    failed = df.withColumn("infeasible", F.col("seed") == 7)
    assert not rk.seed_summary(failed).first().pass_by_minimum
