import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymark.operators import scoring as sc


def docs(spark, n=20):
    return spark.range(n).select(F.col("id"), (F.col("id") * 1.5).alias("x"))


def test_errors_stay_in_their_row(spark):
    def scorer(record):
        if record["x"] > 20:
            raise ValueError("too big")
        return record["x"]

    out = {r.id: r for r in sc.batch_score(docs(spark), scorer, ["x"], retries=2, backoff_s=0.0).collect()}
    assert len(out) == 20 and out[4].score == 6.0 and out[4].error is None and out[4].latency_ms >= 0
    assert out[19].score is None and out[19].error == "ValueError: too big"


def test_retry_then_success(spark):
    def make():
        tried = {}

        def scorer(record):
            tried[record["id"]] = tried.get(record["id"], 0) + 1
            if tried[record["id"]] < 3:
                raise OSError("busy")
            return 1.0

        return scorer

    out = sc.batch_score(docs(spark), make(), ["id"], retries=3, backoff_s=0.0)
    assert out.where("score = 1.0").count() == 20
    assert sc.batch_score(docs(spark), make(), ["id"], retries=2, backoff_s=0.0).where("error is not null").count() == 20


@pytest.mark.parametrize("concurrency", [1, 6])
def test_timeout_disturbs_no_other_row(spark, concurrency):
    def scorer(record):
        if record["id"] == 3:
            time.sleep(3)
        return 1.0

    scored = sc.batch_score(docs(spark, 6).coalesce(1), scorer, ["id"], retries=1, concurrency=concurrency, timeout_s=0.5)
    out = {r.id: r for r in scored.collect()}
    assert out[3].error.startswith("timeout") and all(out[i].score == 1.0 for i in out if i != 3)


@pytest.mark.parametrize("concurrency", [1, 3])
def test_calls_that_never_return_leave_nothing_behind(spark, concurrency, tmp_path):
    """A scorer that ignores everything short of being killed, and one that ends its process."""
    folder = str(tmp_path)

    def scorer(record):
        import signal

        Path(folder, f"pid-{os.getpid()}").touch()
        if record["id"] % 4 == 1:
            signal.signal(signal.SIGTERM, signal.SIG_IGN)
            while True:
                time.sleep(1)
        if record["id"] == 2:
            os._exit(7)
        return float(record["id"])

    scored = sc.batch_score(docs(spark, 9).coalesce(1), scorer, ["id"], retries=2, concurrency=concurrency, timeout_s=0.6)
    out = {r.id: r for r in scored.collect()}
    assert len(out) == 9
    assert all(out[i].error == "timeout after 0.6s" for i in (1, 5)) and out[2].error == "process ended with 7"
    assert all(out[i].score == float(i) for i in (0, 3, 4, 6, 7, 8))
    pids = [int(p.name[4:]) for p in tmp_path.iterdir()]
    deadline = time.time() + 5
    while time.time() < deadline and any(Path(f"/proc/{p}").exists() for p in pids):
        time.sleep(0.1)
    assert pids and not [p for p in pids if Path(f"/proc/{p}").exists()]


def test_waiting_calls_overlap(spark):
    def scorer(record):
        time.sleep(1.0)
        return 1.0

    one_task = docs(spark, 4).coalesce(1)
    sc.batch_score(one_task, lambda r: 0.0, ["id"]).collect()  # start the Python worker
    started = time.time()
    assert sc.batch_score(one_task, scorer, ["id"], concurrency=4).count() == 4
    assert time.time() - started < 3.5


def test_registry():
    registry = sc.ScorerRegistry()
    registry.register("classic", "plain", factory=lambda: (lambda r: 1.0))

    def broken():
        raise ImportError("no model")

    registry.register("heavy", factory=broken)
    assert registry.create(" Plain ")({}) == 1.0
    with pytest.raises(sc.UnknownScorerError):
        registry.create("other")
    with pytest.raises(ImportError):
        registry.create("heavy")
    assert registry.create("heavy", lambda reason: reason) == "heavy_unavailable: ImportError: no model"


def test_children_serve_all_batches_and_hold_none(spark):
    """Two children for a hundred batches, and none that is forked from the task beside its rows."""
    def scorer(record):
        if record["id"] == 500:
            time.sleep(30)
        return float(os.getpid()) if record["id"] % 2 else float(os.getppid())

    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 10)
    try:
        scored = sc.batch_score(docs(spark, 1000).coalesce(1), scorer, ["id"], retries=1, concurrency=2, timeout_s=1.0)
        out = {r.id: r for r in scored.collect()}
    finally:
        spark.conf.set(size, before)
    assert out.pop(500).error == "timeout after 1.0s" and len(out) == 999
    pids = {r.score for i, r in out.items() if i % 2}
    parents = {r.score for i, r in out.items() if not i % 2}
    assert len(pids) <= 3 and len(parents) == 1
