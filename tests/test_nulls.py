"""Null keys are groups, whichever plan serves them."""

import pytest

from tallymark.operators.ordering import indexed_totals, range_totals, seeded_rank, seeded_top
from tallymark.operators.pairing import scored_pair_sweep
from tallymark.operators.ranking import epoch_metrics, rank_auc, tie_rank
from tallymark.operators.validation import FatalRowsError, complete_scores
from tallymark.plans import evaluations
from tallymark.session import shared_dir
from pyspark.sql import functions as F

ROWS = [(f"r{i}", None if i % 2 else "a") for i in range(10)] + [(None, "a"), (None, None)]


@pytest.mark.parametrize("k", [3, 1000, 1001])
def test_seeded_top_keeps_null_keys_and_ids(spark, k):
    df = spark.createDataFrame(ROWS, "id string, key string")
    top = sorted(map(tuple, seeded_top(df, "id", 7, k, ["key"]).collect()), key=str)
    by_rank = seeded_rank(df, "id", 7, ["key"]).where(F.col("rank") <= k)
    assert top == sorted(map(tuple, by_rank.collect()), key=str)
    assert len(top) == min(k, 6) * 2


def test_running_totals_of_null_keys(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(10)], "i long, key string")
    one = {"s": F.lit(1)}
    by_index = indexed_totals(df, "i", one, ["key"], chunk_rows=3).collect()
    by_range = range_totals(df, ["i"], one, ["key"]).collect()
    assert len(by_index) == len(by_range) == 10
    assert max(r.s for r in by_index if r.key is None) == 5
    assert max(r.s for r in by_range if r.key is None) == 4


def test_metrics_of_null_groups(spark):
    rows = [(None if i % 3 else "g", i / 10, int(i > 4)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    assert rank_auc(df, ["g"]).count() == 2
    assert {r.g for r in tie_rank(df, ["g"]).collect()} == {None, "g"}
    epochs = epoch_metrics(df.withColumn("run", F.col("g")).withColumn("epoch", F.lit(1)))
    assert all(r.auc is not None and r.gate_passed is not None for r in epochs.collect())
    pairs = spark.createDataFrame(
        [(None, True, 0.9), (None, False, 0.1)], "backend string, same boolean, similarity double"
    )
    found = scored_pair_sweep(pairs).first()
    assert found.infeasible is False and found.backend is None


def test_missing_or_failed_scores_void_a_run(spark):
    manifest = spark.createDataFrame(
        [(i, i % 2, "public_dataset", None, None) for i in range(10)],
        "id long, label int, origin string, fabrication string, eval_domain string",
    )
    scores = manifest.select("id", (F.col("label") * 1.0).alias("score"))
    assert evaluations.evaluate_forgery(manifest, scores, require_cross=False).result.count() == 1
    for broken in (
        scores.where("id < 2"),
        scores.withColumn("score", F.when(F.col("id") > 0, F.col("score"))),
        scores.withColumn("error", F.when(F.col("id") == 3, F.lit("timeout"))),
    ):
        with pytest.raises(FatalRowsError, match="failed calls:\n  "):
            evaluations.evaluate_forgery(manifest, broken, require_cross=False)
    more = scores.unionByName(spark.createDataFrame([(99, 0.5)], "id long, score double"))
    assert complete_scores(manifest, more).count() == 10


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_dir(Session())
