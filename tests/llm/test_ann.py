import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import ann
from tallymark.llm.ann import nearest


def brute(rows, k=20):
    """{query: [(id, score)]} by exact search."""
    rows = [
        (i, np.array(v, np.float64)) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for query, vector in rows:
        if query % 20 == 0:
            found = [((other * vector).sum(), i) for i, other in rows if i != query]
            out[query] = [(i, s) for s, i in sorted(found, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def test_small_table_is_exact(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = {}
    for r in sorted(nearest(vectors, F.col("vec_id") % 20 == 0).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_recall_on_hard_vectors(spark, monkeypatch):
    """Shards are small here; random vectors are the hardest case."""
    monkeypatch.setattr(ann, "SHARD", 3000)
    draw = np.random.default_rng(4)
    rows = draw.normal(size=(6000, 64)) * draw.uniform(0.5, 2, (6000, 1))
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    want = brute(data)
    got = {}
    for r in nearest(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for i, _ in v}) / 20 for q, v in want.items()])
    assert recall >= 0.9


def test_odd_vectors(spark):
    same = [1.0, 2.0, 0.0]
    data = [(i, same) for i in range(0, 45)]
    data += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0])]
    data += [(120, [1.0, float("inf"), 0.0]), (140, [1.0]), (None, same), (160, [-1.0, 0.0, 0.5]), (160, [-1.0, 0.0, 0.5])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").select(
        "*", F.lit(1).alias("rank"), F.lit(2).alias("score"), F.lit(3).alias("shard"), F.lit(4).alias("pivot_list")
    )
    got = nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == {0, 20, 40, 160}
    assert by[0] == list(range(1, 21))
    assert by[20] == list(range(0, 20))
    assert by[160] == list(range(0, 20))
    assert nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vectors.where("vec_id < 3")
    assert nearest(few, F.col("vec_id") % 20 == 0).count() == 2


def test_recall_near_a_vector_of_a_third_of_the_rows(spark):
    """Every query near the copied vector finds its neighbours behind the copies."""
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(20, 64))
    rows = centres[draw.integers(0, 20, 8000)] + 0.5 * draw.normal(size=(8000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    near = np.argsort(-(rows @ rows[1]), kind="stable")[:300]
    rows[draw.choice(np.setdiff1d(np.arange(8000), near), 2700, replace=False)] = rows[1]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    asked = [int(i) for i in near[1:101]]
    score = rows[asked] @ rows.T
    got = {}
    for r in nearest(vectors, F.col("vec_id").isin(asked)).collect():
        got.setdefault(r.query_id, []).append(r.score)
    recall = []
    for query, found in zip(asked, score):
        least = np.sort(np.delete(found, query))[-20]
        recall.append(np.mean(np.array(got[query]) >= least - 1e-9))
        assert len(got[query]) == 20
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.8
