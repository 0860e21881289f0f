import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark.operators import ordering, sampling, splits


def seeded(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@pytest.mark.parametrize("prefix", [1, 4])
def test_seeded_rank_equals_full_sort(spark, prefix):
    rows = [(f"x{i}", f"k{i % 3 if i % 2 else 0}") for i in range(500)]
    df = spark.createDataFrame(rows, "id string, k string")
    ranked = ordering.seeded_rank(df, "id", 5, ["k"], prefix=prefix).collect()
    by_key = defaultdict(list)
    for i, k in rows:
        by_key[k].append(i)
    want = {i: n for ids in by_key.values() for n, i in enumerate(seeded(ids, 5), 1)}
    assert {r.id: r["rank"] for r in ranked} == want


def test_seeded_top_agrees_on_both_routes(spark, monkeypatch):
    df = frame(spark, [f"x{i}" for i in range(200)])
    fast = ordering.seeded_top(df, "id", 1, 30).collect()
    monkeypatch.setattr(ordering, "GROUP_LIMIT_MAX", 10)
    slow = ordering.seeded_top(df, "id", 1, 30).collect()
    assert {(r.id, r["rank"]) for r in fast} == {(r.id, r["rank"]) for r in slow}
    assert len(fast) == 30


def test_positions_and_totals(spark):
    rows = [(f"g{i % 2}", f"n{i * 7919 % 1000:04d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, name string, v int")
    got = {(r.g, r.name): r.position for r in ordering.positions(df, ["name"], ["g"]).collect()}
    for g in ("g0", "g1"):
        names = sorted(n for k, n, _ in rows if k == g)
        assert [got[(g, n)] for n in names] == list(range(1, len(names) + 1))
    sums = ordering.indexed_totals(df, "v", {"s": F.col("v").cast("long")}, ["g"], chunk_rows=17)
    for r in sums.collect():
        assert r.s == sum(v for g, _, v in rows if g == r.g and v <= r.v)


def test_large_window_is_never_single_task(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    plan = ordering.seeded_rank(df, "id", 1)._jdf.queryExecution().optimizedPlan().toString()
    # The only unpartitioned window is the one over chunk totals.
    assert plan.count("Window") == 2 and "_chunk" in plan


def test_holdout_split(spark):
    names = [f"n{i}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in names] * 2, "name string")
    out = sampling.holdout_split(df, "name", 20, 10, 7).collect()
    order = seeded(names, 7)
    assert {r.name for r in out if r.side == "train"} == set(order[:20])
    assert {r.name for r in out if r.side == "eval"} == set(order[20:30])
    with pytest.raises(sampling.TooFewRowsError):
        sampling.holdout_split_checked(df, "name", 45, 10, 7)
    assert splits.split_overlap(sampling.holdout_split(df, "name", 20, 10, 7)).count() == 0


def alternate(scans, photos, others, quota):
    """The stated rule, step by step."""
    pools, take = {"s": list(scans), "p": list(photos), "o": list(others)}, []
    while len(take) < quota and any(pools.values()):
        if pools["s"] and (len(take) % 2 == 0 or not pools["p"]):
            take.append(pools["s"].pop(0))
        elif pools["p"]:
            take.append(pools["p"].pop(0))
        else:
            take.append(pools["o"].pop(0))
    return take


@pytest.mark.parametrize("max_n", [1, 7, 20, 33, 90, 500])
def test_stratified_sample_follows_the_alternation(spark, max_n):
    rng = random.Random(2)
    rows = []
    for c in range(8):
        for kind in ("scan", "photo", "other"):
            rows += [(f"{kind}_{c}_{i}", f"c{c}", kind) for i in range(rng.choice([0, 1, 3, 12]))]
    df = spark.createDataFrame(rows, "id string, country string, capture string")
    got = {r.id for r in sampling.stratified_sample(df, max_n, 42).collect()}
    countries = sorted({c for _, c, _ in rows})
    want = set()
    for n, c in enumerate(countries):
        quota = max_n // len(countries) + (n < max_n % len(countries))
        pools = [seeded([i for i, k, kind in rows if k == c and kind == want_kind], 42)
                 for want_kind in ("scan", "photo", "other")]
        want |= set(alternate(*pools, quota))
    assert got == want


@pytest.mark.parametrize("max_n", [3, 4, 10, 15, 40])
def test_legacy_sample(spark, max_n):
    kinds = ["scan"] * 3 + ["other"] * 9 + ["photo"] * 8
    rows = [(f"{k}_{i}", i) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "id string, row_index long")
    scans, photos = [i for i, _ in rows if "scan" in i], [i for i, _ in rows if "photo" in i]
    other = [i for i, _ in rows if "other" in i]
    half = max_n // 2
    want = scans[:half] + photos[: max_n - min(half, len(scans))]
    if len(want) < max_n:
        want = (scans + photos + other)[:max_n]
    if len(rows) <= max_n:
        want = [i for i, _ in rows]
    assert {r.id for r in sampling.legacy_sample(df, max_n).collect()} == set(want)


def test_an_id_naming_both_counts_once_as_scan(spark):
    df = spark.createDataFrame([("scan_photo_1",), ("photo_1",), ("x",)], "id string")
    kinds = [r[0] for r in df.select(sampling.capture_kind(F.col("id"))).collect()]
    assert kinds == ["scan", "photo", "other"]


def test_balanced_sample_and_pick(spark):
    df = spark.createDataFrame([(f"i{i}", int(i < 5)) for i in range(40)], "id string, label int")
    out = Counter(r.label for r in sampling.balanced_eval_sample(df, 21, 3).collect())
    assert out == {0: 10, 1: 5}
    assert sampling.balanced_eval_sample(df, 0, 3).count() == 40
    images = df.select(F.col("id").alias("path"))
    picked = sampling.authentic_pick(images, 12, 42).collect()
    assert len(picked) == 24 and len({r.id for r in picked}) == 24
    with pytest.raises(sampling.TooFewRowsError):
        sampling.authentic_pick(images, 41, 42)


def test_train_minus_eval_falls_back_to_half(spark):
    paths = spark.createDataFrame([(f"p{i}",) for i in range(9)], "path string")
    everything = paths.withColumn("label", F.lit(0))
    out = splits.train_minus_eval(paths, everything).collect()
    assert len(out) == 4 and all(r.fallback for r in out)
    some = everything.where("path < 'p4'")
    out = splits.train_minus_eval(paths, some).collect()
    assert {r.path for r in out} == {f"p{i}" for i in range(4, 9)} and not any(r.fallback for r in out)


def test_holdout_names_without_a_file_are_fatal(spark):
    split = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "eval")], "name string, side string")
    have = spark.createDataFrame([("a",), ("c",)], "name string")
    assert [r.name for r in splits.holdout_train_filter(have, split).collect()] == ["a"]
    with pytest.raises(splits.HoldoutError, match="b"):
        splits.holdout_train_filter_checked(have, split)
    with pytest.raises(splits.HoldoutError):
        splits.require_both_classes(spark.createDataFrame([(1,)], "label int"))
