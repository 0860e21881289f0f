import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import leakage as lk
from tallymark.operators import nearblocks
from tallymark.plans.leakcheck import check_leakage


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def hash_rows(seed, n, flips):
    rng = random.Random(seed)
    train = [signed(rng.getrandbits(64)) for _ in range(n)]
    ev = []
    for h in train:
        v = h % (1 << 64)
        for bit in rng.sample(range(64), rng.randint(0, flips)):
            v ^= 1 << bit
        ev.append(signed(v))
    return train, ev


def frames(spark, train, ev):
    t = spark.createDataFrame([(f"t{i}", h) for i, h in enumerate(train)], "path string, phash long")
    e = spark.createDataFrame([(f"e{i}", h) for i, h in enumerate(ev)], "path string, phash long")
    return t, e


def gap(a, b):
    return bin((a ^ b) % (1 << 64)).count("1")


@pytest.mark.parametrize("distance,bands", [(6, None), (6, 7), (6, 9), (6, 10), (3, 5), (0, 1), (0, 4)])
def test_near_pairs_equal_brute_force_once_each(spark, distance, bands):
    train, ev = hash_rows(bands or 1, 60, 10)
    train += [0, -1, train[0]]
    ev += [0, -1, 1, train[0], None]
    pairs = lk.near_hash_pairs(*frames(spark, train, ev), distance=distance, bands=bands).collect()
    want = {
        (e, t, gap(e, t)) for e in ev if e is not None for t in train if gap(e, t) <= distance
    }
    got = [(r.eval_hash, r.train_hash, r.hamming_distance) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == want
    files = sum(1 for e in ev if e is not None for t in train if gap(e, t) <= distance)
    assert sum(r.n_eval * r.n_train for r in pairs) == files


def test_popular_hash_does_not_square(spark):
    train = [5] * 3000 + [6]
    ev = [5] * 2000 + [7]
    t, e = frames(spark, train, ev)
    pairs = lk.near_hash_pairs(t, e)
    assert pairs.count() == 4
    assert lk.near_pair_count(pairs).first()[0] == 3001 * 2001
    rows = lk.near_rows(e, pairs)
    assert rows.count() == 2001
    assert {r.n_train for r in rows.select("n_train").distinct().collect()} == {3001}


def test_choose_bands_measures_comparisons(spark):
    # All hashes share their high bits, so few bands leave most pairs to compare.
    rng = random.Random(1)
    train = [rng.getrandbits(14) for _ in range(300)]
    t, e = frames(spark, train, train)
    few = lk.candidate_count(e, t, 7, 6)
    more = lk.candidate_count(e, t, 10, 6)
    assert few > 0 and more != few
    assert lk.choose_bands(e, t, per_key=10**6) == 7
    assert lk.choose_bands(e, t, per_key=0, most_keys=90) in (7, 8, 9)


def sided(spark, rows):
    return spark.createDataFrame(rows, "path string, sha256 string, source_id string")


def test_exact_and_source(spark):
    train = sided(spark, [("t1", "x", "s1"), ("t2", "x", ""), ("t3", "y", "s2")])
    ev = sided(spark, [("e1", "x", "s1"), ("e2", "z", ""), ("e3", "x", "s3"), ("e4", None, None)])
    exact = lk.leak_exact(train, ev).collect()
    assert [(r.sha256, r.n_eval, r.n_train, r.first_train_path) for r in exact] == [("x", 2, 2, "t1")]
    assert {r.path for r in lk.leak_exact_rows(train, ev).collect()} == {"e1", "e3"}
    assert [r.source_id for r in lk.leak_source(train, ev).collect()] == ["s1"]
    members = lk.leak_members(train, lk.leak_exact(train, ev), "sha256", "n_train")
    assert {r.path for r in members.collect()} == {"t1", "t2"}


def test_verdict(spark):
    def verdict(names=0, exact=0, near=0, source=0):
        pairs = spark.range(near).select(F.lit(1).alias("n_eval"), F.lit(1).alias("n_train"))
        row = lk.leak_verdict(
            spark.range(names), spark.range(exact).withColumn("n_eval", F.lit(1)), pairs, spark.range(source)
        ).first()
        return row.verdict

    assert verdict() == "PASS"
    assert verdict(source=1) == "CHECK"
    assert verdict(near=1, source=1) == "FAIL"
    assert verdict(exact=1) == "FAIL"
    assert verdict(names=1) == "FAIL"


@pytest.mark.parametrize("crowded", [1, 30, 400])
def test_crowded_keys_go_down_a_trie(spark, crowded):
    """A third of all hashes lies within a few bits of one: same pairs, each met once."""
    rng = random.Random(crowded)
    middle = rng.getrandbits(64)

    def drawn():
        value = rng.getrandbits(64)
        if rng.random() < 1 / 3:
            value = middle
            for _ in range(rng.randrange(6)):
                value ^= 1 << rng.randrange(64)
        return signed(value)

    train, ev = [drawn() for _ in range(250)], [drawn() for _ in range(250)] + [0, -1, None]
    pairs = lk.near_hash_pairs(*frames(spark, train, ev), distance=5, bands=7, crowded=crowded).collect()
    want = {(e, t, gap(e, t)) for e in ev if e is not None for t in train if gap(e, t) <= 5}
    got = [(r.eval_hash, r.train_hash, r.hamming_distance) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("crowded", [1, 1 << 16])
def test_near_pairs_gather_no_side_in_the_driver(spark, crowded):
    """Hashes, keys and trie nodes grow with the data: no join broadcasts them, however small they seem."""
    side = spark.range(40).select(F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("phash"))
    pairs = lk.near_hash_pairs(side, side, distance=1, bands=3, crowded=crowded)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == sum(gap(a, b) <= 1 for a in range(40) for b in range(40))


def test_trie_nodes_stay_within_their_bound(spark):
    """Comparisons of the pairs of nodes that are joined, counted: none above the bound."""
    train = [i for i in range(600)]
    t, e = frames(spark, train, train)
    ev = lk._per_value(e, "phash", "eval", "path").withColumnRenamed("phash", "eval_hash")
    tr = lk._per_value(t, "phash", "train", "path").withColumnRenamed("phash", "train_hash")
    left, right = lk._keyed(ev, "eval_hash", 7, 6), lk._keyed(tr, "train_hash", 7, 6).drop("top")
    full = lk._crowded_keys(left, right, 50)
    assert full.agg(F.max(F.col("e") * F.col("t"))).first()[0] == 600 * 600
    met = lk._trie_join(left, right, full, 6, 50)
    assert met.where(F.bit_count(F.col("eval_hash").bitwiseXOR(F.col("train_hash"))) > 6).count() < met.count() / 3
    twice = met.groupBy("mask", "eval_hash", "train_hash").count().where("count > 1")
    assert twice.isEmpty()


@pytest.mark.parametrize("distance,n", [(6, 3000), (2, 200), (0, 50)])
def test_groups_give_each_pair_once(spark, distance, n, monkeypatch):
    """In groups over many batches, cut into few comparisons at once, and the other way: the same pairs."""
    monkeypatch.setattr(lk, "AT_ONCE", 64)
    train, ev = hash_rows(n, n, distance + 4)
    ev += [0, -1, 1, train[0], None]
    train += [0, -1, signed((1 << 63) | 1)]
    t, e = frames(spark, train, ev)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, lk.near_hash_pairs(t, e, distance=distance).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == sorted(map(tuple, lk.near_hash_pairs(t, e, distance=distance, grouped=1).collect()))
    assert len(got) == len({g[:2] for g in got}) >= n / 5


def test_shuffled_rows_follow_the_hashes(spark, monkeypatch):
    """However many hashes there are, each is shuffled for distance + 1 groups and nothing is keyed anew."""
    monkeypatch.setattr(lk, "_keyed", None)
    for n in (50, 20_000):
        rng = random.Random(n)
        train, ev = [rng.getrandbits(60) for _ in range(n)], [rng.getrandbits(60) for _ in range(n)]
        pairs = lk.near_hash_pairs(*frames(spark, train, ev + train[:5]))
        assert {r.eval_hash for r in pairs.where("hamming_distance = 0").collect()} >= set(train[:5])


def crowd(rng, n, flips):
    """Hashes around one, a few far from it and some twice, of both signs."""
    middle, drawn = rng.getrandbits(64), [0, -1, None]
    while len(drawn) < n:
        value = middle
        for _ in range(rng.randrange(flips + 1)):
            value ^= 1 << rng.randrange(64)
        drawn.append(signed(value if rng.random() < 0.9 else rng.getrandbits(64)))
    return drawn + drawn[-5:]


def shuffled_rows(df):
    """Rows that the exchanges of the plan wrote when it ran."""
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
        elif name.endswith("QueryStage"):
            plans.append(plan.plan())
        elif name == "Exchange":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_near_pairs_of_a_crowd_are_not_shuffled(spark):
    """Pairs grow with the square of a crowd; what is shuffled for them, with the crowd."""
    rng = random.Random(4)
    middle = rng.getrandbits(60)
    train, ev = ([middle ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(400)] for _ in range(2))
    pairs = lk.near_hash_pairs(*frames(spark, train, ev), distance=4, bands=6, crowded=1 << 12)
    assert len(pairs.collect()) == len(set(train)) * len(set(ev)) > 50_000
    assert shuffled_rows(pairs) < 3 * (len(train) + len(ev))


@pytest.mark.parametrize("distance,crowded,block", [(4, 1, 1), (4, 4096, 50), (6, 100, 1 << 12)])
def test_blocks_and_groups_give_each_pair_once(spark, distance, crowded, block, monkeypatch):
    """Crowded hashes in blocks, the others in buckets of groups: every pair once, with counts and paths."""
    monkeypatch.setattr(nearblocks, "BLOCK", block)
    monkeypatch.setattr(nearblocks, "BUCKET", 20)
    monkeypatch.setattr(nearblocks, "CHUNK", 100)
    rng = random.Random(block)
    both = crowd(rng, 500, 5)
    train, ev = frames(spark, both[::2] + both[:40], both[1::2] + both[:40])
    # Some hashes have files without a path only.
    train = train.withColumn("path", F.when(F.col("phash") % 7 != 0, F.col("path")))
    got = lk.near_hash_pairs(train, ev, distance=distance, bands=distance + 2, crowded=crowded).collect()
    told = [
        {r.phash: (r.n, r.path) for r in side.where("phash IS NOT NULL").groupBy("phash").agg(F.count("*").alias("n"), F.min("path").alias("path")).collect()}
        for side in (ev, train)
    ]
    want = {
        (e, t, gap(e, t), e_n, t_n, e_path, t_path)
        for e, (e_n, e_path) in told[0].items() for t, (t_n, t_path) in told[1].items() if gap(e, t) <= distance
    }
    assert len(got) == len(want) > 5000 and set(map(tuple, got)) == want


@pytest.mark.parametrize("run", [1, 7, 16])
def test_runs_lose_no_pair(run):
    rng = np.random.default_rng(run)
    e, t = (np.unique(rng.integers(-(1 << 63), 1 << 63, 1) ^ (1 << rng.integers(0, 63, (n, 4))).sum(axis=1)) for n in (300, 157))
    t = np.unique(np.concatenate([t, e[::3] ^ 5]))
    want = {(i, j) for i in range(len(e)) for j in range(len(t)) if gap(int(e[i]), int(t[j])) <= 4}
    got = [pair for found in nearblocks.near_runs(e, t, 4, run) for pair in zip(*(part.tolist() for part in found))]
    assert len(got) == len(want) > 100 and set(got) == want


def listing(spark, rows):
    return spark.createDataFrame(rows, "path string, sha256 string, phash long")


def test_whole_check(spark):
    train = listing(spark, [
        ("pool/images/fg_auth_0001.png", "a", 0), ("pool/masks/fg_auth_0002.png", "b", 1), ("pool/notes.txt", "c", 2),
        ("pool/x_pre_holdout/fg_auth_0003.png", "d", 3), ("pool/images/fg_0004.png", "e", 1 << 40),
    ])
    told = spark.createDataFrame(
        [("pool/images/fg_auth_0001.png", None, 1), ("pool/images/fg_0004.png", "auth_0099.jpg", 1)],
        "path string, source string, label int",
    )
    ev = listing(spark, [
        ("set/authentic/auth_0001.jpg", "x", -1), ("set/authentic/auth_0099.jpg", "e", 7 << 20), ("set/authentic/auth_0005.jpg", "a", 0),
    ])
    split = spark.createDataFrame(
        [("auth_0001.jpg", "eval"), ("auth_0099.jpg", "eval"), ("auth_0005.jpg", "train")], "name string, side string"
    )
    checked = check_leakage(train, ev, told, split=split)
    report = checked.report.first()
    # auth_0005.jpg is not on the evaluation side of the split, so its content is no finding.
    assert (report.n_train_files, report.n_eval_files) == (2, 2)
    assert (report.n_train_with_source_id, report.n_eval_with_source_id) == (2, 2)
    assert (report.name_overlap_count, report.exact_duplicate_count, report.source_id_overlap_count) == (0, 1, 2)
    assert report.near_duplicate_count == 2 and report.verdict == "FAIL"
    assert {r.source_id for r in checked.by_source.collect()} == {"auth_0001", "auth_0099"}

    everything = check_leakage(train.limit(0), ev).report.first()
    assert everything.n_eval_files == 3 and everything.verdict == "PASS"
    both = split.unionByName(split.where("name = 'auth_0001.jpg'").withColumn("side", F.lit("train")))
    assert check_leakage(train.limit(0), ev, split=both).report.first().name_overlap_count == 1


def test_hot_split_join_keeps_every_row(spark):
    from tallymark.operators.joins import hot_split_join

    # One key holds a third of the rows; some keys are in neither or only one side.
    keys = [0] * 100 + [i % 20 for i in range(200)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k int")
    lookup = rows.where("k < 15").groupBy("k").count().withColumn("label", F.concat(F.lit("v"), F.col("k")))
    got = hot_split_join(rows, lookup, ["k"], "count", hot_keys=2).collect()
    assert sorted((r.id, r.label) for r in got) == [(i, f"v{k}") for i, k in enumerate(keys) if k < 15]
