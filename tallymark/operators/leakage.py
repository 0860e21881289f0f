"""Overlap of evaluation and training sets: same content, near hash, same source document.

Findings are kept per content hash (or pair of hashes, or source) with row counts on each side,
which holds every finding without listing the pairs of a popular hash; members are listed by
semi join, one row per file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import NEAR_HASH_DISTANCE
from tallymark.functions.vectors import hamming
from tallymark.operators.joins import hot_split_join
from tallymark.operators.nearblocks import agreeing, near_pairs
from tallymark.session import materialize, workers_know

HASH_BITS = 64

# Comparisons that one key or pair of trie nodes may take, and bits of a trie level.
CROWDED, TRIE_BITS = 1 << 16, 8

# Hashes of both sides that may meet in one group of a task, and comparisons made at once.
GROUPED, AT_ONCE = 1 << 16, 1 << 20


def _per_value(side: DataFrame, value: str, prefix: str, path: str) -> DataFrame:
    """(value, n_<prefix>, first_<prefix>_path), combined map-side."""
    return (
        side.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(
            F.count(F.lit(1)).alias(f"n_{prefix}"), F.min(path).alias(f"first_{prefix}_path")
        )
    )


def leak_exact(
    train: DataFrame, evaluation: DataFrame, digest: str = "sha256", path: str = "path"
) -> DataFrame:
    """(digest, n_eval, first_eval_path, n_train, first_train_path) of shared contents."""
    return _per_value(evaluation, digest, "eval", path).join(
        _per_value(train, digest, "train", path), digest
    )


def leak_exact_rows(
    train: DataFrame, evaluation: DataFrame, digest: str = "sha256", path: str = "path"
) -> DataFrame:
    """One row per leaked evaluation file: (path, digest, n_train, first_train_path)."""
    shared = leak_exact(train, evaluation, digest, path).select(
        digest, "n_eval", "n_train", "first_train_path"
    )
    return hot_split_join(
        evaluation.select(path, digest), shared, [digest], "n_eval", write_lookup=True
    ).drop("n_eval")


def leak_source(
    train: DataFrame, evaluation: DataFrame, source: str = "source_id", path: str = "path"
) -> DataFrame:
    """(source_id, n_eval, first_eval_path, n_train, first_train_path) of shared sources."""

    def named(side: DataFrame) -> DataFrame:
        return side.where(F.col(source) != "") if dict(side.dtypes)[source] == "string" else side

    return leak_exact(named(train), named(evaluation), source, path)


def leak_members(side: DataFrame, findings: DataFrame, key: str, count: str) -> DataFrame:
    """Rows of one side that take part in a finding; ``count`` is that side's n_ column."""
    return hot_split_join(side, findings.select(key, count), [key], count, write_lookup=True).drop(count)


def band_masks(bands: int) -> list[int]:
    """Bit masks that cut 64 bits into bands of nearly equal width, as signed longs."""
    edges = [round(i * HASH_BITS / bands) for i in range(bands + 1)]
    return [_signed(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(edges, edges[1:])]


def _signed(bits: int) -> int:
    return bits - (1 << HASH_BITS) if bits >= 1 << (HASH_BITS - 1) else bits


def _band_sets(bands: int, distance: int) -> list[tuple[int, int]]:
    """(highest band, union of the masks) for every choice of intact bands."""
    masks = band_masks(bands)
    return [
        (max(chosen), _signed(sum(masks[b] % (1 << HASH_BITS) for b in chosen)))
        for chosen in combinations(range(bands), bands - distance)
    ]


def _keyed(hashes: DataFrame, name: str, bands: int, distance: int) -> DataFrame:
    """One row per choice of bands: the choice (mask, top) and the bits it keeps."""
    structs = ", ".join(
        f"named_struct('top', {top}, 'mask', bigint('{mask}'))"
        for top, mask in _band_sets(bands, distance)
    )
    choices = F.expr(f"array({structs})")
    return (
        hashes.withColumn("_c", F.explode(choices))
        .withColumn("top", F.col("_c.top"))
        .withColumn("mask", F.col("_c.mask"))
        .withColumn("bits", F.col(name).bitwiseAND(F.col("mask")))
        .drop("_c")
    )


def candidate_count(evaluation: DataFrame, train: DataFrame, bands: int, distance: int) -> int:
    """Comparisons a banding needs, from per-key counts only."""
    sides = [
        _keyed(side.select("phash"), "phash", bands, distance)
        .groupBy("mask", "bits")
        .agg(F.count(F.lit(1)).alias(name))
        for side, name in ((evaluation, "_e"), (train, "_t"))
    ]
    row = sides[0].join(sides[1].hint("merge"), ["mask", "bits"]).agg(
        F.sum(F.col("_e").cast("double") * F.col("_t")).alias("n")
    ).first()
    return int(row.n or 0)


def choose_bands(
    evaluation: DataFrame,
    train: DataFrame,
    distance: int = NEAR_HASH_DISTANCE,
    per_key: int = 500,
    most_keys: int = 1000,
) -> int:
    """The fewest bands whose measured comparisons are worth their keys, else those with the least.

    A key row is shuffled and a comparison is a few instructions, so ``per_key`` comparisons are
    taken to cost as much as a key. With more bands a hash has more keys and each keeps more
    bits, which also splits keys that many hashes share: the counts are those of the data. Where
    hashes crowd within a few bits, no banding may do; ``near_hash_pairs``, which deals hashes to the
    same few groups whatever their number, cuts such keys into blocks.
    """
    rows = evaluation.count() + train.count()
    options = [
        bands
        for bands in range(distance + 1, HASH_BITS)
        if comb(bands, distance) <= most_keys
    ]
    measured: dict[int, int] = {}
    for bands in options:
        measured[bands] = candidate_count(evaluation, train, bands, distance)
        if measured[bands] <= per_key * comb(bands, distance) * rows:
            return bands
    return min(options, key=lambda bands: measured[bands])


def _grouped_pairs(ev: DataFrame, tr: DataFrame, distance: int, grouped: int) -> DataFrame | None:
    """(eval_hash, train_hash) within the distance, or nothing if a group has more than ``grouped`` hashes.

    Of ``distance`` + 2 bands two must agree, and the lower one is none of the last: a hash goes to
    a group for each of the first ``distance`` + 1 bands, however many hashes there are, and meets
    the others of its group that agree in a later band, by sorted arrays inside the task. A pair is
    kept where its two lowest agreeing bands meet, hence once. Rows hold a hash and two small
    numbers. Runs a job, which counts the groups.
    """
    bands = distance + 2
    masks = band_masks(bands)
    bits = F.expr(f"hash & element_at(array({', '.join(f'bigint({chr(39)}{m}{chr(39)})' for m in masks)}), band + 1)")
    sides = [
        side.select(F.col(name).alias("hash"), F.lit(number).cast("tinyint").alias("side"))
        for number, (side, name) in enumerate(((ev, "eval_hash"), (tr, "train_hash")))
    ]
    rows = sides[0].unionByName(sides[1]).select(
        "hash", "side", F.explode(F.array(*(F.lit(b).cast("tinyint") for b in range(bands - 1)))).alias("band")
    )
    sizes = rows.groupBy("band", bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > grouped:
        return None
    at_once = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(masks, np.int64)
        held: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            """The pairs of the group in hand: rows of hash, side and band."""
            hashes, side, band = np.concatenate(held, axis=1)
            e, t = hashes[side == 0], hashes[side == 1]
            if len(e) and len(t):
                for i, j in agreeing(e, t, int(band[0]), masks, distance, at_once):
                    yield pa.RecordBatch.from_arrays([pa.array(e[i]), pa.array(t[j])], names=["eval_hash", "train_hash"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            key = np.stack([columns[2], columns[0] & own[columns[2]]])
            groups = np.split(columns, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, axis=1)
            if held:
                last = held[-1][:, -1]
                if last[2] != key[0, 0] or last[0] & own[last[2]] != key[1, 0]:
                    yield from done()
                    held = []
            for group in groups[:-1]:
                held.append(group)
                yield from done()
                held = []
            held.append(groups[-1])
        if held:
            yield from done()

    dealt = rows.repartition("band", bits).sortWithinPartitions("band", bits, "side")
    return dealt.mapInArrow(run, "eval_hash long, train_hash long")


def near_hash_pairs(
    train: DataFrame,
    evaluation: DataFrame,
    distance: int = NEAR_HASH_DISTANCE,
    bands: int | None = None,
    path: str = "path",
    crowded: int = CROWDED,
    grouped: int = GROUPED,
) -> DataFrame:
    """Pairs of distinct 64-bit hashes within ``distance``, with row counts on each side.

    Unless bands are given, a hash is shuffled once for each of d + 1 groups, bare, and the rest of
    the work is done inside the groups; counts and paths are joined to the pairs found. If more than
    ``grouped`` hashes share a group, or bands are given, all go the other way (``near_pairs``): counts
    and paths travel with the hashes, groups of more than ``crowded`` comparisons are cut into blocks,
    and nothing but the rows returned grows with the pairs. Rows without a hash are left out. Runs jobs:
    distinct hashes are written and groups counted.

    Groups, blocks and hashes grow with the data, so no join is by broadcast: one chosen by the size
    of compressed rows would gather a side in the driver.
    """
    workers_know(train.sparkSession)
    ev = _per_value(evaluation, "phash", "eval", path).withColumnRenamed("phash", "eval_hash")
    tr = _per_value(train, "phash", "train", path).withColumnRenamed("phash", "train_hash")
    if bands is None:
        ev, tr = materialize(ev), materialize(tr)
        pairs = _grouped_pairs(ev, tr, distance, grouped) if distance + 2 <= HASH_BITS else None
        if pairs is not None:
            return _told(pairs.join(ev.hint("merge"), "eval_hash").join(tr.hint("merge"), "train_hash"))
    masks = band_masks(max(bands or 0, distance + 2))
    return near_pairs(ev, tr, masks, distance, crowded, grouped, AT_ONCE)


def _told(met: DataFrame) -> DataFrame:
    return met.select(
        "eval_hash",
        "train_hash",
        hamming(F.col("eval_hash"), F.col("train_hash")).alias("hamming_distance"),
        "n_eval",
        "n_train",
        "first_eval_path",
        "first_train_path",
    )


def _crowded_keys(left: DataFrame, right: DataFrame, crowded: int) -> DataFrame:
    """(mask, bits, e, t) of the keys that would take more than ``crowded`` comparisons."""
    counts = [
        side.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias(name))
        for side, name in ((left, "e"), (right, "t"))
    ]
    return counts[0].join(counts[1].hint("merge"), ["mask", "bits"]).where(F.col("e") * F.col("t") > crowded)


def _trie_join(
    left: DataFrame, right: DataFrame, full: DataFrame, distance: int, crowded: int
) -> DataFrame:
    """Pairs of the crowded keys that may be within the distance, by a bit trie below each key.

    A node is a key and the low bits of its hashes, eight more on each level. Pairs of an
    evaluation and a training node start at the key; a pair of more than ``crowded`` comparisons
    is replaced by the pairs of its children whose bits so far differ in at most ``distance``
    places, found from counts of hashes per child (at most 256 x 256 per pair). Nodes cut the
    hashes of a key apart, so that no pair of hashes is met twice, and nodes of all bits hold one
    hash, so that every pair of nodes ends within the bound whatever the data. Runs a job a level.
    """
    pairs = full.select(
        "mask", F.col("bits").alias("e_node"), F.col("bits").alias("t_node"), F.lit(0).alias("spent"),
    )
    met = []
    for level in range(HASH_BITS // TRIE_BITS):
        above = _signed((1 << TRIE_BITS * level) - 1)
        below = _signed((1 << TRIE_BITS * (level + 1)) - 1)
        own = _signed(((1 << TRIE_BITS) - 1) << TRIE_BITS * level)

        def node(name: str, bits: int) -> Column:
            return F.col(name).bitwiseAND(F.col("mask").bitwiseOR(F.lit(bits)))

        def children(side: DataFrame, name: str, parent: str, child: str, count: str) -> DataFrame:
            live = pairs.select("mask", parent).distinct()
            rows = side.select("mask", node(name, above).alias(parent), node(name, below).alias(child))
            return (
                rows.groupBy("mask", parent, child).agg(F.count(F.lit(1)).alias(count))
                .join(live.hint("merge"), ["mask", parent], "left_semi")
                .hint("merge")
            )

        apart = F.bit_count(F.col("e_child").bitwiseXOR(F.col("t_child")).bitwiseAND(F.lit(own)))
        grown = (
            pairs.join(children(left, "eval_hash", "e_node", "e_child", "e"), ["mask", "e_node"])
            .join(children(right, "train_hash", "t_node", "t_child", "t"), ["mask", "t_node"])
            .withColumn("spent", F.col("spent") + apart)
            .where(F.col("spent") <= distance)
            .select("mask", F.col("e_child").alias("e_node"), F.col("t_child").alias("t_node"), "spent", "e", "t")
        )
        grown = materialize(grown)
        few = F.col("e") * F.col("t") <= crowded
        met.append(
            left.withColumn("e_node", node("eval_hash", below))
            .join(grown.where(few).select("mask", "e_node", "t_node").hint("merge"), ["mask", "e_node"])
            .join(right.drop("bits").withColumn("t_node", node("train_hash", below)).hint("merge"), ["mask", "t_node"])
            .drop("e_node", "t_node")
        )
        pairs = grown.where(~few).drop("e", "t")
        if pairs.isEmpty():
            break
    return reduce(DataFrame.unionByName, met)


def near_pair_count(pairs: DataFrame) -> DataFrame:
    """Number of near file pairs, counted from the hash pairs."""
    return pairs.agg(
        F.coalesce(F.sum(F.col("n_eval") * F.col("n_train")), F.lit(0)).alias("near_duplicate_count")
    )


def near_rows(evaluation: DataFrame, pairs: DataFrame, path: str = "path") -> DataFrame:
    """One row per evaluation file with a near training file: count and least distance."""
    per_hash = pairs.groupBy(F.col("eval_hash").alias("phash")).agg(
        F.first("n_eval").alias("_n"),
        F.sum("n_train").alias("n_train"),
        F.min("hamming_distance").alias("min_distance"),
        F.min_by("first_train_path", F.struct("hamming_distance", "first_train_path"))
        .alias("nearest_train_path"),
    )
    rows = evaluation.select(path, "phash")
    return hot_split_join(rows, per_hash, ["phash"], "_n", write_lookup=True).drop("_n")


def leak_verdict(
    name_overlap: DataFrame, exact: DataFrame, near: DataFrame, by_source: DataFrame
) -> DataFrame:
    """One row of counts and FAIL, CHECK or PASS.

    Names on both sides of the split, equal contents and near hashes fail; a shared source alone
    asks for a check.
    """

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    def total(df: DataFrame, value: Column) -> Column:
        return df.agg(F.coalesce(F.sum(value), F.lit(0))).scalar()

    counts = name_overlap.sparkSession.range(1).select(
        size(name_overlap).alias("name_overlap_count"),
        total(exact, F.col("n_eval")).alias("exact_duplicate_count"),
        total(near, F.col("n_eval") * F.col("n_train")).alias("near_duplicate_count"),
        size(by_source).alias("source_id_overlap_count"),
    )
    return counts.withColumn(
        "verdict",
        F.when(F.col("name_overlap_count") > 0, "FAIL")
        .when((F.col("exact_duplicate_count") > 0) | (F.col("near_duplicate_count") > 0), "FAIL")
        .when(F.col("source_id_overlap_count") > 0, "CHECK")
        .otherwise("PASS"),
    )
