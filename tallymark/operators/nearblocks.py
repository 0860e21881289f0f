"""Near pairs of 64-bit hashes of two sides, with nothing written or shuffled that grows with the pairs.

Hashes travel with their counts and paths, packed, to where they meet, so that a pair found is
told on the spot. They meet in groups of equal bits; those of crowded groups, where many pairs are
near whatever the bits, meet in blocks instead, a fixed number of copies of each dealt to a square of
tasks. Disk grows with the hashes; only the rows returned grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import fresh_path

# Hashes of a run (at most) and of a block; pairs of runs compared at once; pairs told in a batch.
RUN, BLOCK, RUNS_AT_ONCE, TOLD = 16, 1 << 12, 1 << 12, 1 << 16

# Hashes of a side that a task holds at most, as far as the largest group tells.
PART = 1 << 20

# Hashes that a task deals at once; hashes of a bucket of groups, and buckets of a band at most.
CHUNK, BUCKET, BUCKETS = 1 << 19, 1 << 14, 1 << 12

# A group is crowded above so many times the hashes that even ones would give it.
UNEVEN = 8

PACKED = "size int, cut int, data binary"
FOUND = ("eval_hash", "train_hash", "hamming_distance", "n_eval", "n_train", "first_eval_path", "first_train_path")


def near_pairs(
    ev: DataFrame, tr: DataFrame, masks: Sequence[int], distance: int, crowded: int, grouped: int, at_once: int
) -> DataFrame:
    """Pairs within ``distance``, once each; ``masks`` are those of ``distance`` + 2 bands or more.

    At least two bands agree, and the lowest of them is one of the first ``distance`` + 1: a hash goes
    to a group for each of these, however many hashes there are, and a pair is kept where its lowest
    agreeing band is the group's. Hashes of a crowded group are flagged. Two flagged ones meet in
    blocks and nowhere else; any other pair meets in a group that is not crowded. Runs jobs: distinct
    hashes are written and groups counted; the crowded groups, few by their size, are told to the tasks.
    """
    masks = list(masks)
    kind = dict(ev.dtypes)["first_eval_path"], dict(tr.dtypes)["first_train_path"]
    ev, tr = (_written(_plain(side, name)) for side, name in ((ev, "eval"), (tr, "train")))
    total = ev.count() + tr.count()
    full, most = _crowded_groups(ev, tr, masks[: distance + 1], total, crowded, grouped)
    found = _grouped(ev, tr, masks, distance, full, total, at_once)
    if most:
        run = max(1, min(RUN, isqrt(crowded)))
        found = found.unionByName(_blocked(ev, tr, masks, distance, full, most, run))
    return found.withColumns(
        {f"first_{name}_path": F.col(f"first_{name}_path").cast(own) for name, own in zip(("eval", "train"), kind)}
    )


def _plain(side: DataFrame, name: str) -> DataFrame:
    return side.select(
        F.col(f"{name}_hash").alias("hash"), F.col(f"n_{name}").alias("n"), F.col(f"first_{name}_path").cast("string").alias("path"),
    )


def _written(df: DataFrame) -> DataFrame:
    """Written in columns: a fourth of what a checkpoint of such narrow rows takes."""
    path = fresh_path(df.sparkSession, "hashes")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _crowded_groups(
    ev: DataFrame, tr: DataFrame, masks: list[int], total: int, crowded: int, grouped: int
) -> tuple[list[np.ndarray], int]:
    """For each band the bits of its crowded groups, and the hashes of a side in the largest.

    Crowded is a group of more than ``crowded`` comparisons or ``grouped`` hashes, if even hashes
    would give it far fewer; they would fill all groups alike, and no block would split them better.
    """
    sides = [side.select("hash", F.lit(number).alias("side")) for number, side in enumerate((ev, tr))]
    band = F.explode(F.array(*(F.lit(b) for b in range(len(masks)))))
    own = ", ".join(f"bigint('{mask}')" for mask in masks)
    even = ", ".join(f"{total / 2 ** (mask % (1 << 64)).bit_count()!r}D" for mask in masks)
    groups = (
        sides[0].unionByName(sides[1])
        .select("hash", "side", band.alias("band"))
        .groupBy("band", F.expr(f"hash & element_at(array({own}), band + 1)").alias("bits"))
        .agg(F.count(F.when(F.col("side") == 0, 1)).alias("e"), F.count(F.when(F.col("side") == 1, 1)).alias("t"))
        .where("e > 0 AND t > 0")
        .where(
            f"(e + t > {UNEVEN} * element_at(array({even}), band + 1) AND (e + t > {grouped} OR e * t > {crowded}))"
            f" OR e + t > 16 * {grouped}"
        )
        .collect()
    )
    full = [np.array([g.bits for g in groups if g.band == b], np.int64) for b in range(len(masks))]
    return full, max((max(g.e, g.t) for g in groups), default=0)


def _in_crowd(hashes: np.ndarray, masks: list[int], full: list[np.ndarray]) -> np.ndarray:
    """For each band, whether the hashes are in one of its crowded groups."""
    return np.stack([np.isin(hashes & mask, bits) for mask, bits in zip(masks, full)])


# --- packed hashes ----------------------------------------------------------------------------


def _packed(hashes: pa.RecordBatch) -> tuple[int, int, bytes]:
    """(size, cut, bytes) of columns hash, n, path, tag: lengths of paths pack better than offsets."""
    path = hashes.column(2)
    chars = path.buffers()[2]
    lengths = pc.binary_length(path)
    rest = [hashes.column(0), hashes.column(1), lengths, hashes.column(3)]
    head = pa.RecordBatch.from_arrays(rest, names=["hash", "n", "length", "tag"]).serialize()
    raw = head.to_pybytes() + (chars.to_pybytes()[: pc.sum(lengths).as_py() or 0] if chars else b"")
    return len(raw), head.size, pa.Codec("zstd", 1).compress(raw, asbytes=True)


_HEAD = pa.schema([("hash", pa.int64()), ("n", pa.int64()), ("length", pa.int32()), ("tag", pa.int8())])


def _unpacked(size: int, cut: int, data: bytes) -> pa.RecordBatch:
    raw = pa.Codec("zstd", 1).decompress(data, decompressed_size=size)
    head = pa.ipc.read_record_batch(raw.slice(0, cut), _HEAD)
    lengths = head.column(2)
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths.fill_null(0).to_numpy(), out=offsets[1:])
    path = pa.Array.from_buffers(pa.string(), len(lengths), [lengths.buffers()[0], pa.py_buffer(offsets), raw.slice(cut)])
    return pa.RecordBatch.from_arrays([head.column(0), head.column(1), path, head.column(3)], names=["hash", "n", "path", "tag"])


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of fresh buffers; paths as plain strings."""
    table = pa.Table.from_batches(batches)
    at = table.schema.get_field_index("path")
    table = table.set_column(at, "path", table.column(at).cast(pa.string()))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c.chunks) for c in table.columns], names=table.schema.names)


def _told(
    e: pa.RecordBatch, t: pa.RecordBatch, found: Iterator[tuple[np.ndarray, np.ndarray]]
) -> Iterator[pa.RecordBatch]:
    """The pairs found, as places in both batches, with counts and paths."""
    (e_hash, e_n), (t_hash, t_n) = ([side.column(k).to_numpy() for k in (0, 1)] for side in (e, t))
    for every_i, every_j in found:
        for start in range(0, len(every_i), TOLD):
            i, j = every_i[start : start + TOLD], every_j[start : start + TOLD]
            left, right = e_hash[i], t_hash[j]
            gap = np.bitwise_count((left ^ right).view(np.uint64)).astype(np.int32)
            columns = [left, right, gap, e_n[i], t_n[j], e.column(2).take(pa.array(i)), t.column(2).take(pa.array(j))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=FOUND)


# --- groups of equal bits ---------------------------------------------------------------------


def agreeing(
    e: np.ndarray, t: np.ndarray, band: int, masks: Sequence[int], distance: int, at_once: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the distance whose lowest agreeing band is ``band``.

    They agree in a later band too: sorted arrays meet on both, and a pair is kept at the lowest
    such band, hence once. At most about ``at_once`` comparisons are made at once.
    """
    for later in range(band + 1, len(masks)):
        both = masks[band] | masks[later]
        kept = t & both
        order = np.argsort(kept)
        kept, wanted = kept[order], e & both
        first = np.searchsorted(kept, wanted)
        n = np.searchsorted(kept, wanted, "right") - first
        some = np.flatnonzero(n)
        part = np.cumsum(n[some]) // at_once
        for i in np.split(some, np.flatnonzero(np.diff(part)) + 1):
            own = n[i]
            j = order[np.arange(own.sum()) + np.repeat(first[i] - np.cumsum(own) + own, own)]
            i = np.repeat(i, own)
            gap = e[i] ^ t[j]
            near = np.flatnonzero(np.bitwise_count(gap.view(np.uint64)) <= distance)
            i, j, gap = i[near], j[near], gap[near]
            lowest = np.ones(len(i), bool)
            for b in range(later):
                if b != band:
                    lowest &= (gap & masks[b]) != 0
            if lowest.any():
                yield i[lowest], j[lowest]


def _grouped(
    ev: DataFrame, tr: DataFrame, masks: list[int], distance: int, full: list[np.ndarray], total: int, at_once: int
) -> DataFrame:
    """Pairs that meet in a group that is not crowded: all but those of two flagged hashes.

    Groups are dealt by buckets of some thousand hashes. A task packs the hashes it sends to a
    bucket, so that a row of the shuffle holds hundreds of them and takes little more than their bits.
    """
    buckets = max(1, min(BUCKETS, total // BUCKET))

    def dealt(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _whole(held)
        hashes = rows.column(0).to_numpy()
        crowd = _in_crowd(hashes, masks[: distance + 1], full)
        tag = rows.column(3).to_numpy() + 2 * crowd.any(axis=0).astype(np.int8)
        rows = rows.set_column(3, "tag", pa.array(tag))
        for band in range(distance + 1):
            mine = np.flatnonzero(~crowd[band])
            mixed = (hashes[mine] & masks[band]).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(4 * bucket + tag[mine], kind="stable")
            mine, bucket = mine[order], bucket[order]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
            sent = [
                (band, int(bucket[lo]), *_packed(rows.take(pa.array(mine[lo:hi])))) for lo, hi in zip(edges, edges[1:]) if hi > lo
            ]
            if sent:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                names = ["band", "bucket", "size", "cut", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sent), kinds)], names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from dealt(held)
                held, n = [], 0
        if n:
            yield from dealt(held)

    def met(held: list[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
        rows = _whole(held)
        tag = rows.column(3).to_numpy()
        parts = [rows.take(pa.array(np.flatnonzero(tag == k))) for k in range(4)]
        every, plain = _whole([parts[0], parts[2]]), parts[0]
        for e, t in ((every, parts[1]), (plain, parts[3])):
            if e.num_rows and t.num_rows:
                yield from _told(e, t, agreeing(e.column(0).to_numpy(), t.column(0).to_numpy(), band, masks, distance, at_once))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for band, bucket, size, cut, data in zip(*columns, batch.column(4)):
                if key != (band, bucket):
                    if held:
                        yield from met(held, key[0])
                    held, key = [], (band, bucket)
                held.append(_unpacked(size, cut, data.as_buffer()))
        if held:
            yield from met(held, key[0])

    sides = [side.withColumn("side", F.lit(number).cast("tinyint")) for number, side in enumerate((ev, tr))]
    sent = sides[0].unionByName(sides[1]).mapInArrow(deal, f"band int, bucket int, {PACKED}")
    return sent.repartition("band", "bucket").sortWithinPartitions("band", "bucket").mapInArrow(meet, _schema())


def _schema() -> str:
    kinds = ("long", "long", "int", "long", "long", "string", "string")
    return ", ".join(f"{name} {kind}" for name, kind in zip(FOUND, kinds))


# --- blocks of crowded hashes -----------------------------------------------------------------


def _runs(hashes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a sorted array as columns (the last one filled up), and the bits alike in each."""
    columns = np.pad(hashes, (0, -len(hashes) % run), "edge").reshape(-1, run).T.copy()
    return columns, ~(np.bitwise_or.reduce(columns) ^ np.bitwise_and.reduce(columns))


def near_runs(e: np.ndarray, t: np.ndarray, distance: int, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within the distance, once each, in two sorted arrays.

    Two runs are compared, in ``run`` squared comparisons, only if the bits alike in both leave them within the distance.
    """
    (e_runs, e_same), (t_runs, t_same) = _runs(e, run), _runs(t, run)
    places, padded = np.arange(run)[:, None], len(e) % run or len(t) % run
    slab = max(1, (1 << 16) // len(t_same))
    for start in range(0, len(e_same), slab):
        cut = slice(start, start + slab)
        apart = (e_runs[0, cut, None] ^ t_runs[0]) & e_same[cut, None] & t_same
        lefts, rights = np.nonzero(np.bitwise_count(apart.view(np.uint64)) <= distance)
        lefts += start
        for some in range(0, len(lefts), RUNS_AT_ONCE):
            left, right = lefts[some : some + RUNS_AT_ONCE], rights[some : some + RUNS_AT_ONCE]
            ours, theirs = e_runs[:, left], t_runs[:, right]
            i, j = left * run + places, right * run + places
            theirs, j = np.concatenate([theirs, theirs]), np.concatenate([j, j])
            found = []
            for turn in range(run):
                gap = (ours ^ theirs[turn : turn + run]).view(np.uint64)
                near = np.flatnonzero(np.bitwise_count(gap) <= distance)
                found.append((i.ravel()[near], j[turn : turn + run].ravel()[near]))
            i, j = (np.concatenate(part) for part in zip(*found))
            if padded:
                real = (i < len(e)) & (j < len(t))
                i, j = i[real], j[real]
            if len(i):
                # Rows of a hash one after the other, which a writer of columns packs best.
                order = np.argsort((i - left[0] * run).astype(np.uint16 if len(e) <= 1 << 16 else np.int64), kind="stable")
                yield i[order], j[order]


def _blocked(
    ev: DataFrame, tr: DataFrame, masks: list[int], distance: int, full: list[np.ndarray], most: int, run: int
) -> DataFrame:
    """Pairs of two flagged hashes: sorted, packed in blocks, and dealt to a square of cells that compare them.

    Each side is cut into as many parts as the square has rows, and a block goes to every cell of its
    row or column: it is shuffled eight times, whatever the number of pairs, and a cell holds its
    part of one side (about ``PART`` hashes; the square grows beyond that) and reads the other's blocks.
    """
    parts = max(min(8, -(-most // 1024)), -(-most // PART))
    names = ["cell", "side", "one", "same", "size", "cut", "data"]
    kinds = (pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowd = _in_crowd(batch.column(0).to_numpy(), masks[: distance + 1], full).any(axis=0)
            yield batch.filter(pa.array(crowd))

    def pack(side: int):
        def block(rows: pa.RecordBatch, part: int) -> pa.RecordBatch:
            rows = rows.append_column("tag", pa.array(np.zeros(rows.num_rows, np.int8)))
            columns, same = _runs(rows.column(0).to_numpy(), rows.num_rows)
            packed = _packed(rows.take(pa.array(np.arange(rows.num_rows))))
            cells = [k * parts + part if side else part * parts + k for k in range(parts)]
            row = ([x] * parts for x in (side, columns[0, 0], same[0], *packed))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((cells, *row), kinds)], names=names)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Neighbours, which have the most pairs, go to different parts.
            held, n, made = [], 0, TaskContext.get().partitionId()
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                while n >= BLOCK:
                    rows = _whole(held)
                    yield block(rows.slice(0, BLOCK), made % parts)
                    held, n, made = [rows.slice(BLOCK)], n - BLOCK, made + 1
            if n:
                yield block(_whole(held), made % parts)

        return packed

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            small = [batch.column(k).to_pylist() for k in range(6)]
            for own, side, one, same, size, cut, data in zip(*small, batch.column(6)):
                if own != cell:
                    held, cell = [], own
                block = _unpacked(size, cut, data.as_buffer())
                if not side:
                    held.append((one, same, block))
                    continue
                hashes = block.column(0).to_numpy()
                for e_one, e_same, e in held:
                    if ((e_one ^ one) & e_same & same & ((1 << 64) - 1)).bit_count() <= distance:
                        yield from _told(e, block, near_runs(e.column(0).to_numpy(), hashes, distance, run))

    dealt = [
        side.mapInArrow(keep, side.schema)
        .repartitionByRange("hash").sortWithinPartitions("hash")
        .mapInArrow(pack(number), f"cell int, side tinyint, one long, same long, {PACKED}")
        for number, side in enumerate((ev, tr))
    ]
    cells = dealt[0].unionByName(dealt[1]).repartitionById(parts * parts, "cell")
    return cells.sortWithinPartitions("cell", "side").mapInArrow(compare, _schema())
