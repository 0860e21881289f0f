"""SimHash near duplicates, compared bit-sliced.

A fingerprint is the sign of vertical bit counts over the hashes of a text's word shingles. Equal
fingerprints are one class from the start, so copies cost nothing afterwards. Different ones meet
in buckets of a blocking key; a bucket is compared as bit planes: plane *b* holds bit *b* of all
fingerprints, one lane each, and XOR with a query's bit feeds carry-save counters that update all
distances of a machine word at once. A query's block of 64 lanes is abandoned once all of them have
exceeded the radius.

Blocking keys:

* narrow fingerprints with a small radius: cut into ``radius + 2`` bands, every two bands are a key.
  At most ``radius`` bands differ, so two agree: no link is lost;
* wide fingerprints: the least shingle hashes of a text, shingles met in many texts apart from the
  others. Of two sets with similarity 0.8, each of the least hashes of both is shared with
  probability 0.8.

Near copies are decided by the exact similarity of the shingle sets. Links of wide fingerprints in a
generous radius only say which texts are compared: each candidate component is a bucket, in which
every two sets meet, so a link needs no fingerprint link of its own.

Buckets beyond a block are cut into chunks and every two chunks meet, so no task grows with a
bucket. A block hands on a spanning forest of its links, never all pairs.

Defined cases: a null or empty text has no words, fingerprint zero, linked like any other. A text of
fewer words than a shingle is one shingle. Rows without an id keep a row, and their component is the
least id reached, null if none has one. Repeated rows are equal members. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map, map_rows, space_words, store, unused
from tallymark.llm.components import connected_components
from tallymark.operators.joins import hot_split_join

SEED = 42
BLOCK = 2048
#: Least shingle hashes of a text that are keys.
SKETCH = 16
#: Shingles held by ``HOT_EVERY * HOT_LEAST`` texts or more are kept apart in the sketches, the
#: commonest ``HOT_MOST`` at most; buckets of the others are cut into chunks like any.
HOT_EVERY, HOT_LEAST, HOT_MOST = 32, 16, 100_000
#: Shingle hashes that a task adds up before it hands them on, and parts of them by leading bits.
HELD, PART_BITS = 1 << 21, 12
#: Shingles of a chunk of a candidate component.
CHUNK = 250_000
#: Places of a filter, at most: a bit each, in rows of ``F.bitmap_construct_agg``.
PLACES = 1 << 25
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words joined by one blank, repeats included."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts)
    )


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, lowest bit first, in rows of one or more 64-bit words."""
    rows = np.ascontiguousarray(hashes.reshape(len(hashes), -1)).view(np.uint8)
    counts = np.zeros(rows.shape[1] * 8, np.int64)
    for start in range(0, len(rows), 255):  # a byte holds 255
        bits = np.unpackbits(rows[start : start + 255], axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return counts


def widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit words from each hash, by a multiply and shift mixer."""
    salts = (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    mixed = hashes[:, None] + salts
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def fingerprint(text: str | None, size: int) -> tuple[bytes, np.ndarray]:
    """(fingerprint as little-endian bytes, twice the bit counts less the shingles), repeats included."""
    hashes = shingle_hashes(text, size)
    margins = 2 * bit_counts(hashes) - len(hashes) if len(hashes) else np.zeros(64, np.int64)
    return np.packbits(margins > 0, bitorder="little").tobytes(), margins


def wide_print(hashes: np.ndarray, words: int) -> bytes:
    """Fingerprint of ``words`` 64-bit words over a set of shingle hashes."""
    if not len(hashes):
        return bytes(8 * words)
    margins = 2 * bit_counts(widened(hashes, words)) - len(hashes)
    return np.packbits(margins > 0, bitorder="little").tobytes()


def sketch_keys(hashes: np.ndarray, hot: np.ndarray) -> list[int]:
    """The ``SKETCH`` least of the shingle hashes that are not in ``hot``, and of those that are.

    Each part counts if it is large enough to be shared: sets of similarity 0.8 differ by at most a
    fifth of either, so both sets have the one part at 0.4 or more of the set, or both have the other
    at 0.2 or more, and at least half of that part's union is shared.
    """
    if not len(hot):
        return hashes[:SKETCH].view(np.int64).tolist()
    common = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
    keys = []
    if 5 * np.count_nonzero(~common) >= 2 * len(hashes):
        keys += hashes[~common][:SKETCH].view(np.int64).tolist()
    if 5 * np.count_nonzero(common) >= len(hashes):
        keys += hashes[common][:SKETCH].view(np.int64).tolist()
    return keys


def within_radius(prints: np.ndarray, radius: int) -> np.ndarray:
    """Lanes as packed bits, a row for each fingerprint: which others differ in ``radius`` bits or less.

    ``prints``: rows of bytes. Planes on which all agree are skipped. Counters are kept in binary,
    one word of lanes for each digit; a carry out of the last digit, or a digit pattern above the
    radius at the end, marks a lane as exceeded.
    """
    n = len(prints)
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    ones = bits.sum(axis=0)
    varied = np.flatnonzero((ones > 0) & (ones < n))
    varied = varied[np.argsort(-np.minimum(ones, n - ones)[varied], kind="stable")]
    lanes = -(-n // 64)
    planes = np.zeros((len(varied), lanes * 8), np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits[:, varied].T, axis=1, bitorder="little")
    planes = planes.view(np.uint64)
    flips = np.where(bits[:, varied] > 0, ALL, np.uint64(0))
    digits = max(1, radius.bit_length())
    spare = np.zeros(lanes * 8, np.uint8)
    spare[: -(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
    spare = ~spare.view(np.uint64)
    out = np.zeros((n, lanes), np.uint64)
    tile = max(1, 65536 // lanes)
    for start in range(0, n, tile):
        query = np.repeat(np.arange(start, min(n, start + tile)), lanes)
        word = np.tile(np.arange(lanes), len(query) // lanes)
        over = spare[word]
        counters = [np.zeros(len(query), np.uint64) for _ in range(digits)]
        for b in range(len(varied)):
            carry = planes[b][word] ^ flips[query, b]
            for d in range(digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            over |= carry
            if b % 8 == 7:
                alive = (over | _above(counters, radius)) != ALL
                if not alive.all():
                    query, word, over = query[alive], word[alive], over[alive]
                    counters = [c[alive] for c in counters]
        out[query, word] = ~(over | _above(counters, radius))
    return out


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius: the highest digit in which they differ decides."""
    above = np.zeros_like(counters[0])
    equal = ~np.zeros_like(counters[0])
    for d in range(len(counters) - 1, -1, -1):
        if radius >> d & 1:
            equal &= counters[d]
        else:
            above |= equal & counters[d]
            equal &= ~counters[d]
    return above


def block_forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) links that connect what is connected in the block: never all pairs."""
    near = within_radius(prints, radius)
    linked = np.flatnonzero(
        np.bitwise_count(near).sum(axis=1) > 1  # each fingerprint is near itself
    )
    if not len(linked):
        return []
    n = len(prints)
    mask = np.unpackbits(near[linked].view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    labels = np.arange(n)
    while True:
        least = np.where(mask, labels[None, :], n).min(axis=1)
        if (least == labels[linked]).all():
            break
        labels[linked] = least
        labels = labels[labels]
    return [(int(i), int(labels[i])) for i in linked if labels[i] != i]


def compare_blocks(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the fingerprints of each bucket; ``rows``: (bucket, print), sorted.

    Whole buckets are packed into blocks of up to ``BLOCK`` rows, so that many small ones share the
    planes; links between neighbours in a block that share no bucket are links all the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        bucket, fill = None, 0

        def links(prints: list[bytes]) -> pa.RecordBatch:
            distinct = sorted(set(prints))
            forest = []
            if len(distinct) > 1:
                array = np.frombuffer(b"".join(distinct), np.uint8).reshape(len(distinct), -1)
                forest = block_forest(array, radius)
            return pa.RecordBatch.from_arrays(
                [pa.array([distinct[i] for i, _ in forest], pa.binary()),
                 pa.array([distinct[r] for _, r in forest], pa.binary())],
                names=["a", "b"],
            )

        for batch in batches:
            for at, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != bucket:
                    if fill >= BLOCK // 2:
                        yield links(held)
                        held, fill = [], 0
                    bucket = at
                held.append(found)
                fill += 1
        if held:
            yield links(held)

    return arrow_map(rows, run, "a binary, b binary")


def bucket_rows(keyed: DataFrame, places: bool = True) -> DataFrame:
    """(bucket, print) for every key held by two fingerprints or more; ``keyed``: (print, keys).

    ``places``: keys count only as equal at the same place of the array.

    Up to there a fingerprint is a hash of itself; only what shares a key is joined to its bits.
    Keys are counted by map-side aggregation. A key of more than ``BLOCK`` fingerprints is dealt
    into chunks by a hash of the fingerprint, and each two chunks form a bucket.
    """
    keyed = keyed.withColumn("member", F.xxhash64("print"))
    single = keyed.select("member", F.posexplode("keys").alias("table", "key"))
    if places:
        key = F.shiftleft(F.col("table").cast("long"), 32) + F.col("key")
        single = single.withColumn("key", key)
    single = single.select("member", "key")
    counts = store(
        single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes"
    )
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod("member", chunks).cast("int")
    others = F.when(
        chunks > 1,
        F.transform(
            F.filter(F.sequence(F.lit(0), chunks - 1), lambda j: j != F.col("own")),
            lambda j: F.xxhash64("key", F.least(j, "own"), F.greatest(j, "own")),
        ),
    ).otherwise(F.array("key"))
    met = hot_split_join(single, counts, ["key"], "n").withColumn("own", own)
    buckets = met.select(F.explode(others).alias("bucket"), "member")
    buckets = buckets.join(keyed.select("member", "print"), "member").select("bucket", "print")
    return buckets.repartition("bucket").sortWithinPartitions("bucket")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """(id, fingerprint hex, component_id): the least id reachable over links of ``radius`` bits."""
    bands = radius + 2
    edges = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    pairs = [masks[i] | masks[j] for i, j in combinations(range(bands), 2)]

    def work(rows: dict[str, list]) -> dict[str, list]:
        prints, keys = [], []
        for text in rows[text_col]:
            found, _ = fingerprint(text, shingle)
            prints.append(found)
            number = int.from_bytes(found, "little")
            keys.append(
                [xxhash.xxh32_intdigest((number & m).to_bytes(8, "little")) - (1 << 31) for m in pairs]
            )
        return {id_col: rows[id_col], "print": prints, "keys": keys}

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, print binary, keys array<int>"
    prints = store(map_rows(docs, [id_col, text_col], schema, work), "prints")
    classes = store(
        prints.groupBy("print").agg(
            F.min(id_col).alias("least_id"), F.count("*").alias("n"), F.first("keys").alias("keys")
        ),
        "classes",
    )
    links = compare_blocks(bucket_rows(classes.select("print", "keys")), radius)
    known = _least_members(classes.drop("keys"), links, "print")
    text = F.lower(F.hex(_descending("print")))
    joined = hot_split_join(prints.select(id_col, "print"), known, ["print"], "n")
    return joined.select(id_col, text.alias("fingerprint"), "component_id")


def _least_members(classes: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """(node, n, component_id) of every class (node, least_id, n): the least id of its component."""
    labels = store(connected_components(links), "labels").withColumnRenamed("node", node)
    known = classes.join(labels, node, "left").withColumn("root", F.coalesce("label", node))
    least = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return store(known.select(node, "n", "root").join(least, "root").drop("root"), "members")


#: Bits of 1024 up to which texts may be near copies. Texts of similarity 0.8 are expected to differ
#: in 155 bits, or 192 if they have four and five shingles, with a spread of up to 12.5.
WIDE_RADIUS = 256


def alike_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, root) links that connect all sets joined by similarities of 0.8 or more, exactly.

    Members met once leave the postings, so that a group of sets alike costs one look at each.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    held, posts = codes[order], np.repeat(np.arange(n), sizes)[order]
    numbers = np.arange(len(distinct) + 1)
    edges = np.searchsorted(held, numbers)
    left, standing, links = np.ones(n, bool), n, []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            at = queue.pop()
            mine = codes[starts[at] : starts[at] + sizes[at]]
            length = edges[mine + 1] - edges[mine]
            places = np.repeat(edges[mine] - (np.cumsum(length) - length), length)
            met = np.bincount(posts[places + np.arange(len(places))], minlength=n)
            found = np.flatnonzero(left & (5 * met >= 4 * (sizes + sizes[at] - met))).tolist()
            left[found] = False
            links += [(i, root) for i in found]
            queue += found
            if 2 * np.count_nonzero(left) < standing:
                standing = np.count_nonzero(left)
                stay = left[posts]
                held, posts = held[stay], posts[stay]
                edges = np.searchsorted(held, numbers)
    return links


def confirm_links(rows: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) of similarity 0.8 or more; ``rows``: (bucket, node, text), sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[bytes] = []
        sets: list[np.ndarray] = []
        bucket = None

        def links() -> pa.RecordBatch:
            forest = alike_forest(sets) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[i] for i, _ in forest], pa.binary()),
                 pa.array([nodes[r] for _, r in forest], pa.binary())],
                names=["a", "b"],
            )

        for batch in batches:
            for i, at in enumerate(batch.column(0).to_pylist()):
                if at != bucket:
                    yield links()
                    nodes.clear()
                    sets.clear()
                    bucket = at
                nodes.append(batch.column(1)[i].as_py())
                sets.append(np.unique(shingle_hashes(batch.column(2)[i].as_py(), shingle)))
        yield links()

    return arrow_map(rows, run, "a binary, b binary")


def hot_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold, counted over all texts; ``texts``: (text, ...).

    Tasks add up hashes and shuffle them as sorted arrays by their leading bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        fill = 0
        for batch in batches:
            for text in batch.column(0):
                held.append(np.unique(shingle_hashes(text.as_py(), shingle)))
                fill += len(held[-1])
                if fill >= HELD:
                    yield told(held)
                    held, fill = [], 0
        if fill:
            yield told(held)

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        parts = (hashes >> np.uint64(64 - PART_BITS)).astype(np.int32)
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(hashes)]))
        counts = counts.astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(parts[starts]), pa.array([hashes[i:j].tobytes() for i, j in spans], pa.binary()),
             pa.array([counts[i:j].tobytes() for i, j in spans], pa.binary())],
            names=["part", "hashes", "counts"],
        )

    least = HOT_EVERY * HOT_LEAST

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, fill = None, 0
        hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

        def merged() -> tuple[np.ndarray, np.ndarray]:
            distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
            return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)

        def often() -> pa.RecordBatch:
            distinct, n = merged()
            many = n >= least
            return pa.RecordBatch.from_arrays(
                [pa.array(distinct[many].view(np.int64)), pa.array(n[many])], names=["hash", "n"]
            )

        for batch in batches:
            for at, some, times in zip(*(column.to_pylist() for column in batch.columns)):
                if at != part:
                    yield often()
                    part, fill = at, 0
                    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
                hashes.append(np.frombuffer(some, np.uint64))
                counts.append(np.frombuffer(times, np.int32))
                fill += len(hashes[-1])
                if fill >= HELD:
                    distinct, n = merged()
                    hashes, counts, fill = [distinct], [n], 0
        yield often()

    held = arrow_map(texts.select("text"), run, "part int, hashes binary, counts binary")
    held = held.repartition("part").sortWithinPartitions("part")
    often = arrow_map(held, add_up, "hash long, n long")
    rows = often.orderBy(F.desc("n"), "hash").limit(HOT_MOST).collect()
    return np.sort(np.array([r.hash for r in rows], np.int64).view(np.uint64))


def marks(some: DataFrame, column: str) -> DataFrame:
    """(part, bits): a filter in which each hash of the column sets a bit; 4 MB, however many they are."""
    place = F.pmod(F.col(column), F.lit(PLACES)) + 1
    places = some.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    parts = places.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return store(parts, "filter")


def marked(rows: DataFrame, column: str, filters: DataFrame, flag: str) -> DataFrame:
    """The rows with ``flag``: true where the column's hash is among those marked, false for nearly all others.

    What is false can meet none of them, and need not be shuffled to find out.
    """
    place = F.pmod(F.col(column), F.lit(PLACES)) + 1
    part, bits = unused(rows, "part"), unused(rows, "bits")
    filters = F.broadcast(filters.select(F.col("part").alias(part), F.col("bits").alias(bits)))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.bit_get(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))
    met = rows.withColumn(part, F.bitmap_bucket_number(place)).join(filters, part, "left")
    return met.select(*(F.col(c) for c in rows.columns), found.alias(flag))


def near_groups(docs: DataFrame, shingle: int, words: int, radius: int) -> DataFrame:
    """(key, digest, component_id) of every row of ``docs`` (key, text, digest): the least key
    reachable over similarities of 0.8 or more between shingle sets."""
    docs = docs.withColumn("at", F.xxhash64("key", "digest"))
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_shingles(docs, shingle))

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in ("node", "print", "keys", "size")}
        for text in rows["text"]:
            hashes = np.unique(shingle_hashes(text, shingle))
            out["node"].append(xxhash.xxh3_128_digest(hashes.tobytes()))
            out["print"].append(wide_print(hashes, words))
            out["keys"].append(sketch_keys(hashes, hot.value))
            out["size"].append(len(hashes))
        return out | {name: rows[name] for name in ("key", "digest", "at")}

    kind = docs.schema["key"].dataType.simpleString()
    schema = f"key {kind}, digest long, at long, node binary, print binary, keys array<long>, size long"
    prints = store(map_rows(docs, ["key", "digest", "at", "text"], schema, work), "prints")
    classes = store(
        prints.groupBy("node").agg(
            F.min("key").alias("least_id"), F.count("*").alias("n"), F.min("at").alias("at"),
            *(F.first(name).alias(name) for name in ("print", "keys", "size")),
        ),
        "classes",
    )
    # Candidate components, and the texts of those that have two different sets or more.
    links = compare_blocks(bucket_rows(classes.select("print", "keys"), places=False), radius)
    labels = store(connected_components(links), "labels").withColumnRenamed("node", "print")
    rooted = classes.join(labels, "print", "left").select(
        "node", "at", "size", F.coalesce("label", "print").alias("root")
    )
    rooted = store(rooted, "rooted")
    sums = rooted.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("total"))
    sums = store(sums.where("m > 1"), "candidates")
    chunks = F.ceil(F.col("total") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    others = F.when(
        F.col("chunks") > 1,
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("own")),
            lambda j: F.xxhash64("root", F.least(j, "own"), F.greatest(j, "own")),
        ),
    ).otherwise(F.array(F.xxhash64("root")))
    met = hot_split_join(rooted, sums, ["root"], "m").withColumn("chunks", chunks)
    met = store(met.withColumn("own", own).select("at", "node", others.alias("buckets")), "met")
    texts = marked(docs.select("at", "text"), "at", marks(met, "at"), "may").where("may").join(met, "at")
    texts = texts.select(F.explode("buckets").alias("bucket"), "node", "text")
    texts = texts.repartition("bucket").sortWithinPartitions("bucket")
    known = _least_members(classes.select("node", "least_id", "n"), confirm_links(texts, shingle), "node")
    return hot_split_join(prints.select("key", "digest", "node"), known, ["node"], "n").drop("n", "node")


def without_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    words: int = 16,
    radius: int = WIDE_RADIUS,
) -> DataFrame:
    """The documents, all columns, with one of each group of near copies: that of the least id.

    Rows alike in id and text are one document. Rows without an id stay, unless alike in text to
    another row without one.
    """
    digest, place, at, may = (unused(docs, name) for name in ("digest", "place", "at", "may"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("key"), text.alias("text"), F.xxhash64(text).alias("digest")
    )
    members = near_groups(narrow, shingle, words, radius).groupBy("key", "digest").agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.expr("key <> component_id")), F.lit(False)).alias("gone")
    )
    # Most rows are alone and stay: they pass by the filter, and only the others are shuffled.
    members = store(members.where("n > 1 OR gone").withColumn("at", F.xxhash64("key", "digest")), "not-alone")
    gone = members.where("gone").select(F.col("key").alias(id_col), F.col("digest").alias(digest))
    rows = docs.withColumn(digest, F.xxhash64(text)).withColumn(at, F.xxhash64(id_col, digest))
    rows = marked(rows, at, marks(members, "at"), may)
    first = F.row_number().over(W.partitionBy(id_col, digest).orderBy(digest))
    looked_at = rows.where(may).join(gone, [id_col, digest], "left_anti").withColumn(place, first)
    return rows.where(~F.col(may)).select(*docs.columns).union(
        looked_at.where(F.col(place) == 1).select(*docs.columns)
    )


def _descending(column: str):
    """The 8 bytes of a little-endian number in descending weight."""
    parts = [F.substring(F.col(column), i, 1) for i in range(8, 0, -1)]
    return F.concat(*parts)
