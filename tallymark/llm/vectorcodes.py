"""Vector codes: a codebook for each part of the vectors, by dual-tree Lloyd rounds on integers.

Vectors become integers and are cut into equal parts. Tasks keep them in blocks, and each part of
a block in a balanced tree of boxes whose nodes hold counts and sums; the trees are made once and
written to the shared folder. In a round, the codebook of a part is a tree too. Pairs of a block
node and a codebook node are split together: the greatest distance between the boxes of one such
pair bounds what any row of the node has to its nearest entry, and pairs whose least distance
exceeds that bound are dropped. A node with one entry left is assigned whole, by its cached count
and sum; rows of leaves that stay uncertain are compared with the entries left, as integers. All
distances are exact 64-bit integers and only strictly worse pairs are dropped, so that the result
equals that of comparing everything, ties to the lower index included.

A round is one job: tasks add up counts and sums by part, entry and component, Spark adds those
up, and the driver receives one number for each component of each entry, whatever the data.
Building runs jobs (one for each round, and those that write trees, codes and label totals).

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors
shorter than the longest, empty ones too, and lengths that the number of parts does not divide are
filled up with zeros; fewer vectors than entries give a smaller codebook; repeated rows and equal
ids count as rows of their own, entries starting in the order of ids, null last, then vectors;
null labels are one label; an empty table has no rows; components of 4096 and more in size raise,
since distances would leave 64 bits; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import _arrow_schema, arrow_map
from tallymark.operators.joins import hot_split_join
from tallymark.session import materialize

#: Rows of a block, and of a leaf of its trees.
BLOCK_ROWS, LEAF_ROWS = 4096, 32
#: Integers at or beyond this are refused.
LIMIT = 1 << 24


class Tree:
    """A balanced tree over points with weights: boxes, counts and sums of every level's nodes."""

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        size = -(-n // (1 << depth)) << depth
        if order is None:
            # The last point fills up the leaves, with no weight.
            order = np.minimum(np.arange(size), n - 1)
            weight = np.arange(size) < n
            for level in range(depth):
                run = points[order].reshape(1 << level, -1, points.shape[1])
                widest = (run.max(axis=1) - run.min(axis=1)).argmax(axis=1)
                key = np.take_along_axis(run, widest[:, None, None], axis=2)[:, :, 0]
                turn = key.argsort(axis=1, kind="stable")
                order = np.take_along_axis(order.reshape(1 << level, -1), turn, axis=1).ravel()
                weight = np.take_along_axis(weight.reshape(1 << level, -1), turn, axis=1).ravel()
            order = np.where(weight, order, -order - 1)
        self.depth, self.order = depth, order
        weight = order >= 0
        self.rows = np.where(weight, order, -order - 1)
        self.weight = weight.reshape(1 << depth, -1)
        self.points = points[self.rows].reshape(1 << depth, -1, points.shape[1])
        self.low, self.high = [self.points.min(axis=1)], [self.points.max(axis=1)]
        self.count = [self.weight.sum(axis=1)]
        self.sum = [(self.points * self.weight[:, :, None]).sum(axis=1)]
        for _ in range(depth):
            self.low.append(np.minimum(self.low[-1][::2], self.low[-1][1::2]))
            self.high.append(np.maximum(self.high[-1][::2], self.high[-1][1::2]))
            self.count.append(self.count[-1][::2] + self.count[-1][1::2])
            self.sum.append(self.sum[-1][::2] + self.sum[-1][1::2])
        for levels in (self.low, self.high, self.count, self.sum):
            levels.reverse()


class Assigner:
    """Nearest entries of a tree's points."""

    def __init__(self, tree: Tree, entries: np.ndarray):
        self.tree, self.entries = tree, entries
        k = len(entries)
        self.counts = np.zeros(k, dtype=np.int64)
        self.sums = np.zeros_like(entries)
        self.nearest = np.zeros(tree.weight.shape, dtype=np.int64)
        # An entry equal to one of a lower index is nearest to nothing.
        first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        book = Tree(entries[first], 1)
        self.index_of = first[book.rows]
        self._descend(book)

    def _descend(self, book: Tree) -> None:
        tree = self.tree
        part, entry = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        at_part = at_entry = 0
        while True:
            part, entry = self._prune(book, at_part, at_entry, part, entry)
            if at_entry == book.depth:
                part, entry = self._settle(at_part, part, entry)
            if not len(part) or (at_part == tree.depth and at_entry == book.depth):
                break
            if at_entry < book.depth:
                part, entry = np.repeat(part, 2), (2 * entry[:, None] + [0, 1]).ravel()
                at_entry += 1
            if at_part < tree.depth:
                part, entry = (2 * part[:, None] + [0, 1]).ravel(), np.repeat(entry, 2)
                at_part += 1
        if len(part):
            self._compare(part, entry)

    def _prune(self, book: Tree, at_part: int, at_entry: int, part: np.ndarray, entry: np.ndarray):
        low, high = self.tree.low[at_part][part], self.tree.high[at_part][part]
        e_low, e_high = book.low[at_entry][entry], book.high[at_entry][entry]
        least = (np.maximum(np.maximum(low - e_high, e_low - high), 0) ** 2).sum(axis=1)
        most = (np.maximum(high - e_low, e_high - low) ** 2).sum(axis=1)
        bound = np.full(1 << at_part, np.iinfo(np.int64).max)
        np.minimum.at(bound, part, most)
        kept = least <= bound[part]
        return part[kept], entry[kept]

    def _settle(self, at_part: int, part: np.ndarray, entry: np.ndarray):
        """Assign the nodes with one entry left, by their cached counts and sums."""
        pairs = np.unique(np.stack([part, self.index_of[entry]]), axis=1)
        left = np.bincount(pairs[0], minlength=1 << at_part)
        alone = left[pairs[0]] == 1
        node, index = pairs[:, alone]
        np.add.at(self.counts, index, self.tree.count[at_part][node])
        np.add.at(self.sums, index, self.tree.sum[at_part][node])
        leaves = self.nearest.reshape(1 << at_part, -1)
        leaves[node] = index[:, None]
        open_ = left[part] > 1
        return part[open_], entry[open_]

    def _compare(self, part: np.ndarray, entry: np.ndarray) -> None:
        """Compare the rows of uncertain leaves with each of their entries."""
        pairs = np.unique(np.stack([part, self.index_of[entry]]), axis=1)
        starts = np.flatnonzero(np.r_[True, pairs[0][1:] != pairs[0][:-1]])
        distance = ((self.tree.points[pairs[0]] - self.entries[pairs[1]][:, None, :]) ** 2).sum(axis=2)
        least = np.minimum.reduceat(distance, starts, axis=0)
        runs = np.diff(np.r_[starts, len(pairs[0])])
        index = np.where(distance == np.repeat(least, runs, axis=0), pairs[1][:, None], len(self.entries))
        chosen = np.minimum.reduceat(index, starts, axis=0)
        leaf = pairs[0][starts]
        self.nearest[leaf] = chosen
        counted = self.tree.weight[leaf]
        np.add.at(self.counts, chosen[counted], 1)
        np.add.at(self.sums, chosen[counted], self.tree.points[leaf][counted])

    def by_row(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row, in the rows' own order."""
        entry = np.zeros(n, dtype=np.int64)
        weight = self.tree.weight.ravel()
        entry[self.tree.rows[weight]] = self.nearest.ravel()[weight]
        distance = np.zeros(n, dtype=np.int64)
        d = self.tree.points.shape[2]
        flat = ((self.tree.points.reshape(-1, d) - self.entries[self.nearest.ravel()]) ** 2).sum(axis=1)
        distance[self.tree.rows[weight]] = flat[weight]
        return entry, distance


def integer_vectors(df: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): the vectors that take part, as integers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    within = F.forall("v", lambda x: (x > -LIMIT) & (x < LIMIT))
    refused = F.raise_error(F.lit(f"vector components must stay below {LIMIT // scale} in size"))
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias(vector))
    rows = rows.where(F.col(vector).isNotNull() & ~bad).select("id", "label", whole.alias("v"))
    return rows.select("id", "label", F.when(within, F.col("v")).otherwise(refused).alias("v"))


def _blocks(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """(ids, labels, v, orders): a row per block, with the tree order of each part."""
    spark = vectors.sparkSession
    types = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"ids array<{types['id']}>, labels array<{types['label']}>, v binary, orders array<binary>"
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                lists = part.column(2)
                lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
                v = np.zeros((part.num_rows, width), dtype=np.int32)
                v[np.arange(width) < lengths[:, None]] = np.asarray(lists.flatten())
                trees = [Tree(v[:, p].astype(np.int64), LEAF_ROWS) for p in _columns(parts, width)]
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(ends, part.column(0).cast(arrow.field(0).type.value_type)).cast(arrow.field(0).type),
                    pa.ListArray.from_arrays(ends, part.column(1).cast(arrow.field(1).type.value_type)).cast(arrow.field(1).type),
                    pa.array([v.tobytes()], pa.binary()),
                    pa.array([[t.order.astype(np.int32).tobytes() for t in trees]], arrow.field(3).type),
                ], schema=arrow)

    return arrow_map(vectors.select("id", "label", "v"), run, schema)


def _columns(parts: int, width: int) -> list[slice]:
    return [slice(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def _trees(v: bytes, orders: list[bytes], parts: int, width: int) -> Iterator[Tree]:
    every = np.frombuffer(v, dtype=np.int32).reshape(-1, width)
    for columns, order in zip(_columns(parts, width), orders, strict=True):
        yield Tree(every[:, columns].astype(np.int64), LEAF_ROWS, np.frombuffer(order, np.int32).astype(np.int64))


def _sums(blocks: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(part, entry, position, n, total) over all blocks; position -1 carries the counts alone."""
    parts = len(books)
    schema = "part int, entry int, n long, totals array<long>"
    arrow = _arrow_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros_like(books)
        for batch in batches:
            for v, orders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p, tree in enumerate(_trees(v, orders, parts, width)):
                    found = Assigner(tree, books[p])
                    counts[p] += found.counts
                    sums[p] += found.sums
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([
            pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()),
            pa.array(sums[p, e].tolist(), arrow.field(3).type),
        ], schema=arrow)

    partial = arrow_map(blocks.select("v", "orders"), run, schema)
    return (
        partial.select("part", "entry", "n", F.posexplode("totals").alias("position", "total"))
        .groupBy("part", "entry", "position")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


def _codes(blocks: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    parts = len(books)
    types = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]
    schema = f"id {types[0]}, label {types[1]}, code string, error long"
    arrow = _arrow_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                codes, error = np.zeros((len(ids), parts), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for p, tree in enumerate(_trees(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), parts, width)):
                    codes[:, p], distance = Assigner(tree, books[p]).by_row(len(ids))
                    error += distance
                yield pa.RecordBatch.from_arrays([
                    ids.cast(arrow.field(0).type), labels.cast(arrow.field(1).type),
                    pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error),
                ], schema=arrow)

    return arrow_map(blocks, run, schema)


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every vector that takes part, and the codebooks [part, entry, position].

    ``entries`` is at most 256, since an index has two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    vectors = materialize(integer_vectors(df, id_col, vector, label, scale))
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), width), dtype=np.int64)
    for i, row in enumerate(first):
        start[i, : len(row.v)] = row.v
    books = np.stack([start[:, c] for c in _columns(parts, width)])
    blocks = materialize(_blocks(vectors, parts, width))
    if not first:
        return _codes(blocks, books, width).withColumnRenamed("id", id_col), books
    for _ in range(rounds):
        # Bounded by the codebooks: parts x entries x positions numbers.
        for r in _sums(blocks, books, width).collect():
            books[r.part, r.entry, r.position] = r.total // r.n
    return _codes(blocks, books, width).withColumnRenamed("id", id_col), books


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """The codes with ``label_error``, the error of all rows of equal labels; null labels are one."""
    value = F.col(label).cast("string")
    marked = materialize(
        codes.withColumn("mark", F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), value)))
    )
    totals = marked.groupBy("mark").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows"))
    return hot_split_join(marked, materialize(totals), ["mark"], "rows").drop("mark", "rows")


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, comparing every part with every entry, for vectors of one length."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
distance{i} AS MATERIALIZED (
  SELECT rn, part, entry, sum((x - v) * (x - v))::BIGINT AS d FROM cell JOIN book{i} USING (part, position)
  GROUP BY rn, part, entry),
nearest{i} AS MATERIALIZED (
  SELECT rn, part, min(struct_pack(d := d, entry := entry)) AS best FROM distance{i} GROUP BY rn, part)""")
        if i < rounds:
            steps.append(f"""
book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.position,
         coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, b.v) AS v
  FROM book{i} b LEFT JOIN (
    SELECT part, best.entry AS entry, position, sum(x) AS s, count(*) AS n
    FROM nearest{i} JOIN cell USING (rn, part) GROUP BY ALL) u
  ON b.part = u.part AND b.entry = u.entry AND b.position = u.position)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rn, vec_id, label, embedding
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cell AS MATERIALIZED (
  SELECT rn, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS position,
         floor({scale} * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT rn, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, rn AS entry, position, x AS v FROM cell WHERE rn < {entries}),
{",".join(steps)},
coded AS (
  SELECT rn, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
  FROM nearest{rounds} GROUP BY rn)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, position)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (rn)
"""


ORACLE = _oracle()
