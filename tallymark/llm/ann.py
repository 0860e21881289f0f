"""Approximate nearest neighbours by inner product over a permutation index.

Every vector is known by the order of its nearest pivots. Vectors are dealt into shards; a shard
posts each vector under its pivots with their ranks (pivot inverted files). A query walks the files
of its own nearest pivots, which sums for each vector ``m - max(rank in vector, rank in query)``:
the footrule distance of the two orders, with absent pivots at rank ``m``, falls as this grows. The
best share of a shard is reranked by the exact inner product in double precision. A vector that many
rows hold is indexed once, with the ``k + 1`` least ids that hold it: no other copy can be returned.

Queries are dealt into blocks, and each block meets each shard in a task of its own, so a task holds
one shard and one block, whatever the sizes. Each hands on ``k`` rows per query.

Vectors of different length are ordered by inner product through one added component that levels
all norms, so that nearest means largest inner product; the scores use the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor
do those of another length than most. Candidates of equal score come by smaller id. Rows that share
an id never find each other; as a query, the least vector of the id is asked. With ``k`` candidates
or fewer, all are returned; without queries or vectors, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map, store, workers_know

SHARD = 8192
QUERY_BLOCK = 2048
#: Pivots are distinct vectors out of a sample of at most this many.
PIVOT_SAMPLE = 4096
#: Parts in which the ids of one vector are gathered.
SALTS = 1024


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vector as array<double>) of the vectors that take part."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vector"),
    ).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall(
        "vector",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    most = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vector") == (most[0] if most else 0))


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """Distinct vectors of smallest id hash, one per row; fewer if there are fewer."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    distinct = list(dict.fromkeys(tuple(r.vector) for r in sample))[:pivots]
    return np.array(distinct, np.float64)


def pivot_order(vectors: np.ndarray, pivots: np.ndarray, top: float, kept: int, query: bool) -> np.ndarray:
    """The ``kept`` nearest pivots of each vector, nearest first, as ranks' pivot numbers."""
    near = vectors @ pivots.T
    if not query:
        lift = np.sqrt(np.maximum(0, top - (vectors**2).sum(axis=1)))
        near = near + lift[:, None] * np.sqrt(np.maximum(0, top - (pivots**2).sum(axis=1)))[None, :]
    return np.argsort(-near, axis=1, kind="stable")[:, :kept].astype(np.int16)


def _matrix(column, width: int | None = None) -> np.ndarray:
    flat = pa.chunked_array(column.chunks if hasattr(column, "chunks") else [column])
    values = flat.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, width or 1)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(ids, vector): every vector once, with the ``k + 1`` least ids that hold it, ascending, an id
    of repeated rows up to ``k`` times.

    Ids are first cut to ``k + 1`` within salted parts of a vector's rows, so that no task holds all
    copies of one.
    """
    # -0.0 and 0.0 are one number.
    rows = rows.select("vec_id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    once = rows.groupBy("vector", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    salted = once.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    parts = salted.groupBy("vector", "salt").agg(F.sort_array(F.collect_list(F.struct("vec_id", "n"))).alias("ids"))
    parts = parts.select("vector", F.slice("ids", 1, k + 1).alias("ids"))
    merged = parts.groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    least = F.slice(F.sort_array("ids"), 1, k + 1)
    ids = F.flatten(F.transform(least, lambda x: F.array_repeat(x["vec_id"], x["n"])))
    return merged.select(ids.alias("ids"), "vector")


def permutation_index(
    rows: DataFrame, key: str, pivots: np.ndarray, top: float, kept: int, query: bool
) -> DataFrame:
    """``rows`` (key, vector) with ``pivot_list``: the numbers of the nearest pivots."""

    def run(batches):
        for batch in batches:
            order = pivot_order(_matrix(batch.column(1)), pivots, top, kept, query)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), max(1, order.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists.cast(pa.list_(pa.int16()))],
                names=[key, "vector", "pivot_list"],
            )

    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, vector array<double>, pivot_list array<short>"
    return arrow_map(rows.select(key, "vector"), run, schema)


def search_cell(shard: pa.Table, queries: pa.Table, k: int, share: float, pivots: int) -> pa.Table:
    """The ``k`` best of one shard for each query of one block; the share counts distinct vectors."""
    lists_of_ids = shard["ids"].to_pylist()
    asked = queries["vec_id"].to_numpy()
    found_query, found_id, found_score = [], [], []
    if len(lists_of_ids) and len(asked):
        by_id = np.array(sorted(range(len(lists_of_ids)), key=lambda i: lists_of_ids[i][0]))
        counts = np.array([len(lists_of_ids[i]) for i in by_id])
        flat_ids = np.array([x for i in by_id for x in lists_of_ids[i]], np.int64)
        starts = np.cumsum(counts) - counts
        vectors = _matrix(shard["vector"])[by_id]
        lists = _matrix(shard["pivot_list"])[by_id]
        kept, size = lists.shape[1], len(counts)
        # The inverted files: for each pivot, the vectors that list it and where.
        flat = np.argsort(lists.ravel(), kind="stable")
        edges = np.searchsorted(lists.ravel()[flat], np.arange(pivots + 1))
        member, rank = flat // kept, (flat % kept).astype(np.int32)
        take = min(size, max(512, int(np.ceil(share * size))))
        places = np.arange(size)
        for query, vector, own in zip(asked, _matrix(queries["vector"]), _matrix(queries["pivot_list"])):
            shared = np.zeros(size, np.int32)
            for at, pivot in enumerate(own):
                part = slice(edges[pivot], edges[pivot + 1])
                shared[member[part]] += kept - np.maximum(rank[part], at)
            if take < size:
                order = np.argpartition(places - shared.astype(np.int64) * size, take - 1)[:take]
                order.sort()
            else:
                order = places
            score = (vectors[order] * vector).sum(axis=1)
            held = counts[order]
            part = np.repeat(starts[order] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            ids, score = flat_ids[part], np.repeat(score, held)
            other = ids != query
            ids, score = ids[other], score[other]
            best = np.lexsort((ids, -score))[:k]
            found_query.append(np.full(len(best), query))
            found_id.append(ids[best])
            found_score.append(score[best])
    joined = [np.concatenate(x) if x else np.empty(0) for x in (found_query, found_id, found_score)]
    return pa.table(
        {
            "query_id": pa.array(joined[0].astype(np.int64)),
            "vec_id": pa.array(joined[1].astype(np.int64)),
            "score": pa.array(joined[2].astype(np.float64)),
        }
    )


def nearest(
    vectors: DataFrame,
    query_filter,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    pivots: int = 256,
    kept: int = 64,
    share: float = 0.2,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row of ``query_filter``.

    ``query_filter`` is a condition on ``vec_id``. ``kept``: length of the pivot orders; ``share``:
    part of each shard that is reranked.
    """
    workers_know(vectors.sparkSession)
    rows = usable_vectors(vectors, id_col, vec_col)
    distinct = store(distinct_vectors(rows, k), "ann-vectors")
    chosen = choose_pivots(distinct.select(F.col("ids")[0].alias("vec_id"), "vector"), pivots)
    total, top = distinct.agg(
        F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    ).first()
    kept = max(1, min(kept, len(chosen)))
    count = len(chosen)
    shards = max(1, -(-total // SHARD))

    def dealt(frame: DataFrame, key: str, query: bool) -> DataFrame:
        if not count:
            frame = frame.withColumn("pivot_list", F.array(F.lit(0).cast("short")))
        else:
            frame = permutation_index(frame, key, chosen, top, kept, query)
        return frame.withColumn("place", F.monotonically_increasing_id())

    index = store(dealt(distinct, "ids", False), "ann-index").withColumn("shard", F.pmod("place", F.lit(shards)))
    asked = rows.where(query_filter).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = store(dealt(asked, "vec_id", True), "ann-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod("place", F.lit(blocks)))

    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cells = [F.col("shard").cast("long"), F.col("block").cast("long")]

    def cell(shard: pa.Table, queries: pa.Table) -> pa.Table:
        return search_cell(shard, queries, k, share, count)

    found = (
        left.select(*cells, "ids", "vector", "pivot_list")
        .groupBy("shard", "block")
        .cogroup(
            right.select(*cells, "vec_id", "vector", "pivot_list").groupBy("shard", "block")
        )
        .applyInArrow(cell, "query_id long, vec_id long, score double")
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.withColumn("rank", place)
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
