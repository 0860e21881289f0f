"""Exact positions and running totals without a single-task window.

Three ways to cut an ordered group into chunks, each of which keeps every task to one chunk:

* ``seeded_rank``: order is a digest, whose leading hex digits cut evenly by nature;
* ``indexed_totals``: order is a unique integer position, cut by integer division;
* ``range_totals``: any order, cut by a range shuffle and pinned by a checkpoint so that both
  the chunk totals and the rows see the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.joins import null_safe_join
from tallymark.session import shared_dir, shuffle_width

# Spark limits each task early for row_number() <= k only up to this k by default.
GROUP_LIMIT_MAX = 1000


def seeded_digest(id_col: str, seed: int | str) -> Column:
    """Order key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _exclusive_offsets(
    totals: DataFrame, keys: Sequence[str], chunk: str, sums: dict[str, str]
) -> DataFrame:
    before = (
        Window.partitionBy(*keys)
        .orderBy(chunk)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys,
        chunk,
        *[
            F.coalesce(F.sum(total).over(before), F.lit(0).cast(totals.schema[total].dataType))
            .alias(offset)
            for total, offset in sums.items()
        ],
    )


def seeded_rank(
    df: DataFrame,
    id_col: str,
    seed: int | str,
    keys: Sequence[str] = (),
    rank_col: str = "rank",
    prefix: int = 4,
) -> DataFrame:
    """1-based dense rank of each row in seeded order, per key; exact for any group size.

    Null keys are a group, and null ids come first in it. ``prefix`` hex digits give 16**prefix chunks per group.
    """
    keys = list(keys)
    rows = df.withColumn("_digest", seeded_digest(id_col, seed)).withColumn(
        "_chunk", F.substring("_digest", 1, prefix)
    )
    totals = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _exclusive_offsets(totals, keys, "_chunk", {"_n": "_offset"})
    local = Window.partitionBy(*keys, "_chunk").orderBy("_digest", id_col)
    return (
        null_safe_join(rows, offsets, [*keys, "_chunk"])
        .withColumn(rank_col, F.row_number().over(local) + F.col("_offset"))
        .drop("_digest", "_chunk", "_offset")
    )


def seeded_top(
    df: DataFrame,
    id_col: str,
    seed: int | str,
    k: int,
    keys: Sequence[str] = (),
    rank_col: str = "rank",
) -> DataFrame:
    """The first ``k`` rows per key in seeded order, with their rank."""
    if k > GROUP_LIMIT_MAX:
        return seeded_rank(df, id_col, seed, keys, rank_col).where(F.col(rank_col) <= k)
    # Small k: each map task keeps k rows per key before the shuffle (window group limit).
    window = Window.partitionBy(*keys).orderBy(seeded_digest(id_col, seed), F.col(id_col))
    return df.withColumn(rank_col, F.row_number().over(window).cast("bigint")).where(
        F.col(rank_col) <= k
    )


def indexed_totals(
    df: DataFrame,
    index_col: str,
    sums: dict[str, Column],
    keys: Sequence[str] = (),
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Inclusive running sums ``sums`` in the order of a position unique within each key."""
    keys = list(keys)
    rows = df.withColumn("_chunk", F.floor(F.col(index_col) / F.lit(chunk_rows)))
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    offsets = _exclusive_offsets(
        totals, keys, "_chunk", {f"_t_{name}": f"_o_{name}" for name in sums}
    )
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(index_col)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    out = null_safe_join(rows, offsets, [*keys, "_chunk"])
    for name in sums:
        out = out.withColumn(
            name,
            F.coalesce(F.sum(f"_v_{name}").over(local), F.lit(0))
            + F.coalesce(F.col(f"_o_{name}"), F.lit(0)),
        )
    return out.drop("_chunk", *[f"_{p}_{name}" for name in sums for p in "vo"])


def range_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, Column],
    keys: Sequence[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """Exclusive running sums ``sums`` in ``order``, per key; rows must be unique in the order."""
    keys = list(keys)
    spark = df.sparkSession
    shared_dir(spark)
    n = chunks or shuffle_width(spark)
    cut = df
    for name, value in sums.items():
        cut = cut.withColumn(f"_v_{name}", value)
    cut = (
        cut.repartitionByRange(n, *keys, *order)
        .withColumn("_chunk", F.spark_partition_id())
        .checkpoint()
    )
    totals = cut.groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    offsets = _exclusive_offsets(
        totals, keys, "_chunk", {f"_t_{name}": f"_o_{name}" for name in sums}
    )
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = null_safe_join(cut, offsets, [*keys, "_chunk"])
    for name in sums:
        out = out.withColumn(
            name, F.coalesce(F.sum(f"_v_{name}").over(local), F.lit(0)) + F.col(f"_o_{name}")
        )
    return out.drop("_chunk", *[f"_{p}_{name}" for name in sums for p in "vo"])


def positions(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), position_col: str = "position"
) -> DataFrame:
    """1-based position of every row in ``order`` (unique), per key."""
    out = range_totals(df, order, {"_before": F.lit(1).cast("bigint")}, keys)
    return out.withColumn(position_col, F.col("_before") + 1).drop("_before")


def first_positions(
    df: DataFrame, order: Sequence[str], k: int | None, position_col: str = "position"
) -> DataFrame:
    """The first ``k`` rows in ``order`` numbered from 1; all rows when ``k`` is None."""
    if k is None or k > GROUP_LIMIT_MAX:
        numbered = positions(df, order, position_col=position_col)
        return numbered if k is None else numbered.where(F.col(position_col) <= k)
    # At most GROUP_LIMIT_MAX rows reach the unpartitioned window.
    window = Window.orderBy(*order)
    return (
        df.orderBy(*order)
        .limit(k)
        .withColumn(position_col, F.row_number().over(window).cast("bigint"))
    )
