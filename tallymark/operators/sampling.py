"""Seeded samples and disjoint splits of exact size.

Seeded order is the md5 of ``seed:id``; picks are reproducible in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.ordering import (
    GROUP_LIMIT_MAX,
    first_positions,
    positions,
    seeded_top,
)


class TooFewRowsError(ValueError):
    """Not enough rows for the requested sizes."""


def holdout_split(
    df: DataFrame, name: str, train_n: int, eval_n: int, seed: int
) -> DataFrame:
    """(name, side, seed): the first ``train_n`` names in seeded order train, the next evaluate."""
    names = df.select(name).distinct()
    return seeded_top(names, name, seed, train_n + eval_n).select(
        name,
        F.when(F.col("rank") <= train_n, "train").otherwise("eval").alias("side"),
        F.lit(seed).alias("seed"),
    )


def holdout_split_checked(
    df: DataFrame, name: str, train_n: int, eval_n: int, seed: int
) -> DataFrame:
    """As ``holdout_split``, raising first when there are too few names."""
    found = df.select(name).distinct().limit(train_n + eval_n).count()
    if found < train_n + eval_n:
        raise TooFewRowsError(f"need {train_n + eval_n} names, found {found}")
    return holdout_split(df, name, train_n, eval_n, seed)


def capture_kind(id_col: Column) -> Column:
    """scan or photo out of the id; an id naming both counts as scan."""
    return (
        F.when(F.contains(id_col, F.lit("scan")), "scan")
        .when(F.contains(id_col, F.lit("photo")), "photo")
        .otherwise("other")
    )


def stratified_sample(
    df: DataFrame,
    max_n: int,
    seed: int,
    id_col: str = "id",
    country: str = "country",
    capture: str = "capture",
) -> DataFrame:
    """Equal quota per country, scans and photos alternating, others after both.

    The remainder goes to the first countries by name; a shortfall is not redistributed.
    """
    named = df.withColumn(country, F.coalesce(country, F.lit("unknown")))
    # Every country holds at most ceil(max_n / countries) picks, never more than max_n.
    ranked = seeded_top(named, id_col, seed, max_n, [country, capture], "_k")
    in_turn = Window.partitionBy(country).orderBy(
        (~F.col(capture).isin("scan", "photo")).cast("int"),
        "_k",
        F.when(F.col(capture) == "scan", 0).otherwise(1),
        id_col,
    )
    quotas = _country_quotas(named, country, max_n)
    return (
        ranked.withColumn("_turn", F.row_number().over(in_turn))
        .where(F.col("_turn") <= max_n)
        .join(quotas, country)
        .where(F.col("_turn") <= F.col("_quota"))
        .drop("_k", "_turn", "_quota")
    )


def _country_quotas(df: DataFrame, country: str, max_n: int) -> DataFrame:
    """Quota per country; countries past ``max_n`` by name have none, so a prefix suffices."""
    names = df.select(country).distinct()
    count = names.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = first_positions(names, [country], max_n, "_place")
    base = F.floor(F.lit(max_n) / count)
    return place.select(
        country,
        (base + F.when(F.col("_place") <= F.lit(max_n) - base * count, 1).otherwise(0)).alias(
            "_quota"
        ),
    ).where(F.col("_quota") > 0)


def legacy_sample(
    df: DataFrame, max_n: int, id_col: str = "id", row_index: str = "row_index"
) -> DataFrame:
    """First half scans, the rest photos, in manifest order.

    When that gives fewer than ``max_n``, the first ``max_n`` of scans, photos, others. A
    manifest of at most ``max_n`` rows is kept whole.
    """
    kinds = df.withColumn("_kind", capture_kind(F.col(id_col)))
    if max_n <= GROUP_LIMIT_MAX:
        place = Window.partitionBy("_kind").orderBy(row_index)
        ranked = kinds.withColumn("_place", F.row_number().over(place).cast("bigint"))
    else:
        ranked = positions(kinds, [row_index], ["_kind"], "_place")
    ranked = ranked.where(F.col("_place") <= max_n)
    totals = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(capture_kind(F.col(id_col)) == "scan").alias("scans"),
            F.count_if(capture_kind(F.col(id_col)) == "photo").alias("photos"),
        ).alias("t")
    ).scalar()
    half = max_n // 2
    scans = F.least(F.lit(half).cast("bigint"), totals["scans"])
    photos = F.lit(max_n) - scans
    short = scans + F.least(photos, totals["photos"]) < max_n
    offset = F.when(F.col("_kind") == "scan", F.lit(0).cast("bigint")).when(
        F.col("_kind") == "photo", totals["scans"]
    ).otherwise(totals["scans"] + totals["photos"])
    halves = ((F.col("_kind") == "scan") & (F.col("_place") <= half)) | (
        (F.col("_kind") == "photo") & (F.col("_place") <= photos)
    )
    whole = totals["n"] <= max_n
    return ranked.where(
        F.when(whole, F.lit(True)).when(short, offset + F.col("_place") <= max_n).otherwise(halves)
    ).drop("_kind", "_place")


def balanced_eval_sample(
    df: DataFrame, max_eval: int, seed: int, id_col: str = "id", label: str = "label"
) -> DataFrame:
    """``max_eval // 2`` rows per class in seeded order; every row when ``max_eval`` is 0."""
    if max_eval <= 0:
        return df
    both = df.where(F.col(label).isin(0, 1))
    return seeded_top(both, id_col, seed, max_eval // 2, [label], "_k").drop("_k")


def capped_inputs(pools: dict[str, tuple[DataFrame, int | None]], path: str = "path") -> DataFrame:
    """(pool, position, path): the first paths of each pool by name, numbered from 1."""
    parts = [
        first_positions(df.select(path), [path], cap).select(
            F.lit(pool).alias("pool"), "position", path
        )
        for pool, (df, cap) in pools.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def authentic_pick(
    images: DataFrame, n_each: int, seed: int, path: str = "path", check: bool = True
) -> DataFrame:
    """``n_each`` authentic rows in seeded order with positional ids and their forged partners.

    The forged row of position i is the one generated from authentic i.
    """
    if check:
        found = images.limit(n_each).count()
        if found < n_each:
            raise TooFewRowsError(f"need {n_each} images, found {found}")
    picked = seeded_top(images.select(path), path, seed, n_each, (), "position")
    number = F.format_string("%04d", "position")
    authentic = picked.select(
        F.concat(F.lit("auth_"), number).alias("id"),
        F.col(path).alias("source_path"),
        F.lit(0).alias("label"),
        F.lit("authentic").alias("fabrication"),
        F.lit("public_dataset").alias("origin"),
    )
    forged = picked.select(
        F.concat(F.lit("fg_"), number).alias("id"),
        F.col(path).alias("source_path"),
        F.lit(1).alias("label"),
        F.lit("script").alias("fabrication"),
        F.lit("synthetic_generated").alias("origin"),
    )
    return authentic.unionByName(forged)


def top_samples(df: DataFrame, order: Sequence[str], n: int = 50) -> DataFrame:
    """The first rows of a finding list, for a report."""
    return df.orderBy(*order).limit(n)
