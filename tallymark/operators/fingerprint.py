"""Digests of whole datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _ordered_digest(name: str, digest: str) -> Column:
    """sha256 over (name, \\0, digest, \\0) in name order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(name), F.col(digest))))
    zero = F.lit("\0")
    text = F.array_join(
        F.transform(entries, lambda e: F.concat(e[name], zero, e[digest], zero)), ""
    )
    return F.sha2(text, 256)


def dataset_fingerprint(
    df: DataFrame, name: str, digest: str, buckets_hex: int = 8, step: int = 2
) -> DataFrame:
    """One digest of (name, digest) rows: a tree of digests over the leading hex digits of names.

    Names are unique, so md5 prefixes cut evenly. Leaves hash the rows that share ``buckets_hex``
    digits, and every level above hashes 16**step digests of the one below, so no task holds more
    than that many, nor a leaf more than its share of 16**buckets_hex. The value depends only on the
    rows and on these two numbers. Rows are shuffled by half of the digits, which the levels that
    have as many share: one shuffle serves them all.
    """
    half = buckets_hex // 2
    rows = df.select(
        F.col(name).cast("string").alias("_name"),
        F.col(digest).alias("_digest"),
        F.substring(F.md5(F.col(name).cast("string")), 1, buckets_hex).alias("_bucket"),
    )
    level = rows.withColumn("_part", F.substring("_bucket", 1, half)).repartition("_part")
    level = level.groupBy("_part", "_bucket").agg(
        _ordered_digest("_name", "_digest").alias("_hash"), F.count(F.lit(1)).alias("_n")
    )
    for digits in range(buckets_hex - step, 0, -step):
        shared = ["_part"] if digits >= half else []
        above = F.substring("_bucket", 1, digits)
        level = level.groupBy(*shared, above.alias("_above")).agg(
            _ordered_digest("_bucket", "_hash").alias("_hash"), F.sum("_n").alias("_n")
        )
        level = level.withColumnRenamed("_above", "_bucket")
    return level.groupBy().agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.when(F.count(F.lit(1)) > 0, _ordered_digest("_bucket", "_hash"))
        .otherwise("none")
        .alias("fingerprint"),
    )


def tree_fingerprint(files: DataFrame, name: str = "rel_path", digest: str = "sha256") -> DataFrame:
    """The digest of a file tree: that of its listing, the same way at every size."""
    return dataset_fingerprint(files, name, digest)


def combined_fingerprint(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Digest over ``name:fingerprint`` lines of several datasets, in the given order."""
    lines = [
        F.concat(F.lit(f"{name}:"), part.select("fingerprint").scalar()) for name, part in parts
    ]
    return parts[0][1].sparkSession.range(1).select(
        F.sha2(F.array_join(F.array(*lines), "\n"), 256).alias("dataset_sha256")
    )


def freeze_record(
    spark, model_sha256: str, dataset_sha256: str, thresholds: dict[str, float | None],
    seed: int, git_commit: str, git_dirty: bool,
) -> DataFrame:
    """One row that pins what a result was measured on."""
    return spark.range(1).select(
        F.lit(model_sha256).alias("model_sha256"),
        F.lit(dataset_sha256).alias("dataset_sha256"),
        *[
            F.lit(value).cast("double").alias(f"threshold_{task}")
            for task, value in sorted(thresholds.items())
        ],
        F.lit(seed).alias("seed"),
        F.lit(git_commit).alias("git_commit"),
        F.lit(git_dirty).alias("git_dirty"),
        F.current_timestamp().alias("timestamp"),
    )
