"""Train and evaluation manifests that share no document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.documents import stem
from tallymark.operators.ordering import first_positions, seeded_rank
from tallymark.session import materialize


class HoldoutError(ValueError):
    """A split and the files it names do not agree."""


def holdout_train_filter(authentic: DataFrame, split: DataFrame, name: str = "name") -> DataFrame:
    """Authentic rows the split assigns to training."""
    return authentic.join(
        split.where(F.col("side") == "train").select(name).distinct(), name, "left_semi"
    )


def missing_train_names(authentic: DataFrame, split: DataFrame, name: str = "name") -> DataFrame:
    """Training names of the split without a file."""
    return (
        split.where(F.col("side") == "train")
        .select(name)
        .distinct()
        .join(authentic.select(name), name, "left_anti")
    )


def holdout_train_filter_checked(
    authentic: DataFrame, split: DataFrame, name: str = "name"
) -> DataFrame:
    missing = missing_train_names(authentic, split, name).limit(1).collect()
    if missing:
        raise HoldoutError(f"split names without a file, e.g. {missing[0][0]}")
    return holdout_train_filter(authentic, split, name)


def train_minus_eval(
    authentic: DataFrame, eval_rows: DataFrame, path: str = "path", seed: int = 17101
) -> DataFrame:
    """Authentic rows outside evaluation's label-0 rows; if none is left, a seeded half.

    Adds ``fallback``, true on rows of the seeded half. Runs and writes the difference first, as
    only an empty one makes rows be put in order.
    """
    held = materialize(authentic.join(
        eval_rows.where(F.col("label") == 0).select(path).distinct(), path, "left_anti"
    ))
    if not held.isEmpty():
        return held.withColumn("fallback", F.lit(False))
    n_all = authentic.agg(F.count(F.lit(1))).scalar()
    return (
        seeded_rank(authentic, path, seed, rank_col="_rank")
        .where((n_all >= 2) & (F.col("_rank") <= F.floor(n_all / 2)))
        .drop("_rank")
        .withColumn("fallback", F.lit(True))
    )


def domain_expand(authentic: DataFrame) -> DataFrame:
    """Each row once per evaluation domain."""
    return authentic.withColumn(
        "eval_domain", F.explode(F.array(F.lit("in_domain"), F.lit("cross_domain")))
    )


def dual_domain_manifest(
    authentic: DataFrame,
    generated: DataFrame,
    third_party: DataFrame,
    caps: tuple[int | None, int | None, int | None] = (None, None, None),
    path: str = "path",
) -> DataFrame:
    """Authentic rows in both domains, generated forgeries in one, third-party in the other.

    Inputs hold a path; ids number each pool by path order. ``generated`` may hold mask_path.
    ``caps`` keep the first so many of each pool; by default all rows stay.
    """
    auth = first_positions(authentic.select(path), [path], caps[0])
    gen_cols = [path, "mask_path"] if "mask_path" in generated.columns else [path]
    gen = first_positions(generated.select(*gen_cols), [path], caps[1])
    third = first_positions(third_party.select(path), [path], caps[2])
    number = F.format_string("%05d", "position")
    none = F.lit(None).cast("string")

    auth_rows = domain_expand(auth).select(
        F.concat(F.lit("auth_"), F.col("eval_domain"), F.lit("_"), number).alias("id"),
        path,
        F.lit(0).alias("label"),
        F.lit("public_dataset").alias("origin"),
        F.lit("authentic").alias("fabrication"),
        none.alias("tamper"),
        none.alias("mask_path"),
        "eval_domain",
        F.lit("authentic").alias("generator"),
    )
    mask = F.col("mask_path") if "mask_path" in gen_cols else none
    gen_rows = gen.select(
        F.concat(F.lit("fg_in_"), number).alias("id"),
        path,
        F.lit(1).alias("label"),
        F.lit("synthetic_generated").alias("origin"),
        F.lit("script").alias("fabrication"),
        F.lit("mixed").alias("tamper"),
        F.coalesce(mask, F.col(path)).alias("mask_path"),
        F.lit("in_domain").alias("eval_domain"),
        F.lit("generated").alias("generator"),
    )
    third_rows = third.select(
        F.concat(F.lit("fg_xd_"), number).alias("id"),
        path,
        F.lit(1).alias("label"),
        F.lit("public_dataset").alias("origin"),
        F.lit("script").alias("fabrication"),
        F.lit("copy_move").alias("tamper"),
        F.col(path).alias("mask_path"),
        F.lit("cross_domain").alias("eval_domain"),
        F.lit("third_party").alias("generator"),
    )
    return auth_rows.unionByName(gen_rows).unionByName(third_rows)


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("eval_domain") == "in_domain").alias("in_domain"),
        F.count_if(F.col("eval_domain") == "cross_domain").alias("cross_domain"),
        F.count_if(F.col("label") == 0).alias("label_0"),
        F.count_if(F.col("label") == 1).alias("label_1"),
    )


def train_pool_assembly(
    authentic: DataFrame, pools: dict[str, DataFrame], skip: Sequence[str] = ("test",)
) -> DataFrame:
    """(pool, path, mask_path, label): authentic rows and the label-1 rows of every kept pool."""
    none = F.lit(None).cast("string")
    out = authentic.select(
        F.lit("authentic").alias("pool"), "path", none.alias("mask_path"), F.lit(0).alias("label")
    )
    for name, rows in pools.items():
        if name not in skip:
            out = out.unionByName(
                rows.where(F.col("label") == 1).select(
                    F.lit(name).alias("pool"), "path", "mask_path", F.lit(1).alias("label")
                )
            )
    return out


def require_both_classes(samples: DataFrame) -> DataFrame:
    found = {row.label for row in samples.select("label").distinct().limit(3).collect()}
    if not {0, 1} <= found:
        raise HoldoutError(f"both classes are required, found {sorted(found)}")
    return samples


def holdout_eval_manifest(eval_names: DataFrame, forged: DataFrame) -> DataFrame:
    """Held-out authentic rows and the forgeries made of them, keyed by the source document.

    ``eval_names`` holds name; ``forged`` holds path, tamper and source (an authentic name).
    """
    none = F.lit(None).cast("string")
    auth_stem, source_stem = stem(F.col("name")), stem(F.col("source"))
    authentic = eval_names.select(
        auth_stem.alias("id"),
        F.concat(F.lit("authentic/"), "name").alias("path"),
        F.lit(0).alias("label"),
        F.lit("public_dataset").alias("origin"),
        F.lit("authentic").alias("fabrication"),
        none.alias("tamper"),
        none.alias("mask_path"),
        none.alias("source"),
    )
    key = F.concat(F.lit("fg_"), source_stem)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    forgeries = forged.select(
        key.alias("id"),
        F.concat(F.lit("images/"), key, suffix).alias("path"),
        F.lit(1).alias("label"),
        F.lit("synthetic_generated").alias("origin"),
        F.lit("script").alias("fabrication"),
        "tamper",
        F.concat(F.lit("masks/"), key, F.lit("_mask.png")).alias("mask_path"),
        "source",
    )
    return authentic.unionByName(forgeries)


def split_overlap(split: DataFrame, name: str = "name") -> DataFrame:
    """Names on both sides of a split."""
    train = split.where(F.col("side") == "train").select(name)
    evaluation = split.where(F.col("side") == "eval").select(name)
    return train.intersect(evaluation)


def manifest_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)
