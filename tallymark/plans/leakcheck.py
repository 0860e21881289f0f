"""The leakage check of an evaluation set, from two file listings to a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import IMAGE_SUFFIXES, NEAR_HASH_DISTANCE
from tallymark.functions.documents import base_name, document_key, in_directory
from tallymark.operators import leakage
from tallymark.session import materialize

HELD_OUT_FOLDER = r"(^|[/\\])([^/\\]*_pre_holdout|_holdout[^/\\]*)([/\\]|$)"


def file_index(
    files: DataFrame, manifest: DataFrame | None = None, authentic_names: DataFrame | None = None
) -> DataFrame:
    """(path, sha256, phash, source_id) of the images of one side.

    ``files`` holds path, sha256 and phash. Masks and folders set aside for a holdout are no
    images of a side. ``manifest`` (path, source, label) tells the document a file derives from
    before its name does. With ``authentic_names`` (name), files below ``authentic`` count only if
    they are named in it.
    """
    path = F.col("path")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kept = files.select("path", "sha256", "phash").where(
        suffix.isin(*IMAGE_SUFFIXES)
        & ~in_directory(path, "masks")
        & ~F.regexp_like(path, F.lit(HELD_OUT_FOLDER))
    )
    if authentic_names is not None:
        named = authentic_names.select(F.col("name").alias("_name")).distinct().withColumn("_listed", F.lit(True))
        kept = (
            kept.withColumn("_name", F.when(in_directory(path, "authentic"), base_name(path)))
            .join(named, "_name", "left")
            .where(F.col("_name").isNull() | F.col("_listed"))
            .drop("_name", "_listed")
        )
    if manifest is None:
        return kept.withColumn("source_id", document_key(path))
    told = manifest.select("path", F.col("source").alias("_source"), F.col("label").alias("_label"))
    return kept.join(told, "path", "left").select(
        "path", "sha256", "phash", document_key(path, F.col("_source"), F.col("_label")).alias("source_id")
    )


@dataclass(frozen=True)
class LeakageCheck:
    """A one-row report and the findings behind it."""

    report: DataFrame
    exact: DataFrame
    near: DataFrame
    by_source: DataFrame


def check_leakage(
    train_files: DataFrame,
    eval_files: DataFrame,
    train_manifest: DataFrame | None = None,
    eval_manifest: DataFrame | None = None,
    split: DataFrame | None = None,
    distance: int = NEAR_HASH_DISTANCE,
) -> LeakageCheck:
    """Names, contents, near hashes and sources that both sides share, and the verdict.

    ``split`` (name, side) lists the authentic files held out: only those on the evaluation side
    are looked at there, and a name on both sides fails. Both indexes are written once, as every
    comparison reads them; the near comparison runs the jobs of ``near_hash_pairs``.
    """
    allowed = split.where(F.col("side") == "eval").select("name") if split is not None else None
    train = materialize(file_index(train_files, train_manifest))
    evaluation = materialize(file_index(eval_files, eval_manifest, allowed))
    if split is None:
        both = train.select(F.col("path").alias("name")).limit(0)
    else:
        sides = split.groupBy("name").agg(
            F.bool_or(F.col("side") == "train").alias("t"), F.bool_or(F.col("side") == "eval").alias("e")
        )
        both = sides.where("t AND e").select("name")
    exact = leakage.leak_exact(train, evaluation)
    near = materialize(leakage.near_hash_pairs(train, evaluation, distance))
    by_source = leakage.leak_source(train, evaluation)

    def told(side: DataFrame, name: str) -> DataFrame:
        return side.agg(
            F.count(F.lit(1)).alias(f"n_{name}_files"),
            F.count("source_id").alias(f"n_{name}_with_source_id"),
        )

    verdict = leakage.leak_verdict(both, exact, near, by_source)
    sizes = [
        df.select(F.struct("*")).scalar() for df in (told(train, "train"), told(evaluation, "eval"))
    ]
    report = verdict.select(
        sizes[0]["n_train_files"].alias("n_train_files"),
        sizes[1]["n_eval_files"].alias("n_eval_files"),
        sizes[0]["n_train_with_source_id"].alias("n_train_with_source_id"),
        sizes[1]["n_eval_with_source_id"].alias("n_eval_with_source_id"),
        "*",
    )
    return LeakageCheck(report, exact, near, by_source)
