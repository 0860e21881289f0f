"""Where records come from, and what that allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import (
    CAPTURE_ORDER,
    DIFF_BAND,
    FABRICATIONS,
    FIELD_ORIGIN,
    NON_TRIAL_ORIGINS,
    ORIGIN_SEVERITY,
    PROVENANCE_ORIGINS,
    SAME_BAND,
    TOTAL_BAND,
)


def origin_normalize(origin: Column) -> Column:
    return F.nullif(F.trim(origin), F.lit(""))


def origin_distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(
        *keys, F.coalesce(origin_normalize(F.col("origin")), F.lit("unknown")).alias("origin")
    ).agg(F.count(F.lit(1)).alias("n"))


def trial_valid_agg() -> Column:
    """Aggregate: there are rows and every one is field-collected."""
    is_field = F.coalesce(origin_normalize(F.col("origin")) == FIELD_ORIGIN, F.lit(False))
    return F.coalesce(F.bool_and(is_field), F.lit(False))


def trial_valid(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(trial_valid_agg().alias("trial_valid"))


def _severity(origin: Column) -> Column:
    return F.nullif(
        F.array_position(F.array(*[F.lit(o) for o in ORIGIN_SEVERITY]), origin), F.lit(0)
    )


def most_severe_origin(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The worst provenance present; null when only field or unknown data is."""
    origin = origin_normalize(F.col("origin"))
    return df.groupBy(*keys).agg(F.min_by(origin, _severity(origin)).alias("banner_origin"))


def most_severe_across(results: DataFrame) -> DataFrame:
    """Banner over result sets (task, origin, n, trial_valid): counted origins, worst first.

    Without a non-field origin, a set marked invalid still gives ``non_field``.
    """
    counted = F.when((F.col("n") > 0) & (F.col("origin") != "unknown"), F.col("origin"))
    named = F.coalesce(
        counted,
        F.when(~F.col("trial_valid") & (F.col("origin") == "dev_fixture"), F.col("origin")),
    )
    return results.agg(
        F.coalesce(
            F.min_by(named, _severity(named)),
            F.when(F.bool_or(~F.col("trial_valid")), "non_field"),
        ).alias("banner")
    )


def has_dev_fixture(df: DataFrame) -> DataFrame:
    return df.agg(
        F.coalesce(F.bool_or(F.col("origin") == "dev_fixture"), F.lit(False)).alias("has_dev_fixture")
    )


def non_field_origins(df: DataFrame) -> DataFrame:
    return (
        df.select(F.coalesce(F.nullif("origin", F.lit("")), F.lit("unknown")).alias("origin"))
        .where(F.col("origin") != FIELD_ORIGIN)
        .distinct()
    )


def forgery_migrate_legacy(df: DataFrame) -> DataFrame:
    """Move a fabrication kept in ``origin`` to its column; infer it from the label if absent."""
    legacy = F.col("fabrication").isNull() & F.col("origin").isin(*FABRICATIONS)
    inferred = F.col("fabrication").isNull() & F.col("origin").isin(*PROVENANCE_ORIGINS)
    return df.select(
        *[c for c in df.columns if c not in ("origin", "fabrication")],
        F.when(legacy & (F.col("origin") == "authentic"), "dev_fixture")
        .when(legacy, "synthetic_generated")
        .otherwise(F.col("origin"))
        .alias("origin"),
        F.when(legacy, F.col("origin"))
        .when(inferred & (F.col("label") == 0), "authentic")
        .when(inferred & (F.col("label") == 1), "script")
        .otherwise(F.col("fabrication"))
        .alias("fabrication"),
    )


def under_variation_agg() -> Column:
    """Aggregate: some pair varies too little for a threshold to be locked on it."""
    warning = F.coalesce("pair_warning", F.lit(""))
    captures = F.array(*[F.lit(c) for c in CAPTURE_ORDER])
    studio = (
        F.col("same")
        & F.array_contains(captures, F.col("capture_a"))
        & F.array_contains(captures, F.col("capture_b"))
    )
    flagged = (
        F.startswith(warning, F.lit("under_variation"))
        | (warning == "single_image_augment_forbidden")
        | F.coalesce(studio, F.lit(False))
    )
    return F.coalesce(F.bool_or(flagged), F.lit(False))


def under_variation_flag(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    flagged = pairs.groupBy(*keys).agg(under_variation_agg().alias("under_variation"))
    return flagged.withColumn(
        "threshold_lock", F.when(F.col("under_variation"), "blocked").otherwise("ok")
    )


def non_trial_manifests(rows: DataFrame, manifest: str = "manifest") -> DataFrame:
    """Manifests that hold at least one non-trial record."""
    return rows.where(F.col("origin").isin(*NON_TRIAL_ORIGINS)).select(manifest).distinct()


def _broken(rows: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(rule, message) of the rules whose condition holds."""
    listed = F.array(
        *[
            F.when(
                F.coalesce(bad, F.lit(False)),
                F.struct(F.lit(rule).alias("rule"), message.alias("message")),
            )
            for rule, bad, message in rules
        ]
    )
    return (
        rows.select(F.explode(listed).alias("_r"))
        .where(F.col("_r").isNotNull())
        .select("_r.*")
    )


def freeze_strict_rules(freeze: DataFrame) -> DataFrame:
    """Reasons a freeze record is not strict."""
    model, commit = F.col("model_sha256"), F.col("git_commit")
    return _broken(
        freeze,
        [
            ("model_missing", model.isNull() | model.isin("", "none"), F.lit("no frozen model weights")),
            ("commit_unknown", commit.isNull() | commit.isin("", "unknown"), F.lit("commit is unknown")),
            ("tree_dirty", F.col("git_dirty"), F.lit("working tree has changes")),
        ],
    )


def trial_rules(
    pairs: DataFrame,
    face_threshold: float | None = None,
    last_run_blocked: bool = False,
    last_run_origins: Sequence[str] = (),
) -> DataFrame:
    """(rule, message) rows a face trial set breaks; an empty table means it may be frozen."""
    locked = F.lit(face_threshold is not None)
    origin = F.coalesce(F.nullif("origin", F.lit("")), F.lit("unknown"))
    known = (*NON_TRIAL_ORIGINS, "unknown")
    facts = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(origin != FIELD_ORIGIN).alias("n_non_field"),
        # Bounded: only the tiers by name, anything else as one entry.
        F.array_sort(
            F.collect_set(
                F.when(origin.isin(*known), origin).when(origin != FIELD_ORIGIN, "other")
            )
        ).alias("non_field"),
        F.count_if(F.startswith(F.coalesce("pair_warning", F.lit("")), F.lit("under_variation")))
        .alias("n_under"),
        F.count_if(F.col("same")).alias("n_same"),
        F.count_if(~F.col("same")).alias("n_diff"),
    )
    any_rows, n = F.col("n") > 0, F.col("n")
    non_field = F.col("n_non_field") > 0

    def band(rule: str, value: Column, limits: tuple[int, int]):
        return (
            rule,
            any_rows & ~value.between(*limits),
            F.concat(value.cast("string"), F.lit(f" outside [{limits[0]}, {limits[1]}]")),
        )

    stale = [o for o in last_run_origins if o in NON_TRIAL_ORIGINS]
    return _broken(
        facts,
        [
            ("manifest_missing", ~any_rows, F.lit("no field-collected pairs")),
            ("threshold_without_manifest", ~any_rows & locked, F.lit("threshold is set")),
            ("origin_not_field", non_field, F.array_join("non_field", ", ")),
            ("under_variation", F.col("n_under") > 0, F.col("n_under").cast("string")),
            band("same_band", F.col("n_same"), SAME_BAND),
            band("diff_band", F.col("n_diff"), DIFF_BAND),
            band("total_band", n, TOTAL_BAND),
            ("threshold_on_non_field", non_field & locked, F.lit("threshold is set")),
            (
                "last_run_blocked",
                any_rows & F.lit(last_run_blocked) & locked,
                F.lit("last run blocks the threshold lock"),
            ),
            (
                "last_run_not_field",
                any_rows & F.lit(bool(stale)),
                F.lit(", ".join(sorted(stale))),
            ),
        ],
    )
