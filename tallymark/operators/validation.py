"""Violations of manifests, responses and quality gates, as rows."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import (
    CHECK_DIGIT_POSITION,
    CHECK_DIGIT_PRODUCT,
    EXPECTED_SERVICES,
    FABRICATIONS,
    QUALITY_GATES,
)
from tallymark.functions.rows import explode_values
from tallymark.operators.provenance import trial_valid_agg
from tallymark.session import materialize

# Begins the message of a job that met a failed record.
FATAL_MARK = "failed record "


class ValidationError(ValueError):
    """Records that break a rule, in strict mode."""


class FatalRowsError(RuntimeError):
    """Failed calls; metrics over the rest would be wrong."""


def broken_rules(rules: dict[str, Column]) -> Column:
    """ARRAY of the names of the rules whose condition holds; null counts as not broken."""
    flags = F.array(
        *[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    )
    return F.filter(flags, lambda name: name.isNotNull())


def violations(df: DataFrame, rules: dict[str, Column], id_col: str = "id") -> DataFrame:
    """(id, rule) rows."""
    return explode_values(df, [F.col(id_col).alias("id")], broken_rules(rules), "rule")


def forgery_rules() -> dict[str, Column]:
    label, fab = F.col("label"), F.col("fabrication")
    return {
        "label_not_binary": label.isNull() | ~label.isin(0, 1),
        "fabrication_missing": fab.isNull(),
        "fabrication_unknown": fab.isNotNull() & ~fab.isin(*FABRICATIONS),
        "authentic_label_mismatch": (label == 0) & (fab != "authentic"),
        "forged_label_mismatch": (label == 1) & (fab == "authentic"),
        "tamper_missing": (label == 1) & F.col("tamper").isNull(),
        "mask_missing": (label == 1) & F.col("mask_path").isNull(),
    }


def forgery_row_rules(df: DataFrame) -> DataFrame:
    return violations(df, forgery_rules())


def require_clean(findings: DataFrame, what: str) -> None:
    """Raise with the first findings, if any."""
    first = findings.limit(5).collect()
    if first:
        listed = "\n  ".join(", ".join(str(v) for v in row) for row in first)
        raise ValidationError(f"{what}:\n  {listed}")


def missing_paths(
    manifest: DataFrame,
    inventory: DataFrame,
    path_columns: Sequence[str] = ("path",),
    id_col: str = "id",
    file_path: str = "rel_path",
) -> DataFrame:
    """(id, column, path) of referenced files that do not exist."""
    listed = manifest.unpivot([id_col], list(path_columns), "column", "path").where(
        F.col("path").isNotNull()
    )
    return listed.join(
        inventory.select(F.col(file_path).alias("path")).distinct(), "path", "left_anti"
    ).select(id_col, "column", "path")


def expected_counts(
    df: DataFrame, expected: dict[str, int], conditions: dict[str, Column] | None = None
) -> DataFrame:
    """(name, expected, actual) of counts that differ.

    Not checked when some row is not valid for a trial: such sets may have any size.
    """
    counted = {"total": F.lit(True), **(conditions or {})}
    facts = df.agg(
        (~trial_valid_agg() & (F.count(F.lit(1)) > 0)).alias("_relaxed"),
        *[F.count_if(c).alias(name) for name, c in counted.items()],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(int(want)).cast("bigint").alias("expected"),
                F.col(name).alias("actual"),
            )
            for name, want in expected.items()
        ]
    )
    return (
        facts.where(~F.col("_relaxed"))
        .select(F.explode(rows).alias("_c"))
        .select("_c.*")
        .where(F.col("expected") != F.col("actual"))
    )


def response_rules(
    required: Sequence[str], numeric: str | None = None, nullable: bool = False
) -> dict[str, Column]:
    """Rules for one response held as MAP<STRING, STRING> in ``response``.

    A required key must be present; the numeric field must be a number, and non-null unless
    ``nullable``.
    """
    response = F.col("response")
    keys = list(dict.fromkeys([*required, *([numeric] if numeric else [])]))
    rules = {f"missing_{k}": ~F.map_contains_key(response, k) for k in keys}
    if numeric:
        value = F.try_element_at(response, F.lit(numeric))
        present = F.map_contains_key(response, numeric)
        rules["not_numeric"] = value.isNotNull() & value.try_cast("double").isNull()
        if not nullable:
            rules["null_value"] = present & value.isNull()
    return rules


def response_contract(
    responses: DataFrame,
    required: Sequence[str],
    numeric: str | None = None,
    nullable: bool = False,
    id_col: str = "id",
) -> DataFrame:
    return violations(responses, response_rules(required, numeric, nullable), id_col)


def score_join(manifest: DataFrame, scores: DataFrame, id_col: str = "id") -> DataFrame:
    """Records with their scores; records without one drop out (see ``complete_scores``)."""
    return manifest.join(scores, id_col)


def score_reasons(
    manifest: DataFrame, scores: DataFrame, id_col: str = "id", value_col: str | None = None
) -> DataFrame:
    """Records with their scores and ``reason``, why a record has none that counts; null when it has.

    One join, which reads either side once: no score, the score's own error, or a null value of
    ``value_col``.
    """
    told = scores.withColumn("_told", F.lit(True))
    why = F.when(F.col("_told").isNull(), "no score")
    if "error" in scores.columns:
        why = why.when(F.col("error").isNotNull(), F.col("error"))
    if value_col:
        why = why.when(F.col(value_col).isNull(), "null score")
    return manifest.join(told, id_col, "left").withColumn("reason", why).drop("_told")


def unscored(
    manifest: DataFrame, scores: DataFrame, id_col: str = "id", value_col: str | None = None
) -> DataFrame:
    """(id, reason): records without a score, or with a failed or null one."""
    found = score_reasons(manifest, scores, id_col, value_col)
    return found.where(F.col("reason").isNotNull()).select(id_col, "reason")


def complete_scores(
    manifest: DataFrame, scores: DataFrame, id_col: str = "id", value_col: str | None = None
) -> DataFrame:
    """Records with their scores, for metrics: any job over them fails at a record without one.

    The check is a filter of the job that computes the metrics, so that scores are read once;
    see ``fatal_rows_listed`` for the listing. ``value_col`` names a score that must not be null.
    """
    found = score_reasons(manifest, scores, id_col, value_col)
    told = F.concat(F.lit(FATAL_MARK), F.col(id_col).cast("string"), F.lit(": "), F.col("reason"))
    # Conditions of later steps, such as a score that is not null, would go below a plain filter
    # and take the failed records away before it; they do not pass a nondeterministic one.
    sound = F.when(F.col("reason").isNull() & (F.spark_partition_id() >= 0), F.lit(True)).otherwise(
        F.raise_error(told).cast("boolean")
    )
    return found.where(sound).drop("reason")


def fatal_report(findings: DataFrame, order: Sequence[str], shown: int = 50) -> DataFrame:
    """The first findings in order, each with ``n_failed``, the number of all; read once and written."""
    kept = materialize(findings)
    total = kept.agg(F.count(F.lit(1))).scalar()
    return kept.orderBy(*order).limit(shown).withColumn("n_failed", total)


def abort_on_fatal(findings: DataFrame, order: Sequence[str], shown: int = 50) -> None:
    """One failed call voids the run; the first ones are listed."""
    first = fatal_report(findings, order, shown).collect()
    if first:
        lines = "\n  ".join(", ".join(str(v) for v in row[:-1]) for row in first)
        raise FatalRowsError(f"{first[0].n_failed} failed calls:\n  {lines}")


@contextmanager
def fatal_rows_listed(findings: DataFrame, order: Sequence[str] = ("id", "reason")):
    """Around the action of a job over ``complete_scores``: lists the findings if they end it.

    Only then are they looked for.
    """
    try:
        yield
    except (PySparkException, Py4JError) as error:
        if FATAL_MARK not in str(error):
            raise
        abort_on_fatal(findings, order)
        raise


def quality_flags(gates: dict[str, float] | None = None, eye_variant: bool = False) -> dict[str, Column]:
    """Flags over face_side_px, laplacian_var, yaw_deg and pitch_deg or eye_distance_ratio."""
    g = {**QUALITY_GATES, **(gates or {})}
    flags = {"face_too_small": F.col("face_side_px") < g["min_face_side_px"]}
    if eye_variant:
        flags["eye_distance_too_small"] = F.col("eye_distance_ratio") < g["min_eye_distance_ratio"]
    flags["too_blurry"] = F.col("laplacian_var") < g["min_laplacian_var"]
    flags["yaw_out_of_range"] = F.abs("yaw_deg") > g["max_yaw_deg"]
    if not eye_variant:
        flags["pitch_out_of_range"] = F.abs("pitch_deg") > g["max_pitch_deg"]
        flags["fullframe_fallback"] = F.col("detect_source") == "fullframe_fallback"
    return flags


def quality_gate(
    faces: DataFrame, gates: dict[str, float] | None = None, eye_variant: bool = False
) -> DataFrame:
    """Adds ``flags`` and ``passed``; falling back to the full frame is noted but passes."""
    flagged = faces.withColumn("flags", broken_rules(quality_flags(gates, eye_variant)))
    failing = F.filter("flags", lambda f: f != "fullframe_fallback")
    return flagged.withColumn("passed", F.size(failing) == 0)


def endpoint_identity_check(observed: DataFrame, expected: dict[str, str] | None = None):
    """(name, expected, got, reason) over observed (name, service) rows; reason null when right."""
    want = expected or EXPECTED_SERVICES
    table = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(s).alias("expected")) for n, s in want.items()]
    )
    services = observed.sparkSession.range(1).select(F.explode(table).alias("_e")).select("_e.*")
    found = observed.select("name", F.col("service").alias("got"), F.lit(True).alias("_seen"))
    return services.join(found, "name", "left").select(
        "name",
        "expected",
        "got",
        F.when(F.col("_seen").isNull(), "missing")
        .when(F.col("got").isNull() | (F.col("got") != F.col("expected")), "wrong_service")
        .alias("reason"),
    )


# --- check digits -----------------------------------------------------------------------------


def check_digit_valid(number: Column) -> Column:
    """True when a string of digits carries a correct dihedral check digit."""
    product_lit = F.array(*(F.lit(v) for row in CHECK_DIGIT_PRODUCT for v in row))
    position_lit = F.array(*(F.lit(v) for row in CHECK_DIGIT_POSITION for v in row))
    digits = F.transform(
        F.sequence(F.lit(1), F.length(number)),
        # From the last digit backwards.
        lambda i: F.substring(number, -i, F.lit(1)).cast("int"),
    )
    permuted = F.transform(digits, lambda d, i: F.get(position_lit, (i % 8) * 10 + d))
    state = F.aggregate(permuted, F.lit(0), lambda acc, p: F.get(product_lit, acc * 10 + p))
    return state == 0


def idnumber_checksum_scan(
    texts: DataFrame, groups: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """(groups, candidates, valid, invalid): 12-digit numbers in texts by check digit."""
    found = F.regexp_extract_all(
        F.col(text), F.lit(r"(?<![0-9])([0-9]{12})(?![0-9])"), F.lit(1)
    )
    numbers = explode_values(texts, list(groups), found, "number")
    counted = numbers.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(check_digit_valid(F.col("number"))).alias("valid"),
    )
    return counted.withColumn("invalid", F.col("candidates") - F.col("valid"))
