"""Consistency of profile handles with the résumé and with source lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.handles import handle_equal
from tallymark.functions.rows import explode_map

EXCUSED = ("unsupported", "not_provided")


def handles_long(df: DataFrame, handles: str, person: str = "person", name: str = "handle"):
    """MAP<source, handle> column to (person, source, handle) rows."""
    return explode_map(df, [person], handles, "source", name)


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))])
    return F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(1.0))


def identity_resolve(
    resume: DataFrame,
    supplied: DataFrame,
    statuses: DataFrame,
    weights: dict[str, float] | None = None,
    person: str = "person",
) -> DataFrame:
    """(person, source, resume, submitted, status, weight, outcome) per available source.

    Inputs are (person, source, handle) and (person, source, status), unique per person and
    source. Two handles that differ are a mismatch and are not looked up.
    """
    keys = [person, "source"]
    both = resume.select(*keys, F.col("handle").alias("resume")).join(
        supplied.select(*keys, F.col("handle").alias("submitted")), keys, "full_outer"
    )
    resolved = both.join(statuses.select(*keys, "status"), keys, "left")
    given = F.nullif("resume", F.lit("")).isNotNull() & F.nullif("submitted", F.lit("")).isNotNull()
    outcome = (
        F.when(given & ~handle_equal(F.col("resume"), F.col("submitted")), "handle_mismatch")
        .when(F.col("status") == "ok", "confirmed")
        .when(F.col("status") == "not_found", "profile_not_found")
        .when(F.col("status").isin(*EXCUSED), "excused")
        .otherwise("source_unavailable")
    )
    return resolved.withColumn("weight", _weight(weights)).withColumn("outcome", outcome)


def identity_score(persons: DataFrame, resolved: DataFrame, person: str = "person") -> DataFrame:
    """(person, score, discrepancies): share of weight confirmed, in percent, half to even.

    Discrepancies are ordered by source. A person without any handle scores 0.
    """
    expected = F.coalesce(F.nullif("submitted", F.lit("")), F.col("resume"))
    kind = F.col("outcome")
    finding = F.when(
        kind.isin("handle_mismatch", "profile_not_found", "source_unavailable"),
        F.struct(
            F.col("source"),
            kind.alias("type"),
            F.when(kind == "handle_mismatch", F.col("resume")).alias("resume"),
            F.when(kind == "handle_mismatch", F.col("submitted")).alias("submitted"),
            F.when(kind == "profile_not_found", expected).alias("handle"),
            F.when(kind == "source_unavailable", F.coalesce("status", F.lit("missing")))
            .alias("status"),
        ),
    )
    earned = F.sum(F.when(kind == "confirmed", F.col("weight")).otherwise(F.lit(0.0)))
    total = F.sum("weight")
    # One row per source, so a person's list is as short as the list of sources.
    per_person = resolved.groupBy(person).agg(
        F.bround(F.coalesce(F.try_divide(earned * 100, total), F.lit(0.0)), 0)
        .cast("int")
        .alias("score"),
        F.array_sort(F.collect_list(finding)).alias("discrepancies"),
    )
    none = F.array(
        F.struct(
            F.lit(None).cast("string").alias("source"),
            F.lit("no_profile_handle").alias("type"),
            *[
                F.lit(None).cast("string").alias(c)
                for c in ("resume", "submitted", "handle", "status")
            ],
        )
    )
    return persons.select(person).join(per_person, person, "left").select(
        person,
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("discrepancies", none).alias("discrepancies"),
    )


def discrepancy_rows(scored: DataFrame, person: str = "person") -> DataFrame:
    """(person, position, source, type, resume, submitted, handle, status)."""
    return scored.select(person, F.posexplode("discrepancies").alias("position", "_d")).select(
        person, "position", "_d.*"
    )


def discrepancy_prevalence(records: DataFrame, column: str = "gt_discrepancies") -> DataFrame:
    """(field, action, n_rows, n_records_with, n_records, share) of planted discrepancies."""
    totals = records.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.size(F.coalesce(column, F.array())) > 0).alias("with"),
        ).alias("t")
    ).scalar()
    return (
        records.select(F.explode(column).alias("_d"))
        .groupBy(F.col("_d")["field"].alias("field"), F.col("_d")["action"].alias("action"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            "field",
            "action",
            "n_rows",
            totals["with"].alias("n_records_with"),
            totals["n"].alias("n_records"),
            F.try_divide(totals["with"].cast("double"), totals["n"].cast("double")).alias("share"),
        )
    )
