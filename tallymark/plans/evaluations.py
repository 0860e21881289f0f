"""The four evaluations, from records and scores to a result and the tables behind it.

Building an evaluation runs the job over its scores, once, and writes what the summaries read: the
sweep, the records' error rates, or the pairs' operating points. A record without a score, or with
a failed one, ends that job and raises ``FatalRowsError`` with the first failures. Pairs whose
similarity is null are counted, as a face may not be found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import ROC_GATE_FPR, ROC_GATE_TPR, TARGETS
from tallymark.operators import cer as cer_ops
from tallymark.operators import identity as identity_ops
from tallymark.operators import sampling
from tallymark.operators.pairing import scored_pair_sweep
from tallymark.operators.provenance import (
    forgery_migrate_legacy,
    origin_distribution,
    trial_valid_agg,
    under_variation_agg,
)
from tallymark.operators.reporting import latency_summary
from tallymark.operators.sweep import (
    domain_gate,
    maximin_threshold,
    roc_gate_grid,
    threshold_sweep,
    youden_best,
)
from tallymark.operators.validation import complete_scores, fatal_rows_listed, unscored
from tallymark.session import materialize


@dataclass(frozen=True)
class Evaluation:
    """A result of few rows and the tables behind it."""

    result: DataFrame
    detail: dict[str, DataFrame]


def _counted(job: DataFrame, listed: DataFrame, told: DataFrame, value: str | None = None) -> DataFrame:
    """The job's result, written; raises if a listed record has no score that counts."""
    with fatal_rows_listed(unscored(listed, told, "id", value)):
        return materialize(job)


def _told(scores: DataFrame, *columns: str) -> DataFrame:
    """Ids, the named columns, and the error column if there is one."""
    return scores.select("id", *columns, *(["error"] if "error" in scores.columns else []))


def evaluate_forgery(
    manifest: DataFrame, scores: DataFrame, targets: dict[str, float] | None = None,
    require_cross: bool = True,
) -> Evaluation:
    """Per-domain sweep and operating point; the gate domain decides.

    ``domains`` holds a row per domain: its operating point, whether a threshold passes the ROC
    gate, and the best-effort point by TPR less FPR. ``origins`` counts records by origin.
    """
    wanted = targets or {"tpr": TARGETS["tpr_min"], "f1": TARGETS["f1_min"]}
    records = forgery_migrate_legacy(manifest).withColumn(
        "domain", F.coalesce("eval_domain", F.lit("in_domain"))
    )
    told = _told(scores, "score")
    listed = records.select("id", "label", "domain")
    scored = complete_scores(listed, told, "id", "score")
    # 101 rows per domain, read by five summaries.
    sweep = _counted(threshold_sweep(scored, ["domain"]), listed, told, "score")
    operating = maximin_threshold(sweep, wanted, ["domain"])
    best = youden_best(sweep, ["domain"]).select(
        "domain", *[F.col(c).alias(f"best_{c}") for c in ("threshold", "tpr", "fpr", "precision", "f1")]
    )
    sizes = sweep.groupBy("domain").agg(
        F.max(F.col("tp") + F.col("fn")).alias("n_positive"), F.max(F.col("fp") + F.col("tn")).alias("n_negative")
    )
    domains = (
        sizes.join(operating, "domain")
        .join(roc_gate_grid(sweep, ["domain"], ROC_GATE_TPR, ROC_GATE_FPR), "domain")
        .join(best, "domain")
    )
    facts = records.agg(
        F.struct(F.count(F.lit(1)).alias("n"), trial_valid_agg().alias("trial_valid"))
    ).scalar()
    gate = domain_gate(domains, "domain", require_cross)
    return Evaluation(
        gate.withColumns({"n": facts["n"], "trial_valid": facts["trial_valid"]}),
        {"sweep": sweep, "operating": operating, "domains": domains, "origins": origin_distribution(records)},
    )


def _sampled(records: DataFrame, max_n: int, mode: str, seed: int) -> DataFrame:
    """At most ``max_n`` records: in equal shares of countries and captures, or the manifest's first."""
    if mode == "legacy":
        return sampling.legacy_sample(records, max_n)
    if mode != "stratified":
        raise ValueError(f"unknown sample mode {mode!r}")
    shot = records.withColumn("capture", sampling.capture_kind(F.col("id").cast("string")))
    return sampling.stratified_sample(shot, max_n, seed).drop("capture")


def evaluate_documents(
    manifest: DataFrame,
    hypotheses: DataFrame,
    scripts: Sequence[str] | None = None,
    countries: Sequence[str] | None = None,
    target_max: float = TARGETS["cer_max"],
    max_samples: int | None = None,
    sample_mode: str = "stratified",
    seed: int = 42,
    lang_by_country: dict[str, str] | None = None,
    default_lang: str = "en",
) -> Evaluation:
    """Field error rate of records in scope; ``hypotheses`` holds id, hyp_fields and page.

    ``manifest`` holds row_index, its order, if ``max_samples`` or the breakdown is wanted. A
    scope without a record raises ``EmptyScopeError`` (a job that reads until the first one).
    ``breakdown`` holds the rates overall, by script and by country, ``origins`` the records by
    origin.
    """
    script, country = cer_ops.scope_columns()
    ordered = ["row_index"] if "row_index" in manifest.columns else []
    records = cer_ops.scope_filter(manifest, scripts, countries).select(
        "id", script.alias("script"), country.alias("country"), "gt_fields", "origin", *ordered
    )
    cer_ops.require_rows(records.select("id"))
    if max_samples and max_samples > 0:
        # A scope of no more records than that is kept whole, as quotas could leave some out.
        if records.select("id").limit(max_samples + 1).count() > max_samples:
            records = _sampled(records, max_samples, sample_mode, seed)
    told = _told(hypotheses, "hyp_fields", "page")
    joined = complete_scores(records, told)
    items = cer_ops.record_items(joined, ["script", "country", "origin", *ordered])
    items = _counted(items, records.select("id"), told)
    result = items.agg(
        F.avg("cer_field").alias("cer_field"),
        F.count(F.lit(1)).alias("n"),
        F.count("cer_field").alias("n_with_gt_fields"),
        trial_valid_agg().alias("trial_valid"),
    ).withColumn("passed", F.coalesce(F.col("cer_field") < target_max, F.lit(False)))
    detail = {"fields": cer_ops.field_rows(joined), "items": items, "origins": origin_distribution(records)}
    if ordered:
        detail["breakdown"] = cer_ops.cer_breakdown(items, lang_by_country, default_lang)
    return Evaluation(result, detail)


def evaluate_faces(pairs: DataFrame, similarities: DataFrame) -> Evaluation:
    """Sensitivity and accuracy of a pair manifest, and whether a threshold may be locked."""
    told = _told(similarities, "similarity", "backend")
    scored = complete_scores(pairs, told)
    facts = pairs.agg(
        under_variation_agg().alias("under_variation"), trial_valid_agg().alias("trial_valid")
    )
    flags = facts.select(F.struct("under_variation", "trial_valid")).scalar()
    operating = _counted(scored_pair_sweep(scored), pairs.select("id"), told)
    result = operating.withColumn("under_variation", flags["under_variation"]).withColumn(
        "threshold_lock", F.when(flags["under_variation"], "blocked").otherwise("ok")
    ).withColumn("trial_valid", flags["trial_valid"])
    return Evaluation(result, {"scored": scored})


def evaluate_identity(
    persons: DataFrame,
    resume: DataFrame,
    supplied: DataFrame,
    statuses: DataFrame,
    log: DataFrame | None = None,
    weights: dict[str, float] | None = None,
) -> Evaluation:
    """Consistency scores per person; the result row is the latency summary when a log is given."""
    resolved = identity_ops.identity_resolve(resume, supplied, statuses, weights)
    scored = identity_ops.identity_score(persons, resolved)
    summary = scored.agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")
    ) if log is None else latency_summary(log)
    return Evaluation(summary, {"scores": scored, "resolved": resolved})
