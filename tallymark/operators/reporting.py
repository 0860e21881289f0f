"""Summaries that decide and describe a run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import CER_KEEP_EPSILON, TARGETS


# Size parameter of the quantile sketches, and the rank error it keeps within (single-sided, of n).
SKETCH_K, SKETCH_ERROR = 800, 0.005


def latency_sketches(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, successes, failures, total_seconds, sketch): what summaries of parts merge from.

    Small rows that may be kept for each day or log and merged by ``merged_latency``; the sketch
    is a KLL sketch of the seconds.
    """
    seconds = F.col("elapsed_ms") / F.lit(1000.0)
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("success")).alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.sum(seconds).alias("total_seconds"),
        F.kll_sketch_agg_double(seconds, SKETCH_K).alias("sketch"),
    )


def merged_latency(
    sketches: DataFrame, target_max: float = TARGETS["seconds_max"], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, n, successes, failures, mean_seconds, p50_seconds, p95_seconds, passed) of kept parts.

    A percentile's rank is within ``SKETCH_ERROR`` of what was asked, whatever the parts.
    """
    merged = sketches.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "successes", "failures")],
        F.coalesce(F.try_divide(F.sum("total_seconds"), F.sum("n")), F.lit(0.0)).alias("mean_seconds"),
        F.kll_merge_agg_double("sketch", SKETCH_K).alias("_sketch"),
    )
    return merged.select(
        *keys, "n", "successes", "failures", "mean_seconds",
        *[
            F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(q))).alias(name)
            for name, q in (("p50_seconds", 0.5), ("p95_seconds", 0.95))
        ],
        (F.col("mean_seconds") < target_max).alias("passed"),
    )


def latency_summary(
    log: DataFrame, target_max: float = TARGETS["seconds_max"], keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, n, successes, failures, mean_seconds, p50_seconds, p95_seconds, passed); an empty log has mean 0."""
    return merged_latency(latency_sketches(log, keys), target_max, keys)


def ablation_summary(rows: DataFrame, keys: Sequence[str] = ("ablation",)) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.avg("cer").alias("cer_field"),
        F.count(F.lit(1)).alias("n"),
        F.count("cer").alias("n_with_gt_fields"),
        F.avg(F.coalesce("latency_ms", F.lit(0.0))).alias("mean_latency_ms"),
    )


def ablation_vs_baseline(summary: DataFrame, baseline: str = "none") -> DataFrame:
    """(ablation, cer_field, baseline_cer_field, decision): keep only a real improvement."""
    base = summary.where(F.col("ablation") == baseline).agg(F.first("cer_field")).scalar()
    return (
        summary.where(F.col("ablation") != baseline)
        .select("ablation", "cer_field", base.alias("baseline_cer_field"))
        .where(F.col("baseline_cer_field").isNotNull())
        .withColumn(
            "decision",
            F.when(
                F.col("cer_field") < F.col("baseline_cer_field") - F.lit(CER_KEEP_EPSILON), "keep"
            ).otherwise("drop"),
        )
    )


CER_BINS = (5, 20)
LATENCY_BINS = (8, 30)


def score_histogram(
    values: DataFrame, column: str, bins: tuple[int, int] = CER_BINS, root: bool = False
) -> DataFrame:
    """(bin, lo, hi, n): equal-width bins from min to max, the last one closed on the right.

    The number of bins is the row count (or its square root) held within ``bins``. Constant data
    spans half a unit on both sides. Bin edges follow the usual lo + i * step rule.
    """
    present = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    stats = present.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        ).alias("s")
    ).scalar()
    size = F.floor(F.sqrt(stats["n"])) if root else stats["n"]
    count = F.least(F.lit(bins[1]).cast("bigint"), F.greatest(F.lit(bins[0]).cast("bigint"), size))
    same = stats["lo"] == stats["hi"]
    lo = F.when(same, stats["lo"] - 0.5).otherwise(stats["lo"])
    hi = F.when(same, stats["hi"] + 0.5).otherwise(stats["hi"])
    step = (hi - lo) / count.cast("double")
    sized = present.select(
        "_v", lo.alias("_lo"), hi.alias("_hi"), count.alias("_count"), step.alias("_step")
    )

    def edge(i: Column) -> Column:
        return F.when(i == F.col("_count"), F.col("_hi")).otherwise(
            F.col("_lo") + i.cast("double") * F.col("_step")
        )

    guess = F.floor((F.col("_v") - F.col("_lo")) / F.col("_step"))
    inside = F.least(guess, F.col("_count") - 1)
    placed = sized.withColumn("_g", inside).withColumn(
        "_bin",
        F.col("_g")
        - F.when(F.col("_v") < edge(F.col("_g")), 1).otherwise(0)
        + F.when(
            (F.col("_v") >= edge(F.col("_g") + 1)) & (F.col("_g") < F.col("_count") - 1), 1
        ).otherwise(0),
    )
    counted = placed.groupBy("_bin").agg(F.count(F.lit(1)).alias("n"))
    frame = values.sparkSession.range(1).select(
        lo.alias("_lo"), hi.alias("_hi"), count.alias("_count"), step.alias("_step"),
    ).where(F.col("_lo").isNotNull()).withColumn(
        "_bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1))
    )
    return frame.join(counted, "_bin", "left").select(
        F.col("_bin").alias("bin"),
        edge(F.col("_bin")).alias("lo"),
        edge(F.col("_bin") + 1).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


GATE_TASKS = ("cer", "tpr", "f1", "sensitivity", "accuracy", "seconds")


def gate_summary(
    spark,
    cer: DataFrame | None = None,
    forgery: DataFrame | None = None,
    faces: DataFrame | None = None,
    latency: DataFrame | None = None,
    targets: dict[str, float] | None = None,
) -> DataFrame:
    """(position, metric, target, value, status): six metrics against their targets.

    CER and seconds must be below; the other four pass when their run is jointly feasible. Inputs
    are one-row results with cer_field; tpr, f1, infeasible; sensitivity, accuracy, infeasible;
    mean_seconds. A missing run is N/A.
    """
    t = {**TARGETS, **(targets or {})}
    wanted = ("cer_max", "tpr_min", "f1_min", "sensitivity_min", "accuracy_min", "seconds_max")
    frame = spark.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(metric).alias("metric"),
                        F.lit(float(t[key])).alias("target"),
                    )
                    for i, (metric, key) in enumerate(zip(GATE_TASKS, wanted), start=1)
                ]
            )
        ).alias("_g")
    ).select("_g.*")

    def measured(run: DataFrame, values: dict[str, tuple[str, Column]]) -> DataFrame:
        rows = F.array(
            *[
                F.struct(
                    F.lit(metric).alias("metric"),
                    F.col(column).cast("double").alias("value"),
                    F.coalesce(ok, F.lit(False)).alias("ok"),
                )
                for metric, (column, ok) in values.items()
            ]
        )
        return run.select(F.explode(rows).alias("_m")).select("_m.*")

    feasible = ~F.col("infeasible")
    parts = []
    for run, values in (
        (cer, {"cer": ("cer_field", F.col("cer_field") < t["cer_max"])}),
        (forgery, {"tpr": ("tpr", feasible), "f1": ("f1", feasible)}),
        (faces, {"sensitivity": ("sensitivity", feasible), "accuracy": ("accuracy", feasible)}),
        (latency, {"seconds": ("mean_seconds", F.col("mean_seconds") < t["seconds_max"])}),
    ):
        if run is not None:
            parts.append(measured(run, values))
    if parts:
        found = reduce(DataFrame.unionByName, parts)
    else:
        none = F.lit(None)
        found = frame.limit(0).select(
            "metric", none.cast("double").alias("value"), none.cast("boolean").alias("ok")
        )
    return frame.join(found, "metric", "left").select(
        "position",
        "metric",
        "target",
        "value",
        F.when(F.col("ok").isNull(), "N/A").when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"),
    )


def backend_comparison(
    results: DataFrame, backends: Sequence[str], value: str = "cer_field", backend: str = "backend"
) -> DataFrame:
    """(metric, one column per backend): the same metric side by side, null where not run."""
    return results.groupBy("metric").pivot(backend, list(backends)).agg(F.first(value))


def score_variants(df: DataFrame, ids: Sequence[str], variants: Sequence[str]) -> DataFrame:
    """One row per record and score variant."""
    return df.unpivot(list(ids), list(variants), "variant", "score")
