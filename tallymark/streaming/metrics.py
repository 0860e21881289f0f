"""Metrics kept up to date while records arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import TARGETS
from tallymark.operators.sweep import score_histogram_counts, sweep_from_counts


def stream_running_cer(items: DataFrame, keys: Sequence[str] = ("script",)) -> DataFrame:
    """Running mean and counts per key; records without a value count but do not weigh."""
    return items.groupBy(*keys).agg(
        F.avg("cer_field").alias("running_cer_field"),
        F.count(F.lit(1)).alias("n"),
        F.count("cer_field").alias("n_with_gt_fields"),
    )


def stream_latency_windows(
    log: DataFrame,
    ts: str = "ts",
    width: str = "1 day",
    lateness: str = "1 hour",
    target_max: float = TARGETS["seconds_max"],
) -> DataFrame:
    """Latency summary per tumbling window; rows later than the watermark are dropped."""
    seconds = F.col("elapsed_ms") / F.lit(1000.0)
    return (
        log.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("success")).alias("successes"),
            F.count_if(~F.col("success")).alias("failures"),
            F.avg(seconds).alias("mean_seconds"),
        )
        .select(
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "n",
            "successes",
            "failures",
            "mean_seconds",
            (F.col("mean_seconds") < target_max).alias("passed"),
        )
    )


def stream_threshold_counts(
    scores: DataFrame, groups: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Bucket counts of the sweep; they only add up, so arrival order does not matter."""
    return score_histogram_counts(scores, groups, score, label)


def sweep_on_read(counts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Metrics at every threshold from the counts kept so far."""
    return sweep_from_counts(counts, groups)
