"""Rank statistics over exact scores, and training-epoch summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.fixedvalues import COLLAPSE_PATIENCE, COLLAPSE_STD, ROC_GATE_FPR, ROC_GATE_TPR
from tallymark.operators.joins import null_safe_join
from tallymark.operators.ordering import range_totals
from tallymark.operators.sweep import (
    FORGERY_TARGETS,
    feasible_interval,
    grid_bucket,
    sweep_from_counts,
)
from tallymark.session import materialize, shuffle_width


def score_counts(
    scores: DataFrame, groups: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """(groups, score, pos, neg) per distinct score, so that ties combine before any shuffle."""
    value = F.when(F.col(score) == 0, F.lit(0.0)).otherwise(F.col(score))  # -0.0 equals 0.0
    return (
        scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)))
        .groupBy(*groups, value.alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )


def cut_counts(counts: DataFrame, groups: Sequence[str] = (), chunks: int | None = None) -> DataFrame:
    """The counts with ``_chunk``, a range of consecutive (group, score), each in one task.

    The range shuffle samples, so a large group spreads over many chunks.
    """
    n = chunks or shuffle_width(counts.sparkSession)
    return counts.repartitionByRange(n, *groups, "score").withColumn("_chunk", F.spark_partition_id())


def score_chunks(cut: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, chunk, lo, hi, pos, neg, wins) of the chunks of counts.

    ``wins`` counts the positive-negative pairs inside a chunk that are in order, ties as half.
    """
    groups = list(groups)
    below = (
        Window.partitionBy(*groups, "_chunk")
        .orderBy("score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    neg_below = F.coalesce(F.sum("neg").over(below), F.lit(0))
    return (
        cut.withColumn("_wins", F.col("pos") * (neg_below + F.col("neg") / F.lit(2.0)))
        .groupBy(*groups, "_chunk")
        .agg(
            F.min("score").alias("lo"),
            F.max("score").alias("hi"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum("_wins").alias("wins"),
        )
        .withColumnRenamed("_chunk", "chunk")
    )


def _with_group_totals(chunks: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives outside each chunk; a group has at most one row per task."""
    whole = Window.partitionBy(*groups)
    ordered = whole.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunks.withColumn("p", F.sum("pos").over(whole))
        .withColumn("n", F.sum("neg").over(whole))
        .withColumn("neg_below", F.coalesce(F.sum("neg").over(ordered), F.lit(0)))
        .withColumn("pos_below", F.coalesce(F.sum("pos").over(ordered), F.lit(0)))
        .withColumn("pos_above", F.col("p") - F.col("pos_below") - F.col("pos"))
        .withColumn("neg_above", F.col("n") - F.col("neg_below") - F.col("neg"))
    )


def rank_auc(
    scores: DataFrame, groups: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """(groups, n_pos, n_neg, auc): mean-rank AUC; 0 when a class is empty."""
    return rank_auc_from_cut(cut_counts(score_counts(scores, groups, score, label), groups), groups)


def rank_auc_from_cut(cut: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    chunks = _with_group_totals(score_chunks(cut, groups), groups)
    wins = F.sum(F.col("wins") + F.col("pos") * F.col("neg_below").cast("double"))
    pairs = F.first("p").cast("double") * F.first("n").cast("double")
    return chunks.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.coalesce(F.try_divide(wins, pairs), F.lit(0.0)).alias("auc"),
    )


def roc_gate(
    scores: DataFrame,
    groups: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    tpr_min: float = ROC_GATE_TPR,
    fpr_max: float = ROC_GATE_FPR,
) -> DataFrame:
    """(groups, passed, threshold, tpr, fpr) over the distinct scores, from the top.

    True and false positive rates only grow as the threshold falls, so the highest score that
    reaches ``tpr_min`` has the least false positive rate and decides alone. Without such a
    score, or when its rate is 1, the row holds (false, null, 0, 1). Runs the job of the counts.
    """
    if not groups:
        whole = scores.withColumn("_all", F.lit(0))
        return roc_gate(whole, ["_all"], score, label, tpr_min, fpr_max).drop("_all")
    cut = materialize(cut_counts(score_counts(scores, groups, score, label), groups))
    return roc_gate_from_cut(cut, groups, tpr_min, fpr_max)


def roc_gate_from_cut(
    cut: DataFrame,
    groups: Sequence[str],
    tpr_min: float = ROC_GATE_TPR,
    fpr_max: float = ROC_GATE_FPR,
) -> DataFrame:
    """The gate of counts that were cut and written: both readings must see the same chunks."""
    groups = list(groups)
    chunks = _with_group_totals(score_chunks(cut, groups), groups)
    tp_here = (F.col("pos_above") + F.col("pos")).cast("double")
    reaches = F.coalesce(F.try_divide(tp_here, F.col("p").cast("double")), F.lit(0.0)) >= tpr_min
    # The chunk in which the rate is first reached; only its rows are looked at one by one.
    crossing = chunks.groupBy(*groups).agg(
        F.max_by(
            F.struct("chunk", "pos_above", "neg_above"),
            # Without positives no chunk reaches the rate; any one then stands for the group.
            F.struct(reaches, F.col("lo")),
        ).alias("_c"),
        F.max("p").alias("p"),
        F.max("n").alias("n"),
    )
    keyed = crossing.select(*groups, F.col("_c.chunk").alias("_chunk"), "_c", "p", "n")
    inside = null_safe_join(cut, keyed, [*groups, "_chunk"])
    down = (
        Window.partitionBy(*groups)
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    tp = F.col("_c.pos_above") + F.sum("pos").over(down)
    fp = F.col("_c.neg_above") + F.sum("neg").over(down)
    points = inside.select(
        *groups,
        "score",
        *[
            F.coalesce(F.try_divide(hits, F.col(total).cast("double")), F.lit(0.0)).alias(name)
            for name, hits, total in (("tpr", tp, "p"), ("fpr", fp, "n"))
        ],
    )
    reached = F.when(F.col("tpr") >= tpr_min, F.col("score"))
    at = points.groupBy(*groups).agg(
        F.max_by(F.struct("score", "tpr", "fpr"), reached).alias("_at")
    )
    passed = F.coalesce(F.col("_at.fpr") <= fpr_max, F.lit(False))
    kept = passed | F.coalesce(F.col("_at.fpr") < 1.0, F.lit(False))
    return at.select(
        *groups,
        passed.alias("passed"),
        F.when(kept, F.col("_at.score")).alias("threshold"),
        F.when(kept, F.col("_at.tpr")).otherwise(F.lit(0.0)).alias("tpr"),
        F.when(kept, F.col("_at.fpr")).otherwise(F.lit(1.0)).alias("fpr"),
    )


def tie_rank(
    scores: DataFrame, groups: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """(groups, score, n, mean_rank): average 1-based rank of each distinct score."""
    counts = score_counts(scores, groups, score, label).withColumn(
        "n", F.col("pos") + F.col("neg")
    )
    ranked = range_totals(counts, ["score"], {"_below": F.col("n")}, groups)
    return ranked.select(
        *groups,
        "score",
        "n",
        (F.col("_below") + (F.col("n") + 1) / F.lit(2.0)).alias("mean_rank"),
    )


def epoch_metrics(
    scores: DataFrame, run: str = "run", epoch: str = "epoch", targets: dict | None = None
) -> DataFrame:
    """Per (run, epoch): auc, score_std, ROC gate, joint interval and its width; runs the job of the counts."""
    keys = [run, epoch]
    # The per-score counts are the one large intermediate; written in chunks, they serve all three metrics.
    cut = materialize(cut_counts(score_counts(scores, keys), keys))
    buckets = cut.groupBy(*keys, grid_bucket(F.col("score")).alias("bucket")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    interval = feasible_interval(
        sweep_from_counts(buckets, keys), targets or FORGERY_TARGETS, keys
    ).select(*keys, "t_min", "t_max", "width", "infeasible")
    spread = scores.groupBy(*keys).agg(F.stddev_pop("score").alias("score_std"))
    gate = roc_gate_from_cut(cut, keys).select(
        *keys,
        F.col("passed").alias("gate_passed"),
        F.col("tpr").alias("gate_tpr"),
        F.col("fpr").alias("gate_fpr"),
    )
    auc = rank_auc_from_cut(cut, keys).select(*keys, "auc")
    out = spread
    for part in (auc, gate, interval):
        out = null_safe_join(out, part, keys, "left")
    return out


def best_checkpoint(epochs: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Per run the epoch of greatest width, then AUC; the earliest on ties."""
    order = F.struct(F.col("width"), F.col("auc"), -F.col(epoch))
    return (
        epochs.groupBy(run)
        .agg(F.max_by(F.struct(epoch, "width", "auc"), order).alias("_best"))
        .select(run, "_best.*")
    )


def collapse_streak(
    epochs: DataFrame,
    run: str = "run",
    epoch: str = "epoch",
    std: str = "score_std",
    limit: float = COLLAPSE_STD,
) -> DataFrame:
    """Adds ``streak``: consecutive epochs up to here whose scores are constant."""
    by_epoch = Window.partitionBy(run).orderBy(epoch)
    flat = F.col(std) < limit
    island = Window.partitionBy(run, "_healthy").orderBy(epoch)
    return (
        epochs.withColumn(
            "_healthy", F.count_if(~flat).over(by_epoch.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("_flat", flat)
        .withColumn(
            "streak",
            F.count_if(F.col("_flat")).over(island.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .drop("_healthy", "_flat")
    )


def collapse_stop(
    streaks: DataFrame, run: str = "run", epoch: str = "epoch", patience: int = COLLAPSE_PATIENCE
) -> DataFrame:
    """Per run the first epoch at which the streak exhausts the patience; null if none."""
    return streaks.groupBy(run).agg(
        F.min(F.when(F.col("streak") >= patience, F.col(epoch))).alias("stop_epoch")
    )


def seed_summary(seeds: DataFrame, tpr_min: float = 0.88, f1_min: float = 0.79) -> DataFrame:
    """(seed, infeasible, tpr, f1) rows to one verdict by the minimum over seeds."""
    any_infeasible = F.coalesce(F.bool_or("infeasible"), F.lit(False))
    return seeds.groupBy().agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.min("tpr").alias("tpr_min"),
        F.max("tpr").alias("tpr_max"),
        F.avg("tpr").alias("tpr_mean"),
        F.min("f1").alias("f1_min"),
        F.max("f1").alias("f1_max"),
        F.avg("f1").alias("f1_mean"),
        any_infeasible.alias("any_infeasible"),
        F.coalesce(
            ~any_infeasible & (F.min("tpr") >= tpr_min) & (F.min("f1") >= f1_min), F.lit(False)
        ).alias("pass_by_minimum"),
    )
