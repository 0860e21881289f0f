"""Threshold sweeps: one pass over the scores, whatever the number of thresholds.

Each score falls into the bucket of the last threshold it passes, rows are counted per
(group, bucket) with map-side combine, and the confusion counts at every threshold are suffix
sums over at most ``steps + 2`` buckets of a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.fixedvalues import ROC_GATE_FPR, ROC_GATE_TPR, THIN_MARGIN

METRICS = ("tpr", "fpr", "precision", "f1", "accuracy")
FORGERY_TARGETS = {"tpr": 0.88, "f1": 0.79}
PAIR_TARGETS = {"sensitivity": 0.84, "accuracy": 0.80}


def grid_bucket(score: Column, steps: int = 100, higher_is_positive: bool = True) -> Column:
    """Index of the last grid point i/steps that the score passes; -1 when it passes none.

    With ``higher_is_positive`` false, the first grid point at or above the score; steps + 1 when
    there is none. ``floor(score * steps)`` alone is off by one next to grid points in floating
    point, so it is compared with the neighbouring grid points. NaN passes no point.
    """
    if 100 % steps:
        raise ValueError("steps must divide 100, so that grid points keep two decimals")
    n = F.lit(float(steps))
    if higher_is_positive:
        k = F.floor(score * n)
        exact = (
            k
            + F.when(score >= (k + 1) / n, 1).otherwise(0)
            - F.when(score < k / n, 1).otherwise(0)
        )
        return (
            F.when(F.isnan(score) | (score < 0), -1)
            .when(score >= 1, steps)
            .otherwise(exact)
            .cast("int")
        )
    k = F.ceil(score * n)
    exact = (
        k
        - F.when(score <= (k - 1) / n, 1).otherwise(0)
        + F.when(score > k / n, 1).otherwise(0)
    )
    return (
        F.when(F.isnan(score) | (score > 1), steps + 1)
        .when(score <= 0, 0)
        .otherwise(exact)
        .cast("int")
    )


def score_histogram_counts(
    scores: DataFrame,
    groups: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    steps: int = 100,
    higher_is_positive: bool = True,
    keep_missing: bool = False,
) -> DataFrame:
    """(groups, bucket, pos, neg): additive counts that every sweep derives from.

    Rows without a score are left out, or counted in a null bucket with ``keep_missing``.
    """
    return (
        (scores if keep_missing else scores.where(F.col(score).isNotNull()))
        .groupBy(*groups, grid_bucket(F.col(score), steps, higher_is_positive).alias("bucket"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )


def metrics_from_counts() -> dict[str, Column]:
    """Ratios of tp, fp, tn, fn; 0 when the denominator is 0."""

    def ratio(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    tpr, precision = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return {
        "tpr": tpr,
        "fpr": ratio(fp, fp + tn),
        "precision": precision,
        "f1": ratio(precision * 2.0 * tpr, precision + tpr),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
    }


def sweep_from_counts(
    counts: DataFrame,
    groups: Sequence[str] = (),
    steps: int = 100,
    higher_is_positive: bool = True,
) -> DataFrame:
    """(groups, threshold, tp, fp, tn, fn, metrics...) at every grid point."""
    # A group holds at most steps + 3 buckets here, so the array is bounded. The null bucket is
    # passed over rather than filtered out: a filter would move below the counting and compute
    # every score again.
    scored = F.col("bucket").isNotNull()
    grouped = counts.groupBy(*groups).agg(
        F.collect_list(F.struct("bucket", "pos", "neg")).alias("_hist"),
        F.sum(F.when(scored, F.col("pos")).otherwise(0)).alias("_p"),
        F.sum(F.when(scored, F.col("neg")).otherwise(0)).alias("_n"),
    )

    def passed(part: str) -> Column:
        def accepts(b: Column) -> Column:
            return b["bucket"] >= F.col("_i") if higher_is_positive else b["bucket"] <= F.col("_i")

        return F.aggregate(
            F.filter("_hist", accepts),
            F.lit(0).cast("bigint"),
            lambda acc, b: acc + b[part],
        )

    points = (
        grouped.where(F.size("_hist") > 0)
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        .select(
            *groups,
            (F.col("_i") / F.lit(float(steps))).alias("threshold"),
            passed("pos").alias("tp"),
            passed("neg").alias("fp"),
            "_p",
            "_n",
        )
        .select(
            *groups,
            "threshold",
            "tp",
            "fp",
            (F.col("_n") - F.col("fp")).alias("tn"),
            (F.col("_p") - F.col("tp")).alias("fn"),
        )
    )
    return points.select("*", *[m.alias(name) for name, m in metrics_from_counts().items()])


def threshold_sweep(
    scores: DataFrame,
    groups: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    steps: int = 100,
    higher_is_positive: bool = True,
) -> DataFrame:
    counts = score_histogram_counts(scores, groups, score, label, steps, higher_is_positive)
    return sweep_from_counts(counts, groups, steps, higher_is_positive)


def confusion(
    scores: DataFrame,
    threshold: float,
    groups: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    higher_is_positive: bool = True,
) -> DataFrame:
    """(groups, threshold, tp, fp, tn, fn, metrics...) at one threshold, on the grid or not."""
    value = F.col(score)
    hit = value >= threshold if higher_is_positive else value <= threshold
    hit = hit & ~F.isnan(value)
    positive, negative = F.col(label) == 1, F.col(label) == 0
    counted = (
        scores.where(value.isNotNull())
        .groupBy(*groups)
        .agg(
            F.lit(float(threshold)).alias("threshold"),
            F.count_if(hit & positive).alias("tp"),
            F.count_if(hit & negative).alias("fp"),
            F.count_if(~hit & negative).alias("tn"),
            F.count_if(~hit & positive).alias("fn"),
        )
    )
    return counted.select("*", *[m.alias(name) for name, m in metrics_from_counts().items()])


def is_feasible(targets: Mapping[str, float]) -> Column:
    passed = F.lit(True)
    for metric, target in targets.items():
        passed = passed & (F.col(metric) >= F.lit(float(target)))
    return passed


def margin(metric: str, target: float) -> Column:
    """(metric - target) / target; a zero target gives +inf, or -inf below zero."""
    if target == 0:
        return F.when(F.col(metric) >= 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return (F.col(metric) - F.lit(float(target))) / F.lit(float(target))


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def feasible_interval(
    sweep: DataFrame, targets: Mapping[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """(groups, n_feasible, t_min, t_max, width, infeasible)."""
    ok = F.when(is_feasible(targets), F.col("threshold"))
    return (
        sweep.groupBy(*groups)
        .agg(F.count(ok).alias("n_feasible"), F.min(ok).alias("t_min"), F.max(ok).alias("t_max"))
        .withColumn("width", F.coalesce(F.col("t_max") - F.col("t_min"), F.lit(0.0)))
        .withColumn("infeasible", F.col("n_feasible") == 0)
    )


def maximin_threshold(
    sweep: DataFrame, targets: Mapping[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """The feasible threshold whose worst relative margin is best, one row per group.

    Ties go to the larger worst metric, then to the lower threshold.
    """
    names = list(targets)
    margins = {f"margin_{m}": margin(m, t) for m, t in targets.items()}
    scored = sweep.select("*", *[c.alias(n) for n, c in margins.items()]).select(
        "*", _least([F.col(n) for n in margins]).alias("min_margin")
    )
    payload = F.struct("threshold", *names, *margins, "min_margin")
    order = F.when(
        is_feasible(targets),
        F.struct(
            F.col("min_margin"),
            _least([F.col(m) for m in names]),
            (-F.col("threshold")),
        ),
    )
    interval = F.when(is_feasible(targets), F.col("threshold"))
    return (
        scored.groupBy(*groups)
        .agg(
            F.max_by(payload, order).alias("_best"),
            F.min(interval).alias("t_min"),
            F.max(interval).alias("t_max"),
        )
        .select(
            *groups,
            F.col("_best.threshold").alias("recommended"),
            *[F.col(f"_best.{m}").alias(m) for m in names],
            *[F.col(f"_best.{m}").alias(m) for m in margins],
            F.col("_best.min_margin").alias("min_margin"),
            "t_min",
            "t_max",
            F.col("_best").isNull().alias("infeasible"),
        )
    )


def thin_margin_warning(
    operating: DataFrame, targets: Mapping[str, float], below: float = THIN_MARGIN
) -> DataFrame:
    """Adds ``thin``: some margin at the chosen threshold is below the limit."""
    thin = F.lit(False)
    for metric in targets:
        thin = thin | F.coalesce(F.col(f"margin_{metric}") < below, F.lit(False))
    return operating.withColumn("thin", thin)


def sweep_tolerant(
    sweep: DataFrame, targets: Mapping[str, float], groups: Sequence[str] = ()
) -> DataFrame:
    """Best effort: feasible first, then the least ratio to target, f1, tpr; earliest on ties."""
    ratios = [
        F.col(m) / F.lit(float(t)) if t else F.lit(0.0) for m, t in targets.items()
    ]
    order = F.struct(
        is_feasible(targets).cast("int"), _least(ratios), F.col("f1"), F.col("tpr"),
        -F.col("threshold"),
    )
    payload = F.struct("threshold", "tpr", "fpr", "precision", "f1")
    ok = F.when(is_feasible(targets), F.col("threshold"))
    return (
        sweep.groupBy(*groups)
        .agg(
            F.max_by(payload, order).alias("_best"),
            F.coalesce(F.max(ok) - F.min(ok), F.lit(0.0)).alias("width"),
            (F.count(ok) == 0).alias("infeasible"),
        )
        .select(*groups, "_best.*", "width", "infeasible")
    )


def at_tpr_floor(
    sweep: DataFrame, floor: float = ROC_GATE_TPR, groups: Sequence[str] = ()
) -> DataFrame:
    """Metrics at the lowest threshold that reaches the floor."""
    payload = F.struct("threshold", "tpr", "fpr", "precision", "f1")
    return (
        sweep.where(F.col("tpr") >= floor)
        .groupBy(*groups)
        .agg(F.min_by(payload, F.col("threshold")).alias("_at"))
        .select(*groups, "_at.*")
    )


def roc_gate_grid(
    sweep: DataFrame,
    groups: Sequence[str] = (),
    tpr_min: float = ROC_GATE_TPR,
    fpr_max: float = ROC_GATE_FPR,
) -> DataFrame:
    return sweep.groupBy(*groups).agg(
        F.bool_or((F.col("fpr") <= fpr_max) & (F.col("tpr") >= tpr_min)).alias("roc_gate_pass")
    )


def youden_best(sweep: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    payload = F.struct("threshold", "tpr", "fpr", "precision", "f1")
    order = F.struct(F.col("tpr") - F.col("fpr"), -F.col("threshold"))
    return (
        sweep.groupBy(*groups)
        .agg(F.max_by(payload, order).alias("_best"))
        .select(*groups, "_best.*")
    )


def domain_gate(
    operating: DataFrame, domain: str = "domain", require_cross: bool = True
) -> DataFrame:
    """The deciding domain: cross_domain, else in_domain, else the first by name.

    Without a cross_domain row while one is required, the gate is infeasible.
    """
    priority = F.struct(
        F.when(F.col(domain) == "cross_domain", 0).when(F.col(domain) == "in_domain", 1).otherwise(2),
        F.col(domain),
    )
    others = [c for c in operating.columns if c not in (domain, "infeasible")]
    gate = operating.groupBy().agg(
        F.min_by(F.struct(domain, "infeasible", *others), priority).alias("_gate"),
        F.coalesce(F.bool_or(F.col(domain) == "cross_domain"), F.lit(False)).alias("_has_cross"),
    )
    missing = F.lit(require_cross) & ~F.col("_has_cross")
    return gate.select(
        F.col(f"_gate.{domain}").alias("gate_domain"),
        missing.alias("missing_cross_domain"),
        (F.coalesce("_gate.infeasible", F.lit(True)) | missing).alias("infeasible"),
        *[F.col(f"_gate.{c}").alias(c) for c in others],
    )


def class_means(
    scores: DataFrame, groups: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    return scores.groupBy(*groups).agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("mean_pos"),
        F.avg(F.when(F.col(label) == 0, F.col(score))).alias("mean_neg"),
    )


def class_balance(df: DataFrame, groups: Sequence[str] = (), label: str = "label") -> DataFrame:
    return (
        df.groupBy(*groups)
        .agg(
            F.count_if(F.col(label) == 1).alias("n_pos"),
            F.count_if(F.col(label) == 0).alias("n_neg"),
        )
        .withColumn(
            "pos_weight",
            F.col("n_neg").cast("double") / F.greatest(F.col("n_pos"), F.lit(1)).cast("double"),
        )
    )
