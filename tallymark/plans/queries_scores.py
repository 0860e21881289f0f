"""Sweeps, ranks and gates over order scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.vectors import score_fusion, sigmoid
from tallymark.operators import ranking, reporting, sweep
from tallymark.plans.catalog import query, table
from tallymark.sources.sinks import sweep_csv_rows

TARGETS = sweep.FORGERY_TARGETS


def scores(spark, folder) -> DataFrame:
    """One score per order; the label follows the score with noise, the domain is the status."""
    orders = table(spark, folder, "orders")
    score = F.col("o_totalprice") / F.lit(500000.0)
    noise = (F.col("o_orderkey") * 7919 % 100) / F.lit(250.0)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("domain"),
        (F.col("o_custkey") % 10).cast("int").alias("run"),
        score.alias("score"),
        F.when(score + noise > 0.7, 1).otherwise(0).alias("label"),
    )


def ties(spark, folder) -> DataFrame:
    """Few distinct scores, each next to a grid point."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_discount") * 10.0).alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_linestatus").alias("domain"),
    )


def epochs(spark, folder) -> DataFrame:
    """Scores of two runs of five epochs; two middle epochs of the first run collapse."""
    rows = scores(spark, folder).select(
        F.when(F.col("run") < 5, "a").otherwise("b").alias("run"),
        (F.col("run") % 5).alias("epoch"),
        "label",
        "score",
    )
    collapsed = (F.col("run") == "a") & F.col("epoch").isin(2, 3)
    return rows.withColumn("score", F.when(collapsed, F.lit(0.5)).otherwise(F.col("score")))


SCORES = """
fx_scores AS (
  SELECT o_orderkey AS id, o_orderstatus AS domain, CAST(o_custkey % 10 AS INTEGER) AS run,
         o_totalprice / 500000e0 AS score,
         CASE WHEN o_totalprice / 500000e0 + (o_orderkey * 7919 % 100) / 250e0 > 0.7e0
              THEN 1 ELSE 0 END AS label
  FROM orders)"""

TIES = """
fx_ties AS (
  SELECT l_discount * 10e0 AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_linestatus AS domain
  FROM lineitem)"""

EPOCHS = SCORES + """,
fx_epochs AS (
  SELECT CASE WHEN run < 5 THEN 'a' ELSE 'b' END AS run, run % 5 AS epoch, label,
         CASE WHEN run IN (2, 3) THEN 0.5e0 ELSE score END AS score
  FROM fx_scores)"""


def sweep_sql(source: str, groups: str = "", op: str = ">=", score: str = "score") -> str:
    """CTE ``swept``: metrics at all 101 thresholds by brute force."""
    keys = f"{groups}, " if groups else ""
    return f"""
grid AS (SELECT i / 100e0 AS threshold FROM range(101) g(i)),
confusion AS (
  SELECT {keys}threshold,
         count(*) FILTER (WHERE {score} {op} threshold AND label = 1) AS tp,
         count(*) FILTER (WHERE {score} {op} threshold AND label = 0) AS fp,
         count(*) FILTER (WHERE NOT ({score} {op} threshold) AND label = 0) AS tn,
         count(*) FILTER (WHERE NOT ({score} {op} threshold) AND label = 1) AS fn
  FROM {source} CROSS JOIN grid GROUP BY {keys}threshold),
rates AS (
  SELECT *, CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fn) END AS tpr,
         CASE WHEN fp + tn = 0 THEN 0e0 ELSE fp::DOUBLE / (fp + tn) END AS fpr,
         CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp::DOUBLE / (tp + fp) END AS "precision",
         (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy
  FROM confusion),
swept AS (
  SELECT *, CASE WHEN "precision" + tpr = 0 THEN 0e0
                 ELSE 2e0 * "precision" * tpr / ("precision" + tpr) END AS f1
  FROM rates)"""


def maximin_sql(groups: str = "domain", a: str = "tpr", ta: float = 0.88, b: str = "f1",
                tb: float = 0.79, source: str = "swept") -> str:
    """CTEs ``margins`` and ``chosen``: the best feasible threshold per group."""
    return f"""
margins AS (
  SELECT *, ({a} - {ta}e0) / {ta}e0 AS margin_{a}, ({b} - {tb}e0) / {tb}e0 AS margin_{b},
         {a} >= {ta}e0 AND {b} >= {tb}e0 AS ok
  FROM {source}),
chosen AS (
  SELECT {groups}, threshold AS recommended, {a}, {b}, margin_{a}, margin_{b},
         least(margin_{a}, margin_{b}) AS min_margin
  FROM margins WHERE ok
  QUALIFY row_number() OVER (PARTITION BY {groups}
     ORDER BY least(margin_{a}, margin_{b}) DESC, least({a}, {b}) DESC, threshold) = 1),
spans AS (
  SELECT {groups}, min(threshold) FILTER (WHERE ok) AS t_min,
         max(threshold) FILTER (WHERE ok) AS t_max,
         count(*) FILTER (WHERE ok) AS n_feasible
  FROM margins GROUP BY {groups}),
operating AS (
  SELECT {groups}, recommended, {a}, {b}, margin_{a}, margin_{b}, min_margin, t_min, t_max,
         recommended IS NULL AS infeasible
  FROM spans LEFT JOIN chosen USING ({groups}))"""


_METRICS = 'threshold, tp, fp, tn, fn, tpr, fpr, "precision", f1, accuracy'
_BY_DOMAIN = f"WITH {SCORES}, {sweep_sql('fx_scores', 'domain')}"


@query("threshold_sweep", f"WITH {SCORES}, {sweep_sql('fx_scores')} SELECT {_METRICS} FROM swept")
def _(spark, folder):
    return sweep.threshold_sweep(scores(spark, folder))


@query("sweep_by_domain", f"{_BY_DOMAIN} SELECT domain, {_METRICS} FROM swept")
def sweep_by_domain(spark, folder):
    return sweep.threshold_sweep(scores(spark, folder), ["domain"])


@query(
    "sweep_grid_ties",
    f"WITH {TIES}, {sweep_sql('fx_ties', 'domain')} SELECT domain, {_METRICS} FROM swept",
)
def _(spark, folder):
    return sweep.threshold_sweep(ties(spark, folder), ["domain"])


@query(
    "sweep_lower_positive",
    f"WITH {TIES}, {sweep_sql('fx_ties', 'domain', '<=')} SELECT domain, {_METRICS} FROM swept",
)
def _(spark, folder):
    return sweep.threshold_sweep(ties(spark, folder), ["domain"], higher_is_positive=False)


@query(
    "sweep_csv_rows",
    f"""{_BY_DOMAIN} SELECT domain, printf('%.2f', threshold) AS threshold,
        printf('%.6f', tpr) AS tpr, printf('%.6f', fpr) AS fpr,
        printf('%.6f', "precision") AS "precision", printf('%.6f', f1) AS f1 FROM swept""",
)
def _(spark, folder):
    swept = sweep.threshold_sweep(scores(spark, folder), ["domain"])
    return sweep_csv_rows(swept, ["tpr", "fpr", "precision", "f1"], ["domain"])


@query(
    "feasible_interval",
    f"""{_BY_DOMAIN}, {maximin_sql()}
    SELECT domain, n_feasible, t_min, t_max, coalesce(t_max - t_min, 0e0) AS width,
           n_feasible = 0 AS infeasible FROM spans""",
)
def _(spark, folder):
    swept = sweep.threshold_sweep(scores(spark, folder), ["domain"])
    return sweep.feasible_interval(swept, TARGETS, ["domain"])


@query(
    "confusion",
    f"""WITH {SCORES}, counted AS (
      SELECT domain, 0.4321e0 AS threshold, count(*) FILTER (WHERE score >= 0.4321e0 AND label = 1) AS tp,
        count(*) FILTER (WHERE score >= 0.4321e0 AND label = 0) AS fp,
        count(*) FILTER (WHERE score < 0.4321e0 AND label = 0) AS tn,
        count(*) FILTER (WHERE score < 0.4321e0 AND label = 1) AS fn FROM fx_scores GROUP BY domain)
    SELECT domain, threshold, tp, fp, tn, fn, accuracy, tp::DOUBLE / (tp + fn) AS tpr,
      fp::DOUBLE / (fp + tn) AS fpr, tp::DOUBLE / (tp + fp) AS "precision",
      2e0 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn))
        / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) AS f1
    FROM (SELECT *, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy FROM counted)""",
)
def _(spark, folder):
    return sweep.confusion(scores(spark, folder), 0.4321, ["domain"])


@query("maximin_threshold", f"{_BY_DOMAIN}, {maximin_sql()} SELECT * FROM operating")
def maximin(spark, folder):
    swept = sweep.threshold_sweep(scores(spark, folder), ["domain"])
    return sweep.maximin_threshold(swept, TARGETS, ["domain"])


@query(
    "thin_margin",
    f"""{_BY_DOMAIN}, {maximin_sql(ta=0.93, tb=0.9)}
    SELECT *, coalesce(margin_tpr < 0.01 OR margin_f1 < 0.01, false) AS thin FROM operating""",
)
def _(spark, folder):
    swept = sweep.threshold_sweep(scores(spark, folder), ["domain"])
    targets = {"tpr": 0.93, "f1": 0.9}
    return sweep.thin_margin_warning(sweep.maximin_threshold(swept, targets, ["domain"]), targets)


@query(
    "youden_best",
    f"""{_BY_DOMAIN} SELECT domain, threshold, tpr, fpr, "precision", f1 FROM swept
    QUALIFY row_number() OVER (PARTITION BY domain ORDER BY tpr - fpr DESC, threshold) = 1""",
)
def _(spark, folder):
    return sweep.youden_best(sweep.threshold_sweep(scores(spark, folder), ["domain"]), ["domain"])


@query(
    "roc_gate_grid",
    f"""{_BY_DOMAIN} SELECT domain, bool_or(fpr <= 0.348e0 AND tpr >= 0.88e0) AS roc_gate_pass
    FROM swept GROUP BY domain""",
)
def _(spark, folder):
    return sweep.roc_gate_grid(sweep.threshold_sweep(scores(spark, folder), ["domain"]), ["domain"])


@query(
    "sweep_tolerant",
    f"""{_BY_DOMAIN}, keyed AS (
      SELECT *, tpr >= 0.88e0 AND f1 >= 0.79e0 AS ok,
             least(tpr / 0.88e0, f1 / 0.79e0) AS ratio FROM swept),
    best AS (SELECT domain, threshold, tpr, fpr, "precision", f1 FROM keyed
      QUALIFY row_number() OVER (PARTITION BY domain
        ORDER BY ok DESC, ratio DESC, f1 DESC, tpr DESC, threshold) = 1),
    span AS (SELECT domain, coalesce(max(threshold) FILTER (WHERE ok)
                - min(threshold) FILTER (WHERE ok), 0e0) AS width,
             NOT bool_or(ok) AS infeasible FROM keyed GROUP BY domain)
    SELECT * FROM best JOIN span USING (domain)""",
)
def _(spark, folder):
    swept = sweep.threshold_sweep(scores(spark, folder), ["domain"])
    return sweep.sweep_tolerant(swept, TARGETS, ["domain"])


@query(
    "at_tpr_floor",
    f"""{_BY_DOMAIN} SELECT domain, threshold, tpr, fpr, "precision", f1 FROM swept
    WHERE tpr >= 0.88e0 QUALIFY row_number() OVER (PARTITION BY domain ORDER BY threshold) = 1""",
)
def _(spark, folder):
    return sweep.at_tpr_floor(
        sweep.threshold_sweep(scores(spark, folder), ["domain"]), groups=["domain"]
    )


@query(
    "domain_gate",
    f"""WITH {SCORES}, renamed AS (
      SELECT CASE domain WHEN 'F' THEN 'in_domain' WHEN 'O' THEN 'cross_domain' ELSE 'other' END
             AS domain, score, label FROM fx_scores),
    {sweep_sql('renamed', 'domain')}, {maximin_sql()}
    SELECT domain AS gate_domain, false AS missing_cross_domain, infeasible, recommended, tpr, f1,
           margin_tpr, margin_f1, min_margin, t_min, t_max
    FROM operating WHERE domain = 'cross_domain'""",
)
def _(spark, folder):
    named = F.when(F.col("domain") == "F", "in_domain").when(
        F.col("domain") == "O", "cross_domain"
    ).otherwise("other")
    swept = sweep.threshold_sweep(scores(spark, folder).withColumn("domain", named), ["domain"])
    return sweep.domain_gate(sweep.maximin_threshold(swept, TARGETS, ["domain"]))


def auc_sql(source: str, groups: str) -> str:
    return f"""
ranked AS (
  SELECT {groups}, score, label,
         rank() OVER (PARTITION BY {groups} ORDER BY score)
         + (count(*) OVER (PARTITION BY {groups}, score) - 1) / 2e0 AS mean_rank
  FROM {source}),
auc AS (
  SELECT {groups}, sum(label)::BIGINT AS n_pos, (count(*) - sum(label))::BIGINT AS n_neg,
         CASE WHEN sum(label) = 0 OR sum(label) = count(*) THEN 0e0 ELSE
         (sum(CASE WHEN label = 1 THEN mean_rank ELSE 0 END)
          - sum(label)::DOUBLE * (sum(label) + 1) / 2)
         / (sum(label)::DOUBLE * (count(*) - sum(label))) END AS auc
  FROM ranked GROUP BY {groups})"""


@query(
    "rank_auc",
    f"WITH {SCORES}, {auc_sql('fx_scores', 'domain')} "
    "SELECT domain, n_pos, n_neg, round(auc, 9) AS auc FROM auc",
)
def _(spark, folder):
    out = ranking.rank_auc(scores(spark, folder), ["domain"])
    return out.withColumn("auc", F.round("auc", 9))


@query(
    "rank_auc_overall",
    f"""WITH {SCORES}, one AS (SELECT 1 AS g, score, label FROM fx_scores), {auc_sql('one', 'g')}
    SELECT n_pos, n_neg, round(auc, 9) AS auc FROM auc""",
)
def _(spark, folder):
    return ranking.rank_auc(scores(spark, folder)).withColumn("auc", F.round("auc", 9))


@query(
    "rank_auc_ties",
    f"WITH {TIES}, {auc_sql('fx_ties', 'domain')} "
    "SELECT domain, n_pos, n_neg, round(auc, 9) AS auc FROM auc",
)
def _(spark, folder):
    out = ranking.rank_auc(ties(spark, folder), ["domain"])
    return out.withColumn("auc", F.round("auc", 9))


@query(
    "tie_rank",
    f"""WITH {TIES} SELECT domain, score, count(*) AS n,
      min(r) + (count(*) - 1) / 2e0 AS mean_rank
    FROM (SELECT domain, score, rank() OVER (PARTITION BY domain ORDER BY score) AS r FROM fx_ties)
    GROUP BY domain, score""",
)
def _(spark, folder):
    return ranking.tie_rank(ties(spark, folder), ["domain"])


def roc_sql(source: str, groups: str) -> str:
    """Walk over distinct scores from the top, in the order of the specification."""
    return f"""
levels AS (
  SELECT {groups}, score, count(*) FILTER (WHERE label = 1) AS pos,
         count(*) FILTER (WHERE label = 0) AS neg FROM {source} GROUP BY {groups}, score),
walked AS (
  SELECT {groups}, score,
         (sum(pos) OVER down)::DOUBLE / nullif(sum(pos) OVER (PARTITION BY {groups}), 0) AS tpr,
         coalesce((sum(neg) OVER down)::DOUBLE
                  / nullif(sum(neg) OVER (PARTITION BY {groups}), 0), 0e0) AS fpr
  FROM levels
  WINDOW down AS (PARTITION BY {groups} ORDER BY score DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
passing AS (SELECT {groups}, score, tpr, fpr FROM walked WHERE tpr >= 0.88e0 AND fpr <= 0.348e0
  QUALIFY row_number() OVER (PARTITION BY {groups} ORDER BY score DESC) = 1),
closest AS (SELECT {groups}, score, tpr, fpr FROM walked WHERE tpr >= 0.88e0 AND fpr < 1
  QUALIFY row_number() OVER (PARTITION BY {groups} ORDER BY fpr, score DESC) = 1),
gate AS (
  SELECT g.*, p.score IS NOT NULL AS passed, coalesce(p.score, c.score) AS threshold,
         coalesce(p.tpr, c.tpr, 0e0) AS tpr, coalesce(p.fpr, c.fpr, 1e0) AS fpr
  FROM (SELECT DISTINCT {groups} FROM {source}) g
  LEFT JOIN passing p USING ({groups}) LEFT JOIN closest c USING ({groups}))"""


@query("roc_gate", f"WITH {SCORES}, {roc_sql('fx_scores', 'domain')} SELECT * FROM gate")
def _(spark, folder):
    return ranking.roc_gate(scores(spark, folder), ["domain"])


@query("roc_gate_ties", f"WITH {TIES}, {roc_sql('fx_ties', 'domain')} SELECT * FROM gate")
def _(spark, folder):
    return ranking.roc_gate(ties(spark, folder), ["domain"])


@query(
    "class_means",
    f"""WITH {SCORES} SELECT domain, round(avg(score) FILTER (WHERE label = 1), 6) AS mean_pos,
      round(avg(score) FILTER (WHERE label = 0), 6) AS mean_neg FROM fx_scores GROUP BY domain""",
)
def _(spark, folder):
    out = sweep.class_means(scores(spark, folder), ["domain"])
    return out.select("domain", *[F.round(c, 6).alias(c) for c in ("mean_pos", "mean_neg")])


@query(
    "class_balance",
    """SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_pos,
      count(*) FILTER (WHERE quality = 0) AS n_neg,
      count(*) FILTER (WHERE quality = 0)::DOUBLE
        / greatest(count(*) FILTER (WHERE quality = 1), 1) AS pos_weight
    FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def _(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id", "lang").join(
        table(spark, folder, "labels"), "doc_id"
    )
    return sweep.class_balance(joined, ["lang"], "quality")


@query(
    "seed_summary",
    f"""WITH {SCORES}, {sweep_sql('fx_scores', 'run')}, {maximin_sql('run')}
    SELECT count(*) AS n_seeds, min(tpr) AS tpr_min, max(tpr) AS tpr_max,
      round(avg(tpr), 9) AS tpr_mean, min(f1) AS f1_min, max(f1) AS f1_max,
      round(avg(f1), 9) AS f1_mean, bool_or(infeasible) AS any_infeasible,
      NOT bool_or(infeasible) AND min(tpr) >= 0.88e0 AND min(f1) >= 0.79e0 AS pass_by_minimum
    FROM operating""",
)
def _(spark, folder):
    swept = sweep.threshold_sweep(scores(spark, folder), ["run"])
    out = ranking.seed_summary(sweep.maximin_threshold(swept, TARGETS, ["run"]))
    return out.withColumns({c: F.round(c, 9) for c in ("tpr_mean", "f1_mean")})


_EPOCH_METRICS = f"""WITH {EPOCHS},
keyed AS (SELECT run || epoch::VARCHAR AS k, run, epoch, score, label FROM fx_epochs),
{sweep_sql('keyed', 'k')}, {maximin_sql('k')}, {auc_sql('keyed', 'k')}, {roc_sql('keyed', 'k')},
epoch_table AS (
  SELECT x.run, x.epoch, x.score_std, auc.auc, gate.passed AS gate_passed, gate.tpr AS gate_tpr,
         gate.fpr AS gate_fpr, t_min, t_max, coalesce(t_max - t_min, 0e0) AS width,
         n_feasible = 0 AS infeasible
  FROM (SELECT k, any_value(run) AS run, any_value(epoch) AS epoch,
               stddev_pop(score) AS score_std FROM keyed GROUP BY k) x
  JOIN auc USING (k) JOIN gate USING (k) JOIN spans USING (k))"""


@query(
    "epoch_metrics",
    f"""{_EPOCH_METRICS} SELECT run, epoch, round(score_std, 9) AS score_std, round(auc, 9) AS auc,
    gate_passed, gate_tpr, gate_fpr, t_min, t_max, width, infeasible FROM epoch_table""",
)
def _(spark, folder):
    out = ranking.epoch_metrics(epochs(spark, folder))
    return out.withColumns({c: F.round(c, 9) for c in ("score_std", "auc")})


@query(
    "best_checkpoint",
    f"""{_EPOCH_METRICS} SELECT run, epoch, width, round(auc, 9) AS auc FROM epoch_table
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY width DESC, round(auc, 9) DESC, epoch) = 1""",
)
def _(spark, folder):
    rounded = ranking.epoch_metrics(epochs(spark, folder)).withColumn("auc", F.round("auc", 9))
    return ranking.best_checkpoint(rounded)


@query(
    "collapse_streak",
    f"""WITH {EPOCHS}, stds AS (
      SELECT run, epoch, stddev_pop(score) < 1e-6 AS flat FROM fx_epochs GROUP BY run, epoch),
    islands AS (SELECT *, count(*) FILTER (WHERE NOT flat) OVER
                  (PARTITION BY run ORDER BY epoch) AS island FROM stds),
    streaks AS (SELECT run, epoch, count(*) FILTER (WHERE flat) OVER
                  (PARTITION BY run, island ORDER BY epoch) AS streak FROM islands)
    SELECT run, epoch, streak, min(epoch) FILTER (WHERE streak >= 2) OVER (PARTITION BY run)
           AS stop_epoch FROM streaks""",
)
def _(spark, folder):
    stds = epochs(spark, folder).groupBy("run", "epoch").agg(
        F.stddev_pop("score").alias("score_std")
    )
    streaks = ranking.collapse_streak(stds).select("run", "epoch", "streak")
    return streaks.join(ranking.collapse_stop(streaks), "run")


def fused(spark, folder) -> DataFrame:
    """Detector score and a probability map out of the elements of each vector, with every fusion of them."""
    vectors = table(spark, folder, "embeddings")
    det = sigmoid(F.col("embedding")[0].cast("double") * 4.0)
    probs = F.transform(F.slice("embedding", 2, 63), lambda x: sigmoid(x.cast("double") * 4.0))
    based = vectors.select(
        F.col("vec_id").alias("id"),
        (F.col("label") % 2).alias("label"),
        det.alias("_det"),
        probs.alias("_probs"),
    )
    parts = score_fusion(F.col("_det"), F.col("_probs"))
    return based.select("id", "label", *[F.round(c, 9).alias(n) for n, c in parts.items()])


_FUSED = """
parts AS (
  SELECT vec_id AS id, label % 2 AS label, 1e0 / (1e0 + exp(-(embedding[1]::DOUBLE * 4e0))) AS det,
    list_transform(embedding[2:64], lambda x: 1e0 / (1e0 + exp(-(x::DOUBLE * 4e0)))) AS probs
  FROM embeddings),
pooled AS (
  SELECT id, label, det, list_avg(probs) AS m, list_max(probs) AS x,
         list_avg(list_reverse_sort(probs)[1:6]) AS t FROM parts),
fused AS (
  SELECT id, label, round(det, 9) AS det, round(m, 9) AS loc_mean, round(x, 9) AS loc_max,
    round(t, 9) AS loc_topk10, round(det * 0.5e0 + m * 0.5e0, 9) AS fuse_mean,
    round(det * 0.5e0 + x * 0.5e0, 9) AS fuse_max, round(det * 0.5e0 + t * 0.5e0, 9) AS fuse_topk,
    round(det * 0.3e0 + x * 0.7e0, 9) AS fuse_max70
  FROM pooled)"""
VARIANTS = ("det", "loc_mean", "loc_max", "loc_topk10", "fuse_mean", "fuse_max", "fuse_topk",
            "fuse_max70")


@query("score_fusion", f"WITH {_FUSED} SELECT * FROM fused")
def _(spark, folder):
    return fused(spark, folder)


@query(
    "variant_table",
    f"""WITH {_FUSED}, longer AS (
      UNPIVOT fused ON {', '.join(VARIANTS)} INTO NAME variant VALUE score),
    {sweep_sql('longer', 'variant')}, {maximin_sql('variant')}, {auc_sql('longer', 'variant')},
    {roc_sql('longer', 'variant')},
    means AS (SELECT variant, avg(score) FILTER (WHERE label = 1) AS mean_pos,
                     avg(score) FILTER (WHERE label = 0) AS mean_neg FROM longer GROUP BY variant)
    SELECT variant, round(auc, 9) AS auc, round(mean_pos, 6) AS mean_pos,
      round(mean_neg, 6) AS mean_neg, gate.passed AS gate_passed, gate.fpr AS gate_fpr, t_min,
      t_max, coalesce(t_max - t_min, 0e0) AS width, recommended
    FROM operating JOIN auc USING (variant) JOIN gate USING (variant) JOIN means USING (variant)""",
)
def _(spark, folder):
    key = ["variant"]
    longer = reporting.score_variants(fused(spark, folder), ["id", "label"], VARIANTS)
    operating = sweep.maximin_threshold(sweep.threshold_sweep(longer, key), TARGETS, key)
    gate = ranking.roc_gate(longer, key).select(
        "variant", F.col("passed").alias("gate_passed"), F.col("fpr").alias("gate_fpr")
    )
    return (
        operating.join(ranking.rank_auc(longer, key), key)
        .join(gate, key)
        .join(sweep.class_means(longer, key), key)
        .select(
            "variant",
            F.round("auc", 9).alias("auc"),
            F.round("mean_pos", 6).alias("mean_pos"),
            F.round("mean_neg", 6).alias("mean_neg"),
            "gate_passed",
            "gate_fpr",
            "t_min",
            "t_max",
            F.coalesce(F.col("t_max") - F.col("t_min"), F.lit(0.0)).alias("width"),
            "recommended",
        )
    )
