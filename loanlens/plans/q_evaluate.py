"""Registered evaluation queries on the deterministic ``pseudo_score``."""

from __future__ import annotations

from loanlens.operators import evaluate as EV
from loanlens.plans.base import scored
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, PSEUDO, with_

HIST = ("h AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg "
        "FROM scored GROUP BY score)")
CUM = ("cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, "
       "sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM h)")
ROC = ("roc AS (SELECT CAST(NULL AS DOUBLE) AS threshold, 0e0 AS fpr, 0e0 AS tpr UNION ALL "
       "SELECT score, coalesce(fp / nullif(CAST(N AS DOUBLE), 0), 0e0), coalesce(tp / nullif(CAST(P AS DOUBLE), 0), 0e0) FROM cu)")
METRICS = ("coalesce((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 0e0) AS accuracy, "
           "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0e0) AS precision, "
           "coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0) AS recall, "
           "coalesce(2*tp / nullif(CAST(2*tp + fp + fn AS DOUBLE), 0), 0e0) AS f1")
MET_COLS = ["accuracy", "precision", "recall", "f1"]


def cm_sql(t: str) -> str:
    return (f"count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND label <> 1) AS fp, "
            f"count(*) FILTER (WHERE score < {t} AND label <> 1) AS tn, count(*) FILTER (WHERE score < {t} AND label = 1) AS fn")


SWEEP = ("th AS (SELECT CAST(i AS INT) AS idx, (10 + 5*i)/100e0 AS threshold FROM range(16) r(i))",
         f"sw0 AS (SELECT idx, threshold, {cm_sql('threshold')} FROM th, scored GROUP BY idx, threshold)",
         f"sw AS (SELECT *, {METRICS} FROM sw0)")


@register("confusion_matrix", with_(CLEAN, PSEUDO) + f"SELECT {cm_sql('0.5e0')} FROM scored")
def confusion_matrix(spark, d):
    """H1 at threshold 0.5."""
    return EV.confusion(scored(spark, d), 0.5)


@register("classification_metrics", rounded(with_(CLEAN, PSEUDO, f"m AS (SELECT {cm_sql('0.5e0')} FROM scored)") +
          f"SELECT *, {METRICS} FROM m", MET_COLS))
def classification_metrics(spark, d):
    """H2 at threshold 0.5."""
    return EV.classification_metrics(scored(spark, d), 0.5)


@register("roc_auc", rounded(with_(CLEAN, PSEUDO, HIST, CUM) +
          "SELECT sum(neg * (tp - pos/2e0)) / (max(N) * CAST(max(P) AS DOUBLE)) AS roc_auc FROM cu", ["roc_auc"]))
def roc_auc(spark, d):
    """H3: ROC-AUC with ties counted one half."""
    return EV.roc_auc(scored(spark, d))


@register("roc_curve", rounded(with_(CLEAN, PSEUDO, HIST, CUM, ROC) + "SELECT * FROM roc",
                               ["threshold", "fpr", "tpr"]))
def roc_curve(spark, d):
    """H4: all ROC points from the origin."""
    return EV.roc_curve(scored(spark, d))


@register("auc_trapezoid", rounded(with_(CLEAN, PSEUDO, HIST, CUM, ROC) +
          "SELECT coalesce(sum((x - px) * (y + py) / 2e0), 0e0) AS auc FROM (SELECT fpr AS x, tpr AS y, "
          "lag(fpr) OVER (ORDER BY fpr, tpr) AS px, lag(tpr) OVER (ORDER BY fpr, tpr) AS py FROM roc)", ["auc"]))
def auc_trapezoid(spark, d):
    """H5: trapezoid area under the ROC points."""
    return EV.auc_trapezoid(EV.roc_curve(scored(spark, d)))


@register("pr_curve", rounded(with_(CLEAN, PSEUDO, HIST, CUM) +
          "SELECT score AS threshold, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0e0) AS precision, "
          "coalesce(tp / nullif(CAST(P AS DOUBLE), 0), 0e0) AS recall FROM cu WHERE tp - pos < P "
          "UNION ALL SELECT NULL, 1e0, 0e0", ["threshold", "precision", "recall"]))
def pr_curve(spark, d):
    """H6: precision-recall points, ending at (recall 0, precision 1)."""
    return EV.pr_curve(scored(spark, d))


@register("average_precision", rounded(with_(CLEAN, PSEUDO, HIST, CUM) +
          "SELECT coalesce(sum(pos / CAST(P AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)), 0e0) AS average_precision FROM cu",
          ["average_precision"]))
def average_precision(spark, d):
    """H7: step-sum average precision."""
    return EV.average_precision(scored(spark, d))


@register("threshold_sweep", rounded(with_(CLEAN, PSEUDO, *SWEEP) + "SELECT * FROM sw", ["threshold"] + MET_COLS))
def threshold_sweep(spark, d):
    """H8: 16 thresholds 0.10 .. 0.85, prediction score >= t."""
    return EV.threshold_sweep(scored(spark, d))


@register("best_threshold", rounded(with_(CLEAN, PSEUDO, *SWEEP) +
          "SELECT *, 'fixed_index' AS policy FROM sw WHERE idx = 9 UNION ALL "
          "SELECT * FROM (SELECT *, 'max_f1' AS policy FROM sw ORDER BY f1 DESC, threshold ASC LIMIT 1) UNION ALL "
          "SELECT * FROM (SELECT *, 'min_recall' AS policy FROM sw WHERE recall >= 0.8e0 ORDER BY threshold DESC LIMIT 1)",
          ["threshold"] + MET_COLS))
def best_threshold(spark, d):
    """H9: the chosen threshold under each policy (fixed index 9 = 0.55, max F1, min recall 0.8)."""
    sw = EV.threshold_sweep(scored(spark, d)).cache()  # 16 rows, reused by three policies
    return (EV.best_threshold(sw, "fixed_index").unionByName(EV.best_threshold(sw, "max_f1"))
            .unionByName(EV.best_threshold(sw, "min_recall", min_recall=0.8)))


@register("metrics_at_threshold", rounded(with_(CLEAN, PSEUDO, f"m AS (SELECT {cm_sql('0.55e0')} FROM scored)") +
          f"SELECT *, {METRICS}, 0.55e0 AS threshold FROM m", MET_COLS + ["threshold"]))
def metrics_at_threshold(spark, d):
    """Metrics at the chosen threshold 0.55."""
    return EV.metrics_at_threshold(scored(spark, d), 0.55)


@register("score_histogram", rounded(with_(CLEAN, PSEUDO, HIST, CUM) +
          "SELECT score, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM cu", ["score"]))
def score_histogram(spark, d):
    """Distinct scores with running positives/negatives (the basis of H3-H7)."""
    return EV.score_histogram(scored(spark, d)).select("score", "pos", "neg", "tp", "fp")
