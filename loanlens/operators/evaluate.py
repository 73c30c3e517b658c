"""Evaluation of (key, label, score) tables.

Everything is derived from one aggregation of the score histogram: rows are
first reduced to (score, positives, negatives) per distinct score (map-side
combined) and written once; running sums over scores in descending order come
from ``ranks.cumulative`` over buckets cut by a quantile sketch of the distinct
scores, so margins, outliers or scores that crowd together spread alike.

Definitions follow scikit-learn: ROC-AUC counts ties one half; the PR
curve stops at the first threshold reaching full recall and ends at
(recall 0, precision 1); average precision is the step sum
``sum((R_n - R_{n-1}) * P_n)`` (Spark's ``areaUnderPR`` is a trapezoid and
differs); undefined precision/recall/F1 are 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.operators.ranks import cumulative, cut_bucket, sketch_cuts
from loanlens.sources.stages import written


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion(df: DataFrame, threshold: float | Column = 0.5, label: str = "label",
              score: str = "score") -> DataFrame:
    """H1: one row tp, fp, tn, fn with prediction ``score >= threshold``."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    p, y = F.col(score) >= t, F.col(label) == 1
    return df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                  F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))


def metrics_from_counts(cm: DataFrame) -> DataFrame:
    """H2: accuracy, precision, recall, F1 of class 1; 0 when undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cm.select(
        "*",
        _z(F.try_divide((tp + tn).cast("double"), tp + fp + tn + fn)).alias("accuracy"),
        _z(F.try_divide(tp.cast("double"), tp + fp)).alias("precision"),
        _z(F.try_divide(tp.cast("double"), tp + fn)).alias("recall"),
        _z(F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn)).alias("f1"))


def classification_metrics(df: DataFrame, threshold: float = 0.5, label: str = "label",
                           score: str = "score") -> DataFrame:
    return metrics_from_counts(confusion(df, threshold, label, score))


def score_histogram(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg, tp, fp, P, N) per distinct score with inclusive running sums in
    descending score order: tp, fp = rows with score >= this score."""
    h = written(df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")), "score-histogram")
    hb = h.crossJoin(F.broadcast(sketch_cuts(h, "score", sums={"P": "pos", "N": "neg"})))  # one row
    c = cumulative(hb, cut_bucket("score", descending=True), [F.desc("score")], ["pos", "neg"])
    return c.select("score", "pos", "neg", F.col("pos_cum").alias("tp"), F.col("neg_cum").alias("fp"), "P", "N")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """H3: sum over distinct scores of neg/N * (tp - pos/2)/P (ties one half)."""
    h = score_histogram(df, label, score)
    return h.agg(F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)),
                              F.first("N") * F.first("P")).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """H4: (threshold, fpr, tpr) per distinct score, plus the origin (0, 0)
    whose threshold is null (scikit-learn writes +inf there)."""
    h = score_histogram(df, label, score)
    pts = h.select(F.col("score").alias("threshold"),
                   _z(F.try_divide(F.col("fp").cast("double"), F.col("N"))).alias("fpr"),
                   _z(F.try_divide(F.col("tp").cast("double"), F.col("P"))).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def auc_trapezoid(points: DataFrame, x: str = "fpr", y: str = "tpr",
                  order: list[Column] | None = None) -> DataFrame:
    """H5: area by trapezoid over points sorted by ``order`` (default x, then y).

    Steps without width have no area, so points are first reduced to the
    first and last y of each distinct x; a crowded x is one row. These are
    bucketed by sketch cuts: a bucket gives its inner area and its two end
    points, and the joints between buckets are added over those few rows.
    """
    place = F.struct(*(order or [F.col(x), F.col(y)]), F.col(y).alias("_y"))
    p = written(points.groupBy(F.col(x).cast("double").alias("_x")).agg(
        F.min(place)["_y"].cast("double").alias("_y0"), F.max(place)["_y"].cast("double").alias("_y1")), "points")
    p = p.crossJoin(F.broadcast(sketch_cuts(p, "_x"))).select("_x", "_y0", "_y1", cut_bucket("_x").alias("_bk"))  # one row
    w = Window.partitionBy("_bk").orderBy("_x")
    step = (F.col("_x") - F.lag("_x").over(w)) * (F.lag("_y1").over(w) + F.col("_y0")) / 2.0
    ends = p.withColumn("_step", step).groupBy("_bk").agg(
        F.sum("_step").alias("_inner"), F.min("_x").alias("_x0"), F.min_by("_y0", "_x").alias("_y0"),
        F.max("_x").alias("_x1"), F.max_by("_y1", "_x").alias("_y1"))
    wl = Window.orderBy("_bk")  # a row for each bucket, 1,024 at most
    joint = (F.col("_x0") - F.lag("_x1").over(wl)) * (F.lag("_y1").over(wl) + F.col("_y0")) / 2.0
    return (ends.withColumn("_joint", joint)
            .agg(F.coalesce(F.sum(F.coalesce("_inner", F.lit(0.0)) + F.coalesce("_joint", F.lit(0.0))), F.lit(0.0)).alias("auc")))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """H6: (threshold, precision, recall) down to the first full-recall threshold,
    plus the end point (recall 0, precision 1)."""
    h = score_histogram(df, label, score)
    pts = h.where(F.col("tp") - F.col("pos") < F.col("P")).select(
        F.col("score").alias("threshold"),
        _z(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).alias("precision"),
        _z(F.try_divide(F.col("tp").cast("double"), F.col("P"))).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """H7: sum(pos/P * tp/(tp+fp)) over distinct scores; 0 without positives."""
    h = score_histogram(df, label, score)
    return h.agg(F.coalesce(F.sum(F.try_divide(F.col("pos").cast("double"), F.col("P")) * F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))),
                            F.lit(0.0)).alias("average_precision"))


def sweep_thresholds(start: int = 10, stop: int = 90, step: int = 5) -> list[float]:
    """The reference's np.arange(0.1, 0.9, 0.05), as exact (10 + 5 i) / 100."""
    return [v / 100.0 for v in range(start, stop, step)]


def threshold_sweep(df: DataFrame, thresholds: list[float] | None = None, label: str = "label",
                    score: str = "score") -> DataFrame:
    """H8: metrics at every threshold (prediction ``score >= t``).

    Each row is binned once to the number of thresholds it reaches
    (0..len(t)); a grouped count gives <= 2 x (len(t) + 1) rows, which are
    cumulated per threshold on the driver-free small table.
    """
    ts = thresholds or sweep_thresholds()
    spark = df.sparkSession
    reach = reduce(lambda a, b: a + b, [(F.col(score) >= F.lit(t)).cast("int") for t in ts])
    g = df.groupBy(reach.alias("_b")).agg(F.count_if(F.col(label) == 1).alias("_p"),
                                          F.count_if(F.col(label) != 1).alias("_q"))
    tdf = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "idx int, threshold double")
    # a row with bin b satisfies thresholds 0..b-1: it is predicted positive at t_i iff b > i
    j = tdf.crossJoin(F.broadcast(g))  # len(t) x (len(t)+1) rows
    cm = j.groupBy("idx", "threshold").agg(
        F.sum(F.when(F.col("_b") > F.col("idx"), F.col("_p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_b") > F.col("idx"), F.col("_q")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_b") <= F.col("idx"), F.col("_q")).otherwise(0)).alias("tn"),
        F.sum(F.when(F.col("_b") <= F.col("idx"), F.col("_p")).otherwise(0)).alias("fn"))
    return metrics_from_counts(cm)


def best_threshold(sweep: DataFrame, policy: str = "fixed_index", index: int = 9,
                   min_recall: float = 0.8) -> DataFrame:
    """H9: choose a sweep row. 'fixed_index' (the reference's hard-coded row 9),
    'max_f1', or 'min_recall' (highest threshold with recall >= min_recall);
    ties go to the lowest threshold."""
    if policy == "fixed_index":
        out = sweep.where(F.col("idx") == index)
    elif policy == "max_f1":
        out = sweep.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)
    elif policy == "min_recall":
        out = sweep.where(F.col("recall") >= min_recall).orderBy(F.desc("threshold")).limit(1)
    else:
        raise ValueError(policy)
    return out.withColumn("policy", F.lit(policy))


def metrics_at_threshold(df: DataFrame, threshold: float, label: str = "label",
                         score: str = "score") -> DataFrame:
    """H2 at the chosen threshold."""
    return classification_metrics(df, threshold, label, score).withColumn("threshold", F.lit(threshold))


def evaluate_all(df: DataFrame, threshold: float = 0.5, label: str = "label",
                 score: str = "score") -> DataFrame:
    """One row: accuracy, precision, recall, F1 at ``threshold`` and ROC-AUC."""
    m = classification_metrics(df, threshold, label, score)
    return m.crossJoin(F.broadcast(roc_auc(df, label, score)))  # one row each
