"""Registered model, tuning, scoring and run-table queries.

Model-dependent queries have no oracle (rows-only check); they return few,
stable rows. The CV and grid queries have the reference's sizes (100 trees,
100 rounds, 5 folds, 81 boosting and 27 forest settings).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.operators import train as TR
from loanlens.operators.evaluate import classification_metrics
from loanlens.operators.features import serving_view
from loanlens.operators.score import score_records
from loanlens.plans.base import _inputs, apps, scored
from loanlens.plans.modeling import prepare
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, PSEUDO, with_
from loanlens.sources import batches as B
from loanlens.sources.runs import metrics_long
from loanlens.sources.stages import input_stamp

_FITTED: dict[tuple, TR.FittedModel] = {}


def fitted(spark, d, kind: str) -> tuple:
    p = prepare(spark, d)
    key = (spark.sparkContext.applicationId, d, input_stamp(spark, _inputs(d)), kind)
    if key not in _FITTED:
        _FITTED[key] = TR.fit_model(kind, p.train)
    return p, _FITTED[key]


def _train_query(kind: str):
    def q(spark, d):
        p, m = fitted(spark, d, kind)
        return TR.test_metrics(m, p.test).withColumn("n_train", F.lit(p.train.count())) \
                                         .withColumn("n_test", F.lit(p.test.count()))
    q.__doc__ = f"G4-G7: fit {kind} on the stratified training part; metrics on the test part."
    return q


for _k, _name in (("logreg", "train_logreg"), ("forest", "train_forest"), ("gbt", "train_gbt"), ("svm", "train_svm")):
    register(_name)(_train_query(_k))


@register("cv_summary")
def cv_summary(spark, d):
    """5-fold stratified CV of the four models; mean and population std per metric."""
    p = prepare(spark, d)
    per_fold = TR.cross_validate(p.data, list(TR.MODELS), 5)
    return TR.cv_summary(per_fold)


@register("grid_search")
def grid_search(spark, d):
    """The reference's grid per model over the 5 folds, by recall of class 1."""
    p = prepare(spark, d)
    rows = []
    for kind in ("gbt", "forest"):
        _, r = TR.grid_search(p.train.select("app_id", "label", "features", "fold"), kind, TR.REFERENCE_GRIDS[kind])
        rows += r
    return spark.createDataFrame(rows, "model string, params string, mean_recall double")


@register("feature_importance")
def feature_importance(spark, d):
    """Forest importances of the selected features, top 15."""
    p = prepare(spark, d)
    key = (spark.sparkContext.applicationId, d, input_stamp(spark, _inputs(d)), "forest")
    m = _FITTED.get(key) or TR.fit_importances(p.train)     # a forest fitted in this session has its trees already
    rows = TR.feature_importance(m, p.selected)[:15]
    return spark.createDataFrame([(i + 1, n, float(v)) for i, (n, v) in enumerate(rows)],
                                 "rank int, feature string, importance double")


def _comparison(spark, d):
    """A metrics row per model. The fits run at once: each leaves cores idle between its many short jobs."""
    p = prepare(spark, d)

    def measured(kind: str):
        return TR.test_metrics(fitted(spark, d, kind)[1], p.test)
    with ThreadPoolExecutor(max_workers=len(TR.MODELS)) as ex:
        return reduce(DataFrame.unionByName, ex.map(measured, TR.MODELS))


@register("model_comparison")
def model_comparison(spark, d):
    """One metrics row per model, rounded to 4 (half up)."""
    cmp = _comparison(spark, d)
    return cmp.select("model", *[(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c)
                                 for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@register("best_model")
def best_model(spark, d):
    """The model with the highest test recall (ties: higher ROC-AUC, then name)."""
    return _comparison(spark, d).orderBy(F.desc("recall"), F.desc("roc_auc"), "model").limit(1)


@register("score_batch")
def score_batch(spark, d):
    """Validate, derive, encode, select and predict every application (GBT, t = 0.55)."""
    p, m = fitted(spark, d, "gbt")
    return score_records(serving_view(apps(spark, d)), p.encoder, p.selected, m, 0.55)


@register("model_info")
def model_info(spark, d):
    """I4: model type, threshold and selected features of the deployed model."""
    p, m = fitted(spark, d, "gbt")
    rows = [("model_type", "gbt"), ("threshold", "0.55"), ("n_features", str(len(p.selected))),
            ("features", ",".join(p.selected)), ("n_train", str(p.train.count()))]
    return spark.createDataFrame(rows, "key string, value string")


@register("run_metrics_long", rounded(with_(CLEAN, PSEUDO,
          "m AS (SELECT count(*) FILTER (WHERE score >= 0.5e0 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5e0 AND label <> 1) AS fp, "
          "count(*) FILTER (WHERE score < 0.5e0 AND label <> 1) AS tn, count(*) FILTER (WHERE score < 0.5e0 AND label = 1) AS fn FROM scored)") +
          "SELECT 'tp' AS name, CAST(tp AS DOUBLE) AS value FROM m UNION ALL SELECT 'fp', CAST(fp AS DOUBLE) FROM m UNION ALL "
          "SELECT 'tn', CAST(tn AS DOUBLE) FROM m UNION ALL SELECT 'fn', CAST(fn AS DOUBLE) FROM m UNION ALL "
          "SELECT 'accuracy', (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) FROM m UNION ALL "
          "SELECT 'precision', coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0e0) FROM m UNION ALL "
          "SELECT 'recall', coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0) FROM m UNION ALL "
          "SELECT 'f1', coalesce(2*tp / nullif(CAST(2*tp + fp + fn AS DOUBLE), 0), 0e0) FROM m", ["value"]))
def run_metrics_long(spark, d):
    """A metrics row as the long (name, value) rows of the run table."""
    return metrics_long(classification_metrics(scored(spark, d), 0.5))


@register("explode_batch", rounded(with_() +
          "SELECT CAST(floor(app_id / 100) AS BIGINT) AS batch_id, "
          "CAST(row_number() OVER (PARTITION BY floor(app_id / 100) ORDER BY app_id) - 1 AS INT) AS position, "
          "app_id, person_age, person_income, person_home_ownership, person_emp_length, loan_intent, loan_grade, loan_amnt, "
          "loan_int_rate, loan_percent_income, cb_person_default_on_file, cb_person_cred_hist_length FROM applications",
          ["person_income", "person_emp_length", "loan_amnt", "loan_int_rate", "loan_percent_income"]))
def explode_batch(spark, d):
    """A3: pack applications into envelopes of <= 100 records, then unpack them."""
    return B.explode_envelopes(B.to_envelopes(apps(spark, d)))
