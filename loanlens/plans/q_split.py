"""Registered split / fold / weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import split as S
from loanlens.plans.base import clean
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, with_

SPLIT = ("sp AS (SELECT app_id, loan_status, CASE WHEN row_number() OVER (PARTITION BY loan_status "
         "ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) <= ceil(count(*) OVER (PARTITION BY loan_status) * 0.2e0) "
         "THEN 'test' ELSE 'train' END AS split FROM clean)")
TRAIN = "tr AS (SELECT * FROM sp WHERE split = 'train')"


def train_part(spark, d):
    return S.stratified_split(clean(spark, d)).where(F.col("split") == "train")


@register("stratified_split", with_(CLEAN, SPLIT) + "SELECT app_id, loan_status, split FROM sp")
def stratified_split(spark, d):
    """G1: exact per-class 80/20 split in a seeded md5 order."""
    return S.stratified_split(clean(spark, d)).select("app_id", "loan_status", "split")


@register("class_ratio", rounded(with_(CLEAN, SPLIT, TRAIN) +
          "SELECT count(*) FILTER (WHERE loan_status = 0) AS n0, count(*) FILTER (WHERE loan_status = 1) AS n1, "
          "count(*) FILTER (WHERE loan_status = 0) / nullif(CAST(count(*) FILTER (WHERE loan_status = 1) AS DOUBLE), 0) "
          "AS ratio FROM tr", ["ratio"]))
def class_ratio(spark, d):
    """n0 / n1 on the training part."""
    return S.class_ratio(train_part(spark, d))


@register("class_weights", rounded(with_(CLEAN, SPLIT, TRAIN,
          "cn AS (SELECT loan_status, count(*) AS n FROM tr GROUP BY loan_status)") +
          "SELECT loan_status, n, (SELECT sum(n) FROM cn) / (CAST((SELECT count(*) FROM cn) AS DOUBLE) * n) AS weight FROM cn",
          ["weight"]))
def class_weights(spark, d):
    """Balanced weights n / (2 n_c) on the training part."""
    return S.class_weights(train_part(spark, d))


@register("stratified_folds", with_(CLEAN) +
          "SELECT app_id, loan_status, CAST((row_number() OVER (PARTITION BY loan_status "
          "ORDER BY md5(CAST(app_id AS VARCHAR) || '|42'), app_id) - 1) % 5 AS INT) AS fold FROM clean")
def stratified_folds(spark, d):
    """Stratified 5 folds on all rows, round-robin in the seeded order."""
    return S.stratified_folds(clean(spark, d)).select("app_id", "loan_status", "fold")
