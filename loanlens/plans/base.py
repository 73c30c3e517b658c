"""Shared DataFrame builders for registered queries: every query starts from
the driver's tables, so its work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.operators.clean import clean_applications, filter_outliers
from loanlens.operators.features import derive_features
from loanlens.sources.stages import stage
from loanlens.sources.tables import FEATURES_RAW, TARGET, applications

NUMERIC_RAW = ["person_age", "person_income", "person_emp_length", "loan_amnt",
               "loan_int_rate", "loan_percent_income", "cb_person_cred_hist_length"]
TEXT_RAW = ["person_home_ownership", "loan_intent", "loan_grade", "cb_person_default_on_file"]
assert set(NUMERIC_RAW) | set(TEXT_RAW) == set(FEATURES_RAW)


def _inputs(d: str) -> list[str]:
    return [f"{d.rstrip('/')}/orders.parquet", f"{d.rstrip('/')}/customer.parquet"]


def apps(spark: SparkSession, d: str) -> DataFrame:
    """Stage 1: applications from orders x customer (written once per input)."""
    return stage(spark, "applications", _inputs(d), lambda: applications(spark, d))


def filtered(spark: SparkSession, d: str) -> DataFrame:
    return filter_outliers(apps(spark, d))


def clean(spark: SparkSession, d: str) -> DataFrame:
    """Stage 2: the cleaned table (filters + fills), as the reference persists it."""
    return stage(spark, "clean", _inputs(d), lambda: clean_applications(apps(spark, d)))


def feat(spark: SparkSession, d: str) -> DataFrame:
    return derive_features(clean(spark, d), mode="train")


def pseudo_score(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(app_id, label, score [, keep...]) with a deterministic, tie-rich score."""
    score = ((F.col("app_id") * 7907) % 1000) / F.lit(2000.0) + F.col(TARGET) * F.lit(0.25)
    return df.select("app_id", F.col(TARGET).alias("label"), score.alias("score"), *keep)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return pseudo_score(clean(spark, d))
