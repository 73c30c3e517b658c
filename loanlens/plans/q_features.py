"""Registered derived-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators.features import (age_bucket_expr, default_flag_expr, derive_features,
                                         emp_length_bin_expr)
from loanlens.plans.base import clean, feat
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, FEAT, with_


@register("feature_ratios_train", rounded(with_(CLEAN, FEAT) +
          "SELECT app_id, loan_to_income, employ_to_age FROM feat", ["loan_to_income", "employ_to_age"]))
def feature_ratios_train(spark, d):
    """E1-E2, training dialect: a zero divisor gives null."""
    return feat(spark, d).select("app_id", "loan_to_income", "employ_to_age")


@register("feature_ratios_serve", rounded(with_(CLEAN) +
          "SELECT app_id, loan_amnt / CASE WHEN person_income = 0 THEN 0.01e0 ELSE person_income END AS loan_to_income, "
          "person_emp_length / CASE WHEN person_age = 0 THEN 0.01e0 ELSE person_age END AS employ_to_age FROM clean",
          ["loan_to_income", "employ_to_age"]))
def feature_ratios_serve(spark, d):
    """E1-E2, serving dialect: a zero divisor is replaced by 0.01."""
    df = clean(spark, d).withColumn("cb_person_default_on_file",
                                    F.when(F.col("cb_person_default_on_file") == "Y", 1).otherwise(0))
    return derive_features(df, mode="serve").select("app_id", "loan_to_income", "employ_to_age")


@register("age_bucket", with_(CLEAN, FEAT) + "SELECT app_id, person_age, age_bucket FROM feat")
def age_bucket(spark, d):
    """Right-closed age buckets; 18 falls in none (null)."""
    return clean(spark, d).select("app_id", "person_age", age_bucket_expr().alias("age_bucket"))


@register("emp_length_bin", rounded(with_(CLEAN, FEAT) + "SELECT app_id, person_emp_length, emp_length_bin FROM feat",
                                    ["person_emp_length"]))
def emp_length_bin(spark, d):
    """Right-closed employment bins of coalesce(emp, 0)."""
    return clean(spark, d).select("app_id", "person_emp_length", emp_length_bin_expr().alias("emp_length_bin"))


@register("default_flag", with_(CLEAN, FEAT) + "SELECT app_id, cb_person_default_on_file, default_flag FROM feat")
def default_flag(spark, d):
    """E5, training dialect: Y -> 1, N -> 0, other -> 0."""
    return clean(spark, d).select("app_id", "cb_person_default_on_file",
                                  default_flag_expr("train").alias("default_flag"))


@register("derived_features", rounded(with_(CLEAN, FEAT) +
          "SELECT app_id, loan_to_income, employ_to_age, age_bucket, emp_length_bin, default_flag FROM feat",
          ["loan_to_income", "employ_to_age"]))
def derived_features(spark, d):
    """All derived columns in one projection."""
    return feat(spark, d).select("app_id", "loan_to_income", "employ_to_age", "age_bucket",
                                 "emp_length_bin", "default_flag")
