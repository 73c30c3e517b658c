"""Registered cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import profile as P
from loanlens.operators.clean import log1p_columns
from loanlens.plans.base import NUMERIC_RAW, clean
from loanlens.plans.q_profile import IQR_DOUBLES, iqr_sql
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, with_

_CLEAN_DOUBLES = ["person_income", "person_emp_length", "loan_amnt", "loan_int_rate", "loan_percent_income"]


@register("clean_applications", rounded(with_(CLEAN) + "SELECT * FROM clean", _CLEAN_DOUBLES))
def clean_applications(spark, d):
    """Age < 100, employment <= 60 (drops nulls), fills, target last."""
    return clean(spark, d)


def _skew_case(c: str) -> str:
    return (f"CASE WHEN (SELECT CASE WHEN count({c}) >= 3 THEN skewness({c}) END FROM clean) > 1 "
            f"THEN ln(1 + {c}) ELSE {c} END")


LOGGED = "logged AS (SELECT " + ", ".join(f"{_skew_case(c)} AS {c}" for c in NUMERIC_RAW) + " FROM clean)"


@register("log1p_skewed", rounded(with_(CLEAN,
    "sk AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN count({c}) >= 3 THEN skewness({c}) END AS skew FROM clean"
        for c in NUMERIC_RAW) + ")") +
    "SELECT app_id, feature, ln(1 + CASE feature " +
    " ".join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in NUMERIC_RAW) +
    " END) AS value FROM clean, sk WHERE sk.skew > 1", ["value"]))
def log1p_skewed(spark, d):
    """B13 + C6: columns with sample skew > 1 get log(1+x); long (app_id, feature, value)."""
    df = clean(spark, d)
    names = P.skewed_columns(df, NUMERIC_RAW)          # k names reach the driver
    if not names:
        return spark.createDataFrame([], "app_id bigint, feature string, value double")
    logged = log1p_columns(df.select("app_id", *names), names)
    return logged.select("app_id", *[F.col(c).cast("double") for c in names]).unpivot(
        ["app_id"], names, "feature", "value")


@register("iqr_outliers_log", rounded(with_(CLEAN, LOGGED) + iqr_sql("logged", NUMERIC_RAW), IQR_DOUBLES))
def iqr_outliers_log(spark, d):
    """C6 then B10 again: the IQR profile after the log transform."""
    df = clean(spark, d)
    names = P.skewed_columns(df, NUMERIC_RAW)
    return P.iqr_outliers(log1p_columns(df, names), NUMERIC_RAW)
