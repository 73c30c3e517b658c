"""Registered validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import rules as R
from loanlens.operators.features import serving_view
from loanlens.plans.base import apps
from loanlens.plans.registry import register
from loanlens.plans.sql_common import with_

SERVE_VIEW = """sv AS (
 SELECT app_id, person_age, person_income, person_home_ownership, person_emp_length, loan_intent, loan_grade,
   loan_amnt, loan_int_rate/100e0 AS loan_int_rate, loan_percent_income,
   CAST(CASE WHEN cb_person_default_on_file = 'Y' THEN 1 WHEN cb_person_default_on_file = 'N' THEN 0 END AS INT)
     AS cb_person_default_on_file,
   cb_person_cred_hist_length, loan_status
 FROM applications
)"""


def _sql_list(v) -> str:
    return ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v)


def rules_sql(profile: str) -> str:
    """The same rules as SQL CASE expressions, in the same order."""
    parts = []
    for c, dom in R.DOMAINS.items():
        bad = f"NOT coalesce({c} IN ({_sql_list(dom)}), false)"
        if profile == "api":
            parts.append(f"CASE WHEN {c} IS NULL THEN 'missing:{c}' WHEN {bad} THEN '{c}:domain' END")
        else:
            parts.append(f"CASE WHEN {bad} THEN '{c}:domain' END")
    ranges = dict(R.RANGES)
    if profile == "api":
        ranges.update(R.API_RANGES)
    for c, (lo, hi) in ranges.items():
        conds = ([f"{c} < {lo}"] if lo is not None else []) + ([f"{c} > {hi}"] if hi is not None else [])
        parts.append(f"CASE WHEN {c} IS NULL THEN 'missing:{c}' WHEN {' OR '.join(conds)} THEN '{c}:range' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def _checked(profile: str) -> str:
    return f"chk AS (SELECT app_id, {rules_sql(profile)} AS v FROM sv)"


def _serve(spark, d):
    return serving_view(apps(spark, d))


@register("validate_rows", with_(SERVE_VIEW, _checked("serve")) +
          "SELECT app_id, CAST(len(v) AS INT) AS n_violations, array_to_string(v, ';') AS violation_list FROM chk")
def validate_rows(spark, d):
    """D1-D10 on every application (serving units): key, count, rule ids."""
    v = R.with_violations(_serve(spark, d))
    return v.select("app_id", F.size("violations").alias("n_violations"),
                    F.array_join("violations", ";").alias("violation_list"))


@register("violations_by_rule", with_(SERVE_VIEW, _checked("serve")) +
          "SELECT rule, count(*) AS n FROM (SELECT unnest(v) AS rule FROM chk) GROUP BY rule")
def violations_by_rule(spark, d):
    return R.violation_counts(_serve(spark, d))


@register("quarantine_split", with_(SERVE_VIEW, _checked("serve")) +
          "SELECT count(*) FILTER (WHERE len(v) = 0) AS n_valid, count(*) FILTER (WHERE len(v) > 0) AS n_quarantine FROM chk")
def quarantine_split(spark, d):
    # one pass: count both sides from the flagged frame
    v = R.with_violations(_serve(spark, d))
    return v.agg(F.count_if(F.size("violations") == 0).alias("n_valid"),
                  F.count_if(F.size("violations") > 0).alias("n_quarantine"))


@register("validate_api_profile", with_(SERVE_VIEW, _checked("api")) +
          "SELECT rule, count(*) AS n FROM (SELECT unnest(v) AS rule FROM chk) GROUP BY rule")
def validate_api_profile(spark, d):
    """Request-schema limits (rate <= 1, history >= 0, all required)."""
    return R.violation_counts(_serve(spark, d), profile="api")


@register("first_bad_record", with_(SERVE_VIEW, _checked("serve")) +
          "SELECT app_id, array_to_string(v, ';') AS violation_list FROM chk WHERE len(v) > 0 ORDER BY app_id LIMIT 1")
def first_bad_record(spark, d):
    """The batch error names the first failing record."""
    return R.first_bad_record(_serve(spark, d))
