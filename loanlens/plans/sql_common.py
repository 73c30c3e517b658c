"""SQL text shared by the oracles: the applications chain plus the cleaned
and derived views, written once so every oracle starts from the same rows."""

from __future__ import annotations

from loanlens.sources.tables import applications_sql

APPS = applications_sql("orders", "customer")

CLEAN = """clean0 AS (
 SELECT * FROM applications WHERE person_age < 100 AND person_emp_length <= 60
), clean AS (
 SELECT app_id, app_ts, person_age, person_income, person_home_ownership,
   coalesce(person_emp_length, 0e0) AS person_emp_length, loan_intent, loan_grade, loan_amnt,
   coalesce(loan_int_rate, (SELECT quantile_cont(loan_int_rate, 0.5) FROM clean0)) AS loan_int_rate,
   loan_percent_income, cb_person_default_on_file, cb_person_cred_hist_length, loan_status
 FROM clean0
)"""

FEAT = """feat AS (
 SELECT *, loan_amnt / nullif(person_income, 0) AS loan_to_income,
   person_emp_length / nullif(person_age, 0) AS employ_to_age,
   CASE WHEN person_age > 18 AND person_age <= 25 THEN '18-24' WHEN person_age > 25 AND person_age <= 35 THEN '25-34'
        WHEN person_age > 35 AND person_age <= 45 THEN '35-44' WHEN person_age > 45 AND person_age <= 55 THEN '45-54'
        WHEN person_age > 55 AND person_age <= 65 THEN '55-64' WHEN person_age > 65 AND person_age <= 120 THEN '65+' END AS age_bucket,
   CASE WHEN coalesce(person_emp_length, 0e0) > -1 AND coalesce(person_emp_length, 0e0) <= 0 THEN '0'
        WHEN coalesce(person_emp_length, 0e0) > 0 AND coalesce(person_emp_length, 0e0) <= 1 THEN '1'
        WHEN coalesce(person_emp_length, 0e0) > 1 AND coalesce(person_emp_length, 0e0) <= 3 THEN '2-3'
        WHEN coalesce(person_emp_length, 0e0) > 3 AND coalesce(person_emp_length, 0e0) <= 5 THEN '4-5'
        WHEN coalesce(person_emp_length, 0e0) > 5 AND coalesce(person_emp_length, 0e0) <= 10 THEN '6-10'
        WHEN coalesce(person_emp_length, 0e0) > 10 AND coalesce(person_emp_length, 0e0) <= 100 THEN '10+' END AS emp_length_bin,
   CAST(coalesce(CASE WHEN cb_person_default_on_file = 'Y' THEN 1 WHEN cb_person_default_on_file = 'N' THEN 0 END, 0) AS INT) AS default_flag
 FROM clean
)"""

# Deterministic score used by evaluation queries (no fitted model needed).
PSEUDO = """scored AS (
 SELECT app_id, loan_status AS label,
   ((app_id*7907) % 1000)/2000e0 + loan_status*0.25e0 AS score
 FROM clean
)"""


def with_(*ctes: str) -> str:
    """``WITH applications-chain, <ctes...>`` prefix for an oracle."""
    return "WITH " + ",\n".join((APPS,) + ctes) + "\n"
