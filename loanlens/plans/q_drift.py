"""Registered drift and decision queries.

Reference side: applications dated before 2000-01-01; current side: the
rest. Both are the cleaned, derived feature table without key and time.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loanlens.operators import drift as D
from loanlens.operators.score import batch_summary as _batch_summary
from loanlens.operators.score import decision_columns as _decisions
from loanlens.plans.base import feat, scored
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, FEAT, PSEUDO, with_
from loanlens.sources.tables import TARGET

CUTOFF = "2000-01-01 00:00:00"
NUM = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_int_rate", "loan_percent_income",
       "cb_person_cred_hist_length", "loan_to_income", "employ_to_age", "default_flag"]
TXT = ["person_home_ownership", "loan_intent", "loan_grade", "cb_person_default_on_file", "age_bucket",
       "emp_length_bin"]


def sides(spark, d):
    f = feat(spark, d)
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    ref = f.where(F.col("app_ts") < cut).drop("app_id", "app_ts")
    cur = f.where(F.col("app_ts") >= cut).drop("app_id", "app_ts")
    return ref, cur


SIDES = (CLEAN, FEAT,
         "ref AS (SELECT * EXCLUDE (app_id, app_ts) FROM feat WHERE app_ts < TIMESTAMP '2000-01-01')",
         "cur AS (SELECT * EXCLUDE (app_id, app_ts) FROM feat WHERE app_ts >= TIMESTAMP '2000-01-01')",
         "st AS (SELECT 'reference' AS side, * FROM ref UNION ALL SELECT 'current' AS side, * FROM cur)")


def _u(parts):
    return " UNION ALL ".join(parts)


@register("resolve_target", with_(*SIDES) +
          "SELECT 'loan_status' AS target, (SELECT count(loan_status) FROM ref) AS reference_rows, "
          "(SELECT count(loan_status) FROM cur) AS current_rows")
def resolve_target(spark, d):
    """The target found in both tables, with its non-null count per side."""
    ref, cur = sides(spark, d)
    t = D.resolve_target(ref, cur, "loan_status")
    return ref.agg(F.count(t).alias("reference_rows")).crossJoin(F.broadcast(cur.agg(F.count(t).alias("current_rows")))) \
              .select(F.lit(t).alias("target"), "reference_rows", "current_rows")


@register("drift_overview", with_(*SIDES) +
          "SELECT (SELECT count(*) FROM ref) AS reference_rows, (SELECT count(*) FROM cur) AS current_rows")
def drift_overview(spark, d):
    return D.drift_overview(*sides(spark, d))


@register("target_drift", rounded(with_(*SIDES,
          "rr AS (SELECT avg(CAST(loan_status AS INT)) AS reference_rate, count(*) FILTER (WHERE CAST(loan_status AS INT) NOT IN (0, 1)) AS rb FROM ref)",
          "cr AS (SELECT avg(CAST(loan_status AS INT)) AS current_rate, count(*) FILTER (WHERE CAST(loan_status AS INT) NOT IN (0, 1)) AS cb FROM cur)") +
          "SELECT reference_rate, current_rate, abs(current_rate - reference_rate) AS rate_change, rb + cb AS n_non_binary FROM rr, cr",
          ["reference_rate", "current_rate", "rate_change"]))
def target_drift(spark, d):
    """Target rate per side and absolute change."""
    ref, cur = sides(spark, d)
    return D.target_drift(ref, cur, TARGET)


MEAN_SQL = _u([f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE side = 'reference') AS reference_mean, "
               f"avg({c}) FILTER (WHERE side = 'current') AS current_mean FROM st" for c in NUM])


@register("mean_shift", rounded(with_(*SIDES) +
          f"SELECT *, abs(current_mean - reference_mean) AS mean_shift FROM ({MEAN_SQL})",
          ["reference_mean", "current_mean", "mean_shift"]))
def mean_shift(spark, d):
    """Absolute shift of means, every numeric column in one pass."""
    ref, cur = sides(spark, d)
    return D.mean_shift(ref, cur, NUM)


TOP = ("tc AS (SELECT side, feature, value, n, row_number() OVER (PARTITION BY side, feature ORDER BY n DESC, value) AS rank "
       "FROM (SELECT side, feature, value, count(*) AS n FROM (" +
       _u([f"SELECT side, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM st" for c in TXT]) +
       ") GROUP BY side, feature, value))")


@register("top_categories_drift", with_(*SIDES, TOP) +
          "SELECT side, feature, value, n, CAST(rank AS INT) AS rank FROM tc WHERE rank <= 3")
def top_categories_drift(spark, d):
    """Top 3 values per side and text column."""
    ref, cur = sides(spark, d)
    return D.top_categories(ref, cur, TXT)


@register("drift_summary", rounded(with_(*SIDES, TOP) +
          f"SELECT feature, 'numeric' AS kind, reference_mean, current_mean, abs(current_mean - reference_mean) AS mean_shift, "
          f"CAST(NULL AS VARCHAR) AS reference_top, CAST(NULL AS VARCHAR) AS current_top FROM ({MEAN_SQL}) UNION ALL "
          "SELECT feature, 'categorical', NULL, NULL, NULL, "
          "string_agg(CASE WHEN side = 'reference' THEN value || ':' || n END, ';' ORDER BY rank), "
          "string_agg(CASE WHEN side = 'current' THEN value || ':' || n END, ';' ORDER BY rank) "
          "FROM tc WHERE rank <= 3 GROUP BY feature", ["reference_mean", "current_mean", "mean_shift"]))
def drift_summary(spark, d):
    """One row per shared column (numeric mean shift or top-3 text per side)."""
    ref, cur = sides(spark, d)
    return D.drift_summary(ref, cur, TARGET)


NUM_LONG = ("nl AS (" + _u([f"SELECT side, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM st WHERE {c} IS NOT NULL"
                             for c in NUM]) + ")")
ECDF = ("hv AS (SELECT feature, value, count(*) FILTER (WHERE side = 'reference') AS n_ref, "
        "count(*) FILTER (WHERE side = 'current') AS n_cur FROM nl GROUP BY feature, value)",
        "ec AS (SELECT feature, value, sum(n_ref) OVER w / sum(n_ref) OVER (PARTITION BY feature) AS F_ref, "
        "sum(n_cur) OVER w / sum(n_cur) OVER (PARTITION BY feature) AS F_cur, sum(n_ref) OVER (PARTITION BY feature) AS tot_ref, "
        "sum(n_cur) OVER (PARTITION BY feature) AS tot_cur, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nx "
        "FROM hv WINDOW w AS (PARTITION BY feature ORDER BY value))")


def _ks_p_sql(d: str, n: str, m: str) -> str:
    lam = f"(sqrt({n}*{m}/({n}+{m}))*{d})"
    small = " + ".join(f"exp({-((2 * k - 1) ** 2) * math.pi ** 2 / 8.0!r} / ({lam}*{lam}))" for k in range(1, 7))
    large = " + ".join(f"{2.0 * (-1) ** (k - 1)!r}*exp({-2.0 * k * k!r}*{lam}*{lam})" for k in range(1, 9))
    q = f"CASE WHEN {lam} < 1e0 THEN 1e0 - {math.sqrt(2 * math.pi)!r} / {lam} * ({small}) ELSE {large} END"
    return f"CASE WHEN {lam} < 0.05e0 THEN 1e0 ELSE least(greatest({q}, 0e0), 1e0) END"


@register("ks_drift", rounded(with_(*SIDES, NUM_LONG, *ECDF,
          "ks AS (SELECT feature, max(abs(F_ref - F_cur)) AS ks_stat, CAST(max(tot_ref) AS BIGINT) AS n_ref, "
          "CAST(max(tot_cur) AS BIGINT) AS n_cur FROM ec GROUP BY feature)",
          f"kp AS (SELECT *, {_ks_p_sql('ks_stat', 'CAST(n_ref AS DOUBLE)', 'CAST(n_cur AS DOUBLE)')} AS p_value FROM ks)") +
          "SELECT *, CASE WHEN p_value < 0.05e0 THEN 1 ELSE 0 END AS drifted FROM kp", ["ks_stat", "p_value"]))
def ks_drift(spark, d):
    """Two-sample Kolmogorov-Smirnov per numeric column."""
    ref, cur = sides(spark, d)
    return D.ks_drift(ref, cur, NUM)


@register("wasserstein_drift", rounded(with_(*SIDES, NUM_LONG, *ECDF) +
          "SELECT feature, coalesce(sum(abs(F_ref - F_cur) * (nx - value)), 0e0) AS wasserstein FROM ec GROUP BY feature",
          ["wasserstein"]))
def wasserstein_drift(spark, d):
    """Wasserstein-1 distance per numeric column."""
    ref, cur = sides(spark, d)
    return D.wasserstein_drift(ref, cur, NUM)


def _psi_ctes(cnt: str) -> tuple[str, str]:
    return (f"pt AS (SELECT feature, sum(n_ref) AS tot_ref, sum(n_cur) AS tot_cur FROM {cnt} GROUP BY feature)",
            f"pv AS (SELECT {cnt}.feature, greatest(n_ref / CAST(tot_ref AS DOUBLE), 1e-4) AS pr, "
            f"greatest(n_cur / CAST(tot_cur AS DOUBLE), 1e-4) AS pc FROM {cnt} JOIN pt ON {cnt}.feature = pt.feature)")


PSI_SELECT = ("SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi, "
              "CASE WHEN sum((pc - pr) * ln(pc / pr)) > 0.2e0 THEN 1 ELSE 0 END AS drifted FROM pv GROUP BY feature")

EDGES = ("edges AS (" + _u([f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) "
                            f"AS e FROM ref" for c in NUM]) + ")")


@register("psi_drift", rounded(with_(*SIDES, NUM_LONG, EDGES,
          "pb AS (SELECT nl.feature, len(list_filter(e, lambda x: nl.value > x)) AS bin, "
          "count(*) FILTER (WHERE side = 'reference') AS n_ref, count(*) FILTER (WHERE side = 'current') AS n_cur "
          "FROM nl JOIN edges ON nl.feature = edges.feature GROUP BY 1, 2)", *_psi_ctes("pb")) + PSI_SELECT, ["psi"]))
def psi_drift(spark, d):
    """Population stability index on reference deciles."""
    ref, cur = sides(spark, d)
    return D.psi_drift(ref, cur, NUM)


@register("target_psi", rounded(with_(*SIDES,
          "pb AS (SELECT 'loan_status' AS feature, CAST(loan_status AS VARCHAR) AS bin, count(*) FILTER (WHERE side = 'reference') AS n_ref, "
          "count(*) FILTER (WHERE side = 'current') AS n_cur FROM st GROUP BY 1, 2)", *_psi_ctes("pb")) + PSI_SELECT, ["psi"]))
def target_psi(spark, d):
    """PSI of the target class shares."""
    ref, cur = sides(spark, d)
    return D.target_psi(ref, cur, TARGET)


CAT_CNT = ("cc AS (SELECT feature, value, count(*) FILTER (WHERE side = 'reference') AS n_ref, "
           "count(*) FILTER (WHERE side = 'current') AS n_cur FROM (" +
           _u([f"SELECT side, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM st" for c in TXT]) +
           ") GROUP BY feature, value)",
           "ct AS (SELECT cc.*, sum(n_ref) OVER (PARTITION BY feature) AS tot_ref, sum(n_cur) OVER (PARTITION BY feature) AS tot_cur FROM cc)")


@register("js_drift", rounded(with_(*SIDES, *CAT_CNT,
          "jp AS (SELECT feature, n_ref / CAST(tot_ref AS DOUBLE) AS p, n_cur / CAST(tot_cur AS DOUBLE) AS q FROM ct)") +
          "SELECT feature, sqrt(greatest(sum(0.5e0 * CASE WHEN p > 0 THEN p * ln(p / ((p + q)/2e0)) ELSE 0e0 END "
          "+ 0.5e0 * CASE WHEN q > 0 THEN q * ln(q / ((p + q)/2e0)) ELSE 0e0 END), 0e0)) AS js_distance, "
          "CASE WHEN sqrt(greatest(sum(0.5e0 * CASE WHEN p > 0 THEN p * ln(p / ((p + q)/2e0)) ELSE 0e0 END "
          "+ 0.5e0 * CASE WHEN q > 0 THEN q * ln(q / ((p + q)/2e0)) ELSE 0e0 END), 0e0)) > 0.1e0 THEN 1 ELSE 0 END AS drifted "
          "FROM jp GROUP BY feature", ["js_distance"]))
def js_drift(spark, d):
    """Jensen-Shannon distance per text column."""
    ref, cur = sides(spark, d)
    return D.js_drift(ref, cur, TXT)


@register("chi2_drift", rounded(with_(*SIDES, *CAT_CNT) +
          "SELECT feature, sum(power(n_ref - tot_ref*(n_ref + n_cur)/CAST(tot_ref + tot_cur AS DOUBLE), 2) / (tot_ref*(n_ref + n_cur)/CAST(tot_ref + tot_cur AS DOUBLE)) "
          "+ power(n_cur - tot_cur*(n_ref + n_cur)/CAST(tot_ref + tot_cur AS DOUBLE), 2) / (tot_cur*(n_ref + n_cur)/CAST(tot_ref + tot_cur AS DOUBLE))) AS chi2, "
          "count(*) - 1 AS dof FROM ct GROUP BY feature", ["chi2"]))
def chi2_drift(spark, d):
    """Chi-square homogeneity statistic per text column."""
    ref, cur = sides(spark, d)
    return D.chi2_drift(ref, cur, TXT)


_SCORED_SIDES = ("qs AS (SELECT CASE WHEN a.app_ts < TIMESTAMP '2000-01-01' THEN 'reference' ELSE 'current' END AS side, "
                 "s.label, s.score FROM scored s JOIN clean a ON s.app_id = a.app_id)")


@register("quality_by_side", rounded(with_(CLEAN, PSEUDO, _SCORED_SIDES,
          "cm AS (SELECT side, count(*) FILTER (WHERE score >= 0.5e0 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.5e0 AND label <> 1) AS fp, "
          "count(*) FILTER (WHERE score < 0.5e0 AND label <> 1) AS tn, count(*) FILTER (WHERE score < 0.5e0 AND label = 1) AS fn FROM qs GROUP BY side)",
          "hh AS (SELECT side, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM qs GROUP BY side, score)",
          "cu AS (SELECT *, sum(pos) OVER (PARTITION BY side ORDER BY score DESC) AS tp_c FROM hh)",
          "au AS (SELECT side, sum(neg * (tp_c - pos/2e0)) / (sum(neg) * CAST(sum(pos) AS DOUBLE)) AS roc_auc FROM cu GROUP BY side)") +
          "SELECT cm.*, coalesce((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 0e0) AS accuracy, "
          "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0e0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0) AS recall, "
          "coalesce(2*tp / nullif(CAST(2*tp + fp + fn AS DOUBLE), 0), 0e0) AS f1, roc_auc FROM cm JOIN au ON cm.side = au.side",
          ["accuracy", "precision", "recall", "f1", "roc_auc"]))
def quality_by_side(spark, d):
    """Classification quality per side (pseudo score, threshold 0.5); the
    side comes from the same row, so no join is needed."""
    from loanlens.plans.base import clean, pseudo_score
    s = pseudo_score(clean(spark, d), keep=("app_ts",))
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    return D.quality_by_side(s.where(F.col("app_ts") < cut), s.where(F.col("app_ts") >= cut),
                             "label", "score", 0.5)


@register("decision_columns", rounded(with_(CLEAN, PSEUDO) +
          "SELECT app_id, score AS probability_default, CASE WHEN score >= 0.55e0 THEN 1 ELSE 0 END AS prediction, "
          "1e0 - score AS probability_non_default, CASE WHEN score >= 0.55e0 THEN 'high_risk' ELSE 'low_risk' END AS risk_level, "
          "0.55e0 AS threshold_used, CASE WHEN score >= 0.55e0 THEN 'Reject application' ELSE 'Approve application' END AS recommendation "
          "FROM scored", ["probability_default", "probability_non_default", "threshold_used"]))
def decision_columns(spark, d):
    """Decision columns at threshold 0.55 on the pseudo score."""
    s = scored(spark, d).select("app_id", F.col("score").alias("probability_default"))
    return _decisions(s, "probability_default", 0.55)


@register("batch_summary", rounded(with_(CLEAN, PSEUDO) +
          "SELECT 1 AS success, count(*) AS n_predictions, count(*) FILTER (WHERE score >= 0.55e0) AS n_reject, "
          "count(*) FILTER (WHERE score < 0.55e0) AS n_approve, avg(score) AS mean_probability_default FROM scored",
          ["mean_probability_default"]))
def batch_summary(spark, d):
    """Reply summary of the scored batch."""
    s = scored(spark, d).select("app_id", F.col("score").alias("probability_default"))
    return _batch_summary(_decisions(s, "probability_default", 0.55))


@register("dataset_drift", rounded(with_(*SIDES, NUM_LONG, *ECDF, *CAT_CNT,
          "ks AS (SELECT feature, max(abs(F_ref - F_cur)) AS ks_stat, CAST(max(tot_ref) AS DOUBLE) AS n, "
          "CAST(max(tot_cur) AS DOUBLE) AS m FROM ec GROUP BY feature)",
          f"kd AS (SELECT feature, CASE WHEN {_ks_p_sql('ks_stat', 'n', 'm')} < 0.05e0 THEN 1 ELSE 0 END AS drifted FROM ks)",
          "jp AS (SELECT feature, n_ref / CAST(tot_ref AS DOUBLE) AS p, n_cur / CAST(tot_cur AS DOUBLE) AS q FROM ct)",
          "jd AS (SELECT feature, CASE WHEN sqrt(greatest(sum(0.5e0 * CASE WHEN p > 0 THEN p * ln(p / ((p + q)/2e0)) ELSE 0e0 END "
          "+ 0.5e0 * CASE WHEN q > 0 THEN q * ln(q / ((p + q)/2e0)) ELSE 0e0 END), 0e0)) > 0.1e0 THEN 1 ELSE 0 END AS drifted "
          "FROM jp GROUP BY feature)",
          "al AS (SELECT drifted FROM kd UNION ALL SELECT drifted FROM jd)") +
          "SELECT count(*) AS n_columns, CAST(sum(drifted) AS BIGINT) AS n_drifted, sum(drifted) / CAST(count(*) AS DOUBLE) "
          "AS share_drifted FROM al", ["share_drifted"]))
def dataset_drift(spark, d):
    """Share of drifted columns (KS p < 0.05 for numeric, JS > 0.1 for text)."""
    ref, cur = sides(spark, d)
    per = D.ks_drift(ref, cur, NUM).select("feature", "drifted").unionByName(
        D.js_drift(ref, cur, TXT).select("feature", "drifted"))
    return D.drift_share(per)
