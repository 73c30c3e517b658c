"""Registered profiling queries with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import profile as P
from loanlens.plans.base import NUMERIC_RAW, TEXT_RAW, apps, clean, feat, filtered
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, FEAT, with_
from loanlens.sources.tables import TARGET

APP_DOUBLES = ["person_income", "person_emp_length", "loan_amnt", "loan_int_rate",
               "loan_percent_income"]
APP_COLS = ["app_id", "app_ts", "person_age", "person_income", "person_home_ownership",
            "person_emp_length", "loan_intent", "loan_grade", "loan_amnt", "loan_int_rate",
            "loan_percent_income", "cb_person_default_on_file", "cb_person_cred_hist_length",
            "loan_status"]
APP_TYPES = ["bigint", "timestamp_ntz", "int", "double", "string", "double", "string", "string",
             "double", "double", "double", "string", "int", "int"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- sources

@register("scan_applications", rounded(with_() + "SELECT * FROM applications", APP_DOUBLES))
def scan_applications(spark, d):
    """A1: the applications table, all rows and columns."""
    return apps(spark, d)


@register("head_applications", rounded(
    with_() + "SELECT * FROM applications ORDER BY app_id LIMIT 5", APP_DOUBLES))
def head_applications(spark, d):
    """First five rows in key order (top-k, not a global sort)."""
    return apps(spark, d).orderBy("app_id").limit(5)


# ---------------------------------------------------------------- shape/info

@register("profile_shape", with_() + f"SELECT count(*) AS n_rows, {len(APP_COLS)} AS n_cols FROM applications")
def profile_shape(spark, d):
    return P.profile_shape(apps(spark, d))


_INFO_VALUES = ", ".join(f"('{c}', {i}, '{t}')" for i, (c, t) in enumerate(zip(APP_COLS, APP_TYPES)))


@register("profile_info", with_() + "SELECT m.column_name AS \"column\", m.position, u.non_null, m.dtype FROM (" +
          _union([f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM applications" for c in APP_COLS]) +
          f") u JOIN (VALUES {_INFO_VALUES}) m(column_name, position, dtype) ON u.column_name = m.column_name")
def profile_info(spark, d):
    return P.profile_info(apps(spark, d))


# ---------------------------------------------------------------- describe

_DESC_COLS = NUMERIC_RAW + [TARGET]


@register("describe_numeric", rounded(with_() + _union([
    f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
    f"quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM applications"
    for c in _DESC_COLS]), ["mean", "std", "min", "q25", "q50", "q75", "max"]))
def describe_numeric(spark, d):
    return P.describe_numeric(apps(spark, d), _DESC_COLS)


@register("describe_categorical", with_(
    "lng AS (" + _union([f"SELECT '{c}' AS feature, {c} AS value FROM applications" for c in TEXT_RAW]) + ")",
    "cnt AS (SELECT feature, value, count(*) AS n FROM lng WHERE value IS NOT NULL GROUP BY feature, value)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS r FROM cnt)") +
    "SELECT feature, CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", max(CASE WHEN r = 1 THEN value END) AS top, "
    "max(CASE WHEN r = 1 THEN n END) AS freq FROM rk GROUP BY feature")
def describe_categorical(spark, d):
    return P.describe_categorical(apps(spark, d), TEXT_RAW)


# ---------------------------------------------------------------- nulls, rates

@register("null_report", rounded(with_(
    "f AS (SELECT * FROM applications WHERE person_age < 100 AND person_emp_length <= 60)",
    "u AS (" + _union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) AS n FROM f"
                       for c in APP_COLS]) + ")") +
    "SELECT \"column\", null_count, null_count*100e0/n AS null_pct FROM u WHERE null_count > 0", ["null_pct"]))
def null_report(spark, d):
    """B5 on the filtered rows before the fills (as the reference does)."""
    return P.null_report(filtered(spark, d))


@register("default_rate", rounded(with_(CLEAN) +
          "SELECT avg(loan_status)*100e0 AS default_rate_pct, count(*) AS n_rows FROM clean",
          ["default_rate_pct"]))
def default_rate(spark, d):
    return P.default_rate(clean(spark, d))


@register("class_balance", rounded(with_(CLEAN, "g AS (SELECT loan_status, count(*) AS n FROM clean GROUP BY loan_status)") +
          "SELECT loan_status, n, floor(n*100e0/(SELECT sum(n) FROM g)*100e0 + 0.5)/100e0 AS pct FROM g", ["pct"]))
def class_balance(spark, d):
    return P.class_balance(clean(spark, d))


def _rate_sql(x: str, src: str = "clean", ctes: tuple = (CLEAN,)) -> str:
    return rounded(with_(*ctes, f"g AS (SELECT {x}, loan_status, count(*) AS n FROM {src} GROUP BY {x}, loan_status)") +
                   f"SELECT {x}, loan_status, n, n*100e0/sum(n) OVER (PARTITION BY {x}) AS pct_within FROM g",
                   ["pct_within"])


@register("rate_by_home", _rate_sql("person_home_ownership"))
def rate_by_home(spark, d):
    return P.rate_by(clean(spark, d), "person_home_ownership")


@register("rate_by_intent", _rate_sql("loan_intent"))
def rate_by_intent(spark, d):
    return P.rate_by(clean(spark, d), "loan_intent")


@register("rate_by_grade", _rate_sql("loan_grade"))
def rate_by_grade(spark, d):
    return P.rate_by(clean(spark, d), "loan_grade")


@register("rate_by_default_flag", _rate_sql("default_flag", "feat", (CLEAN, FEAT)))
def rate_by_default_flag(spark, d):
    return P.rate_by(feat(spark, d), "default_flag")


@register("grade_summary", rounded(with_(CLEAN, FEAT) +
          "SELECT loan_grade, count(*) AS n, avg(loan_status)*100e0 AS default_rate_pct, "
          "avg(loan_to_income) AS mean_loan_to_income FROM feat GROUP BY loan_grade",
          ["default_rate_pct", "mean_loan_to_income"]))
def grade_summary(spark, d):
    """Flagship: default rate and mean loan_to_income per grade (clean -> derive -> aggregate)."""
    return feat(spark, d).groupBy("loan_grade").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(TARGET) * 100.0).alias("default_rate_pct"),
        F.avg("loan_to_income").alias("mean_loan_to_income"))


# ---------------------------------------------------------------- correlation

_CORR_COLS = NUMERIC_RAW + [TARGET]


def _corr_sql(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    xa, xb = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return f"covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0)"


@register("corr_matrix", rounded(with_(CLEAN) + _union([
    f"SELECT '{_CORR_COLS[i]}' AS a, '{_CORR_COLS[j]}' AS b, {i} AS i, {j} AS j, {_corr_sql(_CORR_COLS[i], _CORR_COLS[j])} AS r FROM clean"
    for i in range(len(_CORR_COLS)) for j in range(i + 1, len(_CORR_COLS))]), ["r"]))
def corr_matrix(spark, d):
    return P.corr_matrix(clean(spark, d), _CORR_COLS)


@register("corr_with_target", rounded(with_(CLEAN) + _union([
    f"SELECT '{c}' AS feature, {_corr_sql(c, TARGET)} AS r FROM clean" for c in NUMERIC_RAW]), ["r"]))
def corr_with_target(spark, d):
    return P.corr_with_target(clean(spark, d), NUMERIC_RAW)


# ---------------------------------------------------------------- IQR / skew

def iqr_sql(src: str, cols: list[str]) -> str:
    return _union([
        f"SELECT '{c}' AS feature, q1, q3, q3 - q1 AS iqr, q1 - 1.5e0*(q3 - q1) AS lower, q3 + 1.5e0*(q3 - q1) AS upper, "
        f"(SELECT count(*) FROM {src} WHERE {c} < s.q1 - 1.5e0*(s.q3 - s.q1) OR {c} > s.q3 + 1.5e0*(s.q3 - s.q1)) AS outlier_count, "
        f"skew, (SELECT count(*) FROM {src} WHERE {c} < s.q1 - 1.5e0*(s.q3 - s.q1) OR {c} > s.q3 + 1.5e0*(s.q3 - s.q1))*100e0/n AS outlier_pct "
        f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
        f"CASE WHEN count({c}) >= 3 THEN skewness({c}) END AS skew, count(*) AS n FROM {src}) s"
        for c in cols])


IQR_DOUBLES = ["q1", "q3", "iqr", "lower", "upper", "skew", "outlier_pct"]


@register("iqr_outliers", rounded(with_(CLEAN) + iqr_sql("clean", NUMERIC_RAW), IQR_DOUBLES))
def iqr_outliers(spark, d):
    """B10 on the cleaned table, every numeric feature in two passes."""
    return P.iqr_outliers(clean(spark, d), NUMERIC_RAW)


@register("skewness_profile", rounded(with_(CLEAN) + _union([
    f"SELECT '{c}' AS feature, count({c}) AS n, CASE WHEN count({c}) >= 3 THEN skewness({c}) END AS skew FROM clean"
    for c in NUMERIC_RAW]), ["skew"]))
def skewness_profile(spark, d):
    return P.skewness_profile(clean(spark, d), NUMERIC_RAW)


@register("top_outlier_features", rounded(with_(CLEAN) + "SELECT * FROM (" + iqr_sql("clean", NUMERIC_RAW) +
          ") ORDER BY outlier_pct DESC, skew DESC, feature LIMIT 20", IQR_DOUBLES))
def top_outlier_features(spark, d):
    return P.top_outlier_features(P.iqr_outliers(clean(spark, d), NUMERIC_RAW), 20)


# ---------------------------------------------------------------- box / hist / kde

def _box_sql(c: str) -> str:
    return (f"SELECT '{c}' AS feature, bx.loan_status, q1, median, q3, lower, upper, "
            "CAST(min(CASE WHEN v >= lower AND v <= upper THEN v END) AS DOUBLE) AS whisker_low, "
            "CAST(max(CASE WHEN v >= lower AND v <= upper THEN v END) AS DOUBLE) AS whisker_high, "
            "count(CASE WHEN v IS NOT NULL AND NOT (v >= lower AND v <= upper) THEN 1 END) AS n_outliers, count(v) AS n "
            f"FROM (SELECT loan_status, {c} AS v FROM clean) cv JOIN (SELECT *, q1 - 1.5e0*(q3 - q1) AS lower, "
            f"q3 + 1.5e0*(q3 - q1) AS upper FROM (SELECT loan_status, quantile_cont({c}, 0.25) AS q1, "
            f"quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM clean GROUP BY loan_status)) bx "
            "ON cv.loan_status = bx.loan_status GROUP BY bx.loan_status, q1, median, q3, lower, upper")


_BOX_COLS = ["loan_int_rate", "loan_percent_income"]


@register("box_by_status", rounded(with_(CLEAN) + " UNION ALL ".join(_box_sql(c) for c in _BOX_COLS),
                                   ["q1", "median", "q3", "lower", "upper", "whisker_low", "whisker_high"]))
def box_by_status(spark, d):
    """Box summaries by loan status of the two columns most linked to the target."""
    df = clean(spark, d)
    parts = [P.box_summary(df, c, TARGET).withColumn("feature", F.lit(c)) for c in _BOX_COLS]
    return parts[0].unionByName(parts[1])


@register("histogram_income", rounded(with_(CLEAN,
    "r AS (SELECT CAST(min(person_income) AS DOUBLE) AS lo, CAST(max(person_income) AS DOUBLE) AS hi FROM clean)",
    "h AS (SELECT CAST(coalesce(least(floor((person_income - lo) / nullif((hi - lo)/30e0, 0)), 29), 0) AS INT) AS bin, lo, hi "
    "FROM clean, r WHERE person_income IS NOT NULL)") +
    "SELECT bin, lo + bin*((hi - lo)/30e0) AS bin_lo, lo + (bin + 1)*((hi - lo)/30e0) AS bin_hi, count(*) AS n "
    "FROM h GROUP BY bin, lo, hi", ["bin_lo", "bin_hi"]))
def histogram_income(spark, d):
    return P.histogram(clean(spark, d), "person_income", 30)


def _hist_sql(src: str, c: str, bins: int = 30) -> str:
    return (f"SELECT '{c}' AS feature, bin, lo + bin*((hi - lo)/{bins}e0) AS bin_lo, lo + (bin + 1)*((hi - lo)/{bins}e0) AS bin_hi, "
            f"count(*) AS n FROM (SELECT CAST(coalesce(least(floor((CAST({c} AS DOUBLE) - lo) / nullif((hi - lo)/{bins}e0, 0)), "
            f"{bins - 1}), 0) AS INT) AS bin, lo, hi FROM {src}, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi "
            f"FROM {src}) r WHERE {c} IS NOT NULL) GROUP BY bin, lo, hi")


@register("histogram_numeric", rounded(with_(CLEAN) + _union([_hist_sql("clean", c) for c in NUMERIC_RAW]),
                                       ["bin_lo", "bin_hi"]))
def histogram_numeric(spark, d):
    """B16 for every numeric column of the cleaned table, in one aggregation."""
    return P.histograms(clean(spark, d), NUMERIC_RAW, 30)


@register("kde_income", rounded(with_(CLEAN,
    "st AS (SELECT CAST(min(person_income) AS DOUBLE) AS lo, CAST(max(person_income) AS DOUBLE) AS hi, "
    "count(person_income) AS n, stddev_samp(person_income) * pow(CAST(count(person_income) AS DOUBLE), -0.2e0) AS bw, "
    "(max(person_income) - min(person_income)) / 1024e0 AS fw FROM clean)",
    "bn AS (SELECT coalesce(least(floor((person_income - lo) / nullif(fw, 0)), 1023), 0) AS fb, count(*) AS cnt "
    "FROM clean, st WHERE person_income IS NOT NULL GROUP BY 1)",
    "g AS (SELECT CAST(gi AS INT) AS gi, lo + (hi - lo) * gi / 199e0 AS x FROM range(200) t(gi), st)",
    "k AS (SELECT gi, x, sum(cnt * exp(-0.5e0 * ((x - (lo + (fb + 0.5e0)*fw))/bw) * ((x - (lo + (fb + 0.5e0)*fw))/bw))) "
    "/ (max(n) * max(bw) * sqrt(2e0*pi())) AS density, max(hi) - max(lo) AS rng FROM g, bn, st GROUP BY gi, x)") +
    "SELECT gi, x, density, density*rng AS scaled_density FROM k", ["x", "density", "scaled_density"]))
def kde_income(spark, d):
    return P.kde(clean(spark, d), "person_income", 200, 1024)


def _kde_sql(src: str, c: str) -> str:
    return (f"SELECT '{c}' AS feature, gi, x, density, density * rng AS scaled_density FROM ("
            f"SELECT gi, x, sum(cnt * exp(-0.5e0 * ((x - (lo + (fb + 0.5e0)*fw))/bw) * ((x - (lo + (fb + 0.5e0)*fw))/bw))) "
            f"/ (max(n) * max(bw) * sqrt(2e0*pi())) AS density, max(hi) - max(lo) AS rng FROM "
            f"(SELECT CAST(gi AS INT) AS gi, lo + (hi - lo) * gi / 199e0 AS x FROM range(200) t(gi), st_{c}) g, "
            f"(SELECT coalesce(least(floor((CAST({c} AS DOUBLE) - lo) / nullif(fw, 0)), 1023), 0) AS fb, count(*) AS cnt "
            f"FROM {src}, st_{c} WHERE {c} IS NOT NULL GROUP BY 1) bn, st_{c} GROUP BY gi, x)")


def _kde_stats(src: str, c: str) -> str:
    return (f"st_{c} AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, count({c}) AS n, "
            f"stddev_samp({c}) * pow(CAST(count({c}) AS DOUBLE), -0.2e0) AS bw, "
            f"(CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)) / 1024e0 AS fw FROM {src})")


@register("kde_numeric", rounded(with_(CLEAN, *[_kde_stats("clean", c) for c in NUMERIC_RAW]) +
                                 _union([_kde_sql("clean", c) for c in NUMERIC_RAW]),
                                 ["x", "density", "scaled_density"]))
def kde_numeric(spark, d):
    """B17 for every numeric column of the cleaned table (binned, Scott bandwidth)."""
    return P.kdes(clean(spark, d), NUMERIC_RAW)
