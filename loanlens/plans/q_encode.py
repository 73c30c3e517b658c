"""Registered encoder and feature-selection queries.

The encoder is fitted on all cleaned rows here, as the reference's feature
notebook does (``fit_on='all'``); the training plan fits on the training
split instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import encode as EN
from loanlens.operators.categories import CategoryDictionary, positions
from loanlens.plans.base import feat
from loanlens.plans.registry import register, rounded
from loanlens.plans.sql_common import CLEAN, FEAT, with_
from loanlens.sources.tables import TARGET

NUMERIC_ENC = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_int_rate",
               "loan_percent_income", "cb_person_cred_hist_length", "loan_to_income", "employ_to_age",
               "default_flag"]
CATEGORICAL_ENC = ["person_home_ownership", "loan_intent", "loan_grade", "cb_person_default_on_file",
                   "age_bucket", "emp_length_bin"]


def fitted(spark, d):
    df = feat(spark, d)
    return df, EN.FittedEncoder.fit(df, NUMERIC_ENC, CATEGORICAL_ENC)


def encoded(spark, d):
    df, enc = fitted(spark, d)
    return enc.transform(df, keep=("app_id", TARGET)), enc


# ------------------------------------------------------------------ SQL text

def _u(parts):
    return " UNION ALL ".join(parts)


_NUM_IDX = ", ".join(f"('{c}', {i})" for i, c in enumerate(NUMERIC_ENC))
_CAT_IDX = ", ".join(f"('{c}', {i})" for i, c in enumerate(CATEGORICAL_ENC))
ENC_CTES = (
    CLEAN, FEAT,
    "numl AS (" + _u([f"SELECT app_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM feat" for c in NUMERIC_ENC]) + ")",
    "med AS (SELECT feature, quantile_cont(x, 0.5) AS median FROM numl GROUP BY feature)",
    "imp AS (SELECT app_id, numl.feature, coalesce(x, median) AS x FROM numl JOIN med ON numl.feature = med.feature)",
    "sc AS (SELECT feature, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 OR stddev_pop(x) IS NULL THEN 1e0 "
    "ELSE stddev_pop(x) END AS std FROM imp GROUP BY feature)",
    f"nidx AS (SELECT * FROM (VALUES {_NUM_IDX}) t(feature, idx))",
    f"cidx AS (SELECT * FROM (VALUES {_CAT_IDX}) t(feature, idx))",
    "numenc AS (SELECT app_id, imp.feature, (x - mean)/std AS value, nidx.idx AS pos FROM imp "
    "JOIN sc ON imp.feature = sc.feature JOIN nidx ON imp.feature = nidx.feature)",
    "catl AS (" + _u([f"SELECT app_id, '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM feat" for c in CATEGORICAL_ENC]) + ")",
    "cc AS (SELECT feature, v, count(*) AS n FROM catl WHERE v IS NOT NULL GROUP BY feature, v)",
    "mo AS (SELECT feature, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v) AS r "
    "FROM cc) WHERE r = 1)",
    f"cpos AS (SELECT cc.feature, cc.v, {len(NUMERIC_ENC)} - 1 + row_number() OVER (ORDER BY cidx.idx, cc.v) AS pos "
    "FROM cc JOIN cidx ON cc.feature = cidx.feature)",
    "catenc AS (SELECT app_id, cpos.feature || '_' || cpos.v AS feature, "
    "CASE WHEN coalesce(catl.v, mo.mode) = cpos.v THEN 1e0 ELSE 0e0 END AS value, cpos.pos "
    "FROM catl JOIN mo ON catl.feature = mo.feature JOIN cpos ON cpos.feature = catl.feature)",
    "enc AS (SELECT * FROM numenc UNION ALL SELECT * FROM catenc)",
)
PAIRS = ("pairs AS (SELECT a.feature AS a, b.feature AS b, CAST(a.pos AS INT) AS i, CAST(b.pos AS INT) AS j, "
         "abs(corr(a.value, b.value)) AS abs_r FROM enc a JOIN enc b ON a.app_id = b.app_id AND a.pos < b.pos "
         "GROUP BY a.feature, b.feature, a.pos, b.pos)")
HIGH = "high AS (SELECT * FROM pairs WHERE NOT isnan(abs_r) AND abs_r > 0.85e0)"
VARS = "vars AS (SELECT feature, var_pop(value) AS variance FROM enc GROUP BY feature)"


# ------------------------------------------------------------------ queries

@register("impute_median", rounded(with_(*ENC_CTES) + "SELECT feature, median FROM med", ["median"]))
def impute_median(spark, d):
    """exact interpolated medians of the numeric columns."""
    _, enc = fitted(spark, d)
    return spark.createDataFrame([(c, enc.medians[c]) for c in enc.numeric], "feature string, median double")


@register("standard_scale", rounded(with_(*ENC_CTES) + "SELECT feature, mean, std FROM sc", ["mean", "std"]))
def standard_scale(spark, d):
    """mean and population std of the imputed columns (std 0 -> 1)."""
    _, enc = fitted(spark, d)
    return spark.createDataFrame([(c, enc.means[c], enc.stds[c]) for c in enc.numeric],
                                 "feature string, mean double, std double")


@register("impute_mode", with_(*ENC_CTES) + "SELECT feature, mode FROM mo")
def impute_mode(spark, d):
    """most frequent value per text column, ties to the smallest."""
    _, enc = fitted(spark, d)
    return spark.createDataFrame([(c, enc.modes[c]) for c in enc.categorical], "feature string, mode string")


@register("one_hot", rounded(with_(*ENC_CTES) +
          "SELECT feature, sum(value) AS n_ones, CAST(pos AS INT) AS position FROM catenc GROUP BY feature, pos",
          ["n_ones"]))
def one_hot(spark, d):
    """one column per sorted category; rows with a 1 per column, position kept."""
    df, enc = fitted(spark, d)
    wide = df.select(*enc.onehot_exprs())
    names = enc.output_names[len(enc.numeric):]
    pos = {n: len(enc.numeric) + i for i, n in enumerate(names)}
    sums = wide.agg(*[F.sum(n).alias(n) for n in names]).unpivot([], names, "feature", "n_ones")
    idx = spark.createDataFrame(list(pos.items()), "feature string, position int")
    return sums.join(F.broadcast(idx), "feature")


@register("encode_features", rounded(with_(*ENC_CTES) +
          "SELECT app_id, feature, value FROM enc", ["value"]))
def encode_features(spark, d):
    """The encoded matrix (41 named columns), as (app_id, feature, value)."""
    wide, enc = encoded(spark, d)
    return EN.long_features(wide, enc.output_names)


@register("correlated_features", rounded(with_(*ENC_CTES, PAIRS, HIGH) + "SELECT a, b, i, j, abs_r FROM high", ["abs_r"]))
def correlated_features(spark, d):
    """F8: encoded pairs with |r| > 0.85; column ``b`` (the later one) is dropped."""
    wide, enc = encoded(spark, d)
    return EN.correlated_pairs(wide, enc.output_names, 0.85)


@register("variance_filter", rounded(with_(*ENC_CTES, VARS) +
          "SELECT feature, variance, CASE WHEN variance > 0.01e0 THEN 1 ELSE 0 END AS kept FROM vars", ["variance"]))
def variance_filter(spark, d):
    """population variance per encoded column; kept when > 0.01."""
    wide, enc = encoded(spark, d)
    return EN.variance_table(wide, enc.output_names).withColumn(
        "kept", F.when(F.col("variance") > 0.01, 1).otherwise(0))


@register("select_features", rounded(with_(*ENC_CTES, PAIRS, HIGH, VARS) +
          "SELECT app_id, feature, value FROM enc WHERE feature NOT IN (SELECT b FROM high) "
          "AND feature IN (SELECT feature FROM vars WHERE variance > 0.01e0)", ["value"]))
def select_features(spark, d):
    """columns surviving the correlation and variance filters, in fitted order."""
    wide, enc = encoded(spark, d)
    names = enc.output_names
    drop = set(EN.correlation_drop(wide, names))
    kept = [n for n in names if n not in drop]
    kept = EN.variance_keep(wide, kept)
    return EN.long_features(EN.select_features(wide, kept, keep=("app_id",)), kept)


@register("importance_filter")
def importance_filter(spark, d):
    """100-tree forest importances over the correlation-reduced columns (>= 0.01)."""
    wide, enc = encoded(spark, d)
    names = enc.output_names
    drop = set(EN.correlation_drop(wide, names))
    kept = [n for n in names if n not in drop]
    return EN.importance_filter(wide, kept, TARGET)


@register("feature_info")
def feature_info(spark, d):
    """the fitted params table (medians, means, stds, modes, categories)."""
    _, enc = fitted(spark, d)
    return enc.params_df(spark)


@register("category_dictionary", with_(*ENC_CTES) +
          "SELECT cpos.feature, cpos.v AS value, cpos.pos - " + str(len(NUMERIC_ENC)) + " AS index, cc.n "
          "FROM cpos JOIN cc ON cc.feature = cpos.feature AND cc.v = cpos.v")
def category_dictionary(spark, d):
    """every category with its index and count, as a table of any size."""
    return CategoryDictionary.fit(feat(spark, d), CATEGORICAL_ENC).named()


@register("sparse_one_hot", with_(*ENC_CTES) +
          f"SELECT app_id, CAST((SELECT count(*) FROM cpos) AS INT) AS dimension, "
          f"string_agg(CAST(pos - {len(NUMERIC_ENC)} AS VARCHAR), ',' ORDER BY pos) AS positions "
          "FROM catenc WHERE value = 1e0 GROUP BY app_id")
def sparse_one_hot(spark, d):
    """one sparse vector an application by the dictionary, nulls as the mode; its positions as text."""
    df = feat(spark, d)
    dictionary = CategoryDictionary.fit(df, CATEGORICAL_ENC)
    return dictionary.encode(df, "app_id").select(
        "app_id", F.lit(dictionary.dimension).alias("dimension"), F.array_join(positions("features"), ",").alias("positions"))
