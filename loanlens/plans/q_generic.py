"""The generic operators on other schemas (FIXTURES §3): profiling lineitem and
customer, class balance and a stratified split of ``labels``.

Column roles come from the schema; these queries show the operators do not
depend on the loan table and exercise the scalable paths (lineitem's prices
are near-unique doubles, customer names are unique strings).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.operators import profile as P
from loanlens.operators.categories import CategoryDictionary, positions
from loanlens.operators.split import stratified_split
from loanlens.plans.q_profile import IQR_DOUBLES, _corr_sql, iqr_sql
from loanlens.plans.registry import register, rounded
from loanlens.sources.tables import read_table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _u(parts):
    return " UNION ALL ".join(parts)


def _describe_sql(src: str, cols: list[str]) -> str:
    return _u([f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
               f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
               f"quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {src}" for c in cols])


@register("describe_lineitem", rounded(_describe_sql("lineitem", LI_NUM),
                                       ["mean", "std", "min", "q25", "q50", "q75", "max"]))
def describe_lineitem(spark, d):
    """B3 on lineitem's numeric columns (quartiles of near-unique prices), with
    the distributed exact selection forced, so the scalable path is checked."""
    return P.describe_numeric(read_table(spark, d, "lineitem"), LI_NUM)


@register("iqr_outliers_lineitem", rounded(iqr_sql("lineitem", LI_NUM), IQR_DOUBLES))
def iqr_outliers_lineitem(spark, d):
    """B10 on lineitem, distributed exact quartiles."""
    return P.iqr_outliers(read_table(spark, d, "lineitem"), LI_NUM)


@register("corr_matrix_lineitem", rounded(_u([
    f"SELECT '{LI_NUM[i]}' AS a, '{LI_NUM[j]}' AS b, {i} AS i, {j} AS j, {_corr_sql(LI_NUM[i], LI_NUM[j])} AS r FROM lineitem"
    for i in range(len(LI_NUM)) for j in range(i + 1, len(LI_NUM))]), ["r"]))
def corr_matrix_lineitem(spark, d):
    """B8 on lineitem."""
    return P.corr_matrix(read_table(spark, d, "lineitem"), LI_NUM)


@register("rate_by_returnflag", rounded(
    "WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) "
    "SELECT l_returnflag, l_linestatus, n, n*100e0/sum(n) OVER (PARTITION BY l_returnflag) AS pct_within FROM g",
    ["pct_within"]))
def rate_by_returnflag(spark, d):
    """B14 with a text hue on lineitem."""
    return P.rate_by(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@register("describe_categorical_customer",
          "WITH lng AS (SELECT 'c_name' AS feature, c_name AS value FROM customer UNION ALL "
          "SELECT 'c_mktsegment', c_mktsegment FROM customer), "
          "cnt AS (SELECT feature, value, count(*) AS n FROM lng WHERE value IS NOT NULL GROUP BY feature, value), "
          "rk AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC) AS r FROM cnt) "
          "SELECT feature, CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", max(CASE WHEN r = 1 THEN value END) AS top, "
          "max(CASE WHEN r = 1 THEN n END) AS freq FROM rk GROUP BY feature")
def describe_categorical_customer(spark, d):
    """B4 on customer: a unique text column (names) goes through the salted top-k."""
    return P.describe_categorical(read_table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@register("class_balance_labels", rounded(
    "WITH g AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) "
    "SELECT quality, n, floor(n*100e0/(SELECT sum(n) FROM g)*100e0 + 0.5)/100e0 AS pct FROM g", ["pct"]))
def class_balance_labels(spark, d):
    """B7 on the second binary target (labels.quality)."""
    return P.class_balance(read_table(spark, d, "labels"), "quality")


@register("stratified_split_labels",
          "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) "
          "<= ceil(count(*) OVER (PARTITION BY quality) * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM labels")
def stratified_split_labels(spark, d):
    """G1 on labels (key doc_id, target quality)."""
    return stratified_split(read_table(spark, d, "labels"), key="doc_id", label="quality") \
        .select("doc_id", "quality", "split")


@register("sparse_one_hot_customer",
          "WITH v AS (SELECT c_custkey, 0 AS c, c_name AS v FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer), "
          "d AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS i FROM (SELECT DISTINCT c, v FROM v WHERE v IS NOT NULL)) "
          "SELECT v.c_custkey, CAST((SELECT count(*) FROM d) AS INT) AS dimension, "
          "coalesce(string_agg(CAST(d.i AS VARCHAR), ',' ORDER BY d.i), '') AS positions "
          "FROM v LEFT JOIN d ON v.c = d.c AND v.v = d.v GROUP BY v.c_custkey")
def sparse_one_hot_customer(spark, d):
    """F4 on customer: a category of its own for nearly every row, nulls without a position."""
    df = read_table(spark, d, "customer")
    dictionary = CategoryDictionary.fit(df, ["c_name", "c_mktsegment"])
    return dictionary.encode(df, "c_custkey", impute=False).select(
        "c_custkey", F.lit(dictionary.dimension).alias("dimension"), F.array_join(positions("features"), ",").alias("positions"))
