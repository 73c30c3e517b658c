"""Scans of the driver tables and of the derived ``applications`` table.

``applications`` (one loan application per order) is defined once, as SQL
text with ``{orders}`` / ``{customer}`` placeholders. Spark runs it through
``spark.sql(text, orders=df, customer=df)`` and the DuckDB oracles embed the
same text with plain view names, so both engines compute the same rows.

Rules that keep the two engines equal: ``floor`` instead of ``round`` (ties
round differently), exponent literals for doubles (plain decimals are
DECIMAL), no integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loanlens.functions.columns import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# CTE chain, placeholders {orders} and {customer}; ends with the
# ``applications`` CTE so callers can append more CTEs or a final SELECT.
APPLICATIONS_CTES = """b AS (
 SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice,
   CAST((o_custkey*7919 + o_orderkey*104729) % 1000 AS DOUBLE) AS u,
   CASE WHEN (o_orderkey*13) % 28 < 9 THEN 0 WHEN (o_orderkey*13) % 28 < 17 THEN 1 WHEN (o_orderkey*13) % 28 < 22 THEN 2
        WHEN (o_orderkey*13) % 28 < 25 THEN 3 WHEN (o_orderkey*13) % 28 < 26 THEN 4 WHEN (o_orderkey*13) % 28 < 27 THEN 5 ELSE 6 END AS g,
   CASE WHEN o_orderkey % 997 = 1 THEN 144 ELSE 18 + (o_custkey*7 + o_orderkey) % 55 END AS age
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey
), c AS (
 SELECT b.*, CASE WHEN o_orderkey % 211 = 7 THEN CAST(0 AS DOUBLE) ELSE floor(4000 + u*u*u*2e-4) * 1e0 END AS income,
   least(CAST(35000 AS DOUBLE), greatest(CAST(500 AS DOUBLE), floor(o_totalprice/250e0)*25e0)) AS amnt,
   CASE WHEN (o_custkey*31) % 20 < 10 THEN 'RENT' WHEN (o_custkey*31) % 20 < 18 THEN 'MORTGAGE' WHEN (o_custkey*31) % 20 < 19 THEN 'OWN' ELSE 'OTHER' END AS own
 FROM b
), d AS (
 SELECT c.*, CASE WHEN income = 0 THEN 1e0 ELSE least(1e0, floor(amnt/income*100)/100e0) END AS lpi FROM c
), applications AS (
SELECT o_orderkey AS app_id, o_orderdate AS app_ts, CAST(age AS INT) AS person_age, income AS person_income, own AS person_home_ownership,
 CASE WHEN o_orderkey % 37 = 5 THEN NULL WHEN o_orderkey % 991 = 2 THEN 123e0 ELSE CAST(o_orderkey % 23 AS DOUBLE) END AS person_emp_length,
 CASE o_custkey % 6 WHEN 0 THEN 'PERSONAL' WHEN 1 THEN 'EDUCATION' WHEN 2 THEN 'MEDICAL' WHEN 3 THEN 'VENTURE' WHEN 4 THEN 'HOMEIMPROVEMENT' ELSE 'DEBTCONSOLIDATION' END AS loan_intent,
 substr('ABCDEFG', g+1, 1) AS loan_grade, amnt AS loan_amnt,
 CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE (500 + 200*g + o_orderkey % 100)/100e0 END AS loan_int_rate,
 lpi AS loan_percent_income,
 CASE WHEN g >= 2 AND o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS cb_person_default_on_file,
 CAST(2 + floor(greatest(0, age - 20)/2e0) AS INT) AS cb_person_cred_hist_length,
 CASE WHEN g + 4*lpi + (CASE WHEN own = 'RENT' THEN 1 ELSE 0 END) + ((o_orderkey*7907 + o_custkey*613) % 1000)/250e0 > 8.2e0 THEN 1 ELSE 0 END AS loan_status
FROM d
)"""

# Raw training schema (12 columns) plus our key and timestamp.
FEATURES_RAW = ["person_age", "person_income", "person_home_ownership",
                "person_emp_length", "loan_intent", "loan_grade", "loan_amnt",
                "loan_int_rate", "loan_percent_income",
                "cb_person_default_on_file", "cb_person_cred_hist_length"]
TARGET = "loan_status"

APPLICATION_SCHEMA = T.StructType([
    T.StructField("app_id", T.LongType(), False),
    T.StructField("app_ts", T.TimestampNTZType(), True),
    T.StructField("person_age", T.IntegerType(), True),
    T.StructField("person_income", T.DoubleType(), True),
    T.StructField("person_home_ownership", T.StringType(), True),
    T.StructField("person_emp_length", T.DoubleType(), True),
    T.StructField("loan_intent", T.StringType(), True),
    T.StructField("loan_grade", T.StringType(), True),
    T.StructField("loan_amnt", T.DoubleType(), True),
    T.StructField("loan_int_rate", T.DoubleType(), True),
    T.StructField("loan_percent_income", T.DoubleType(), True),
    T.StructField("cb_person_default_on_file", T.StringType(), True),
    T.StructField("cb_person_cred_hist_length", T.IntegerType(), True),
    T.StructField("loan_status", T.IntegerType(), True),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def applications_sql(orders: str = "orders", customer: str = "customer") -> str:
    """The CTE chain with concrete relation names (for DuckDB / SQL users)."""
    return APPLICATIONS_CTES.replace("{orders}", orders).replace("{customer}", customer)


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per order, computed from ``orders`` and ``customer``.

    The join key is the customer key; Catalyst plans it (broadcast hash join
    when the customer key side is under the broadcast threshold, sort-merge
    otherwise). Only the four order columns and ``c_custkey`` are read.
    """
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    return spark.sql("WITH " + APPLICATIONS_CTES + " SELECT * FROM applications",
                     orders=orders, customer=customer)


def read_applications_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan with header and the explicit application schema (no inference)."""
    return nan_to_null(spark.read.schema(APPLICATION_SCHEMA)
                       .option("header", True).option("nanValue", "NaN").csv(path))


def read_applications_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON records (one object per line) with the explicit schema."""
    return nan_to_null(spark.read.schema(APPLICATION_SCHEMA).json(path))
