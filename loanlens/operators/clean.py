"""Cleaning and projection (outlier filters, fills, log transform)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.sources.tables import TARGET


def filter_outliers(df: DataFrame, max_age: int = 100, max_emp: float = 60.0) -> DataFrame:
    """Keep age < max_age and employment length <= max_emp.

    ``emp <= 60`` is false for null, so rows without employment length go too,
    as in the reference. Both predicates reach the scan as pushed filters when
    ``df`` is a plain Parquet source.
    """
    return df.where((F.col("person_age") < max_age) & (F.col("person_emp_length") <= max_emp))


def target_last(df: DataFrame, target: str = TARGET) -> DataFrame:
    if target not in df.columns:
        return df
    return df.select(*[c for c in df.columns if c != target], target)


def clean_applications(df: DataFrame, exact: bool = True, max_age: int = 100,
                       max_emp: float = 60.0) -> DataFrame:
    """Filter, fill employment length with 0, fill rate with its median.

    The median is taken **after** the filters. It is one row, which is
    cross-joined back as a broadcast constant (no shuffle of the rows);
    ``exact=False`` takes it from a bounded-memory sketch.
    """
    from loanlens.operators.profile import quantile_row
    kept = filter_outliers(df, max_age, max_emp)
    med = quantile_row(kept, ["loan_int_rate"], [0.5], ["median"], "exact" if exact else "approx").select(
        F.col("loan_int_rate__median").alias("_rate_median"))
    out = (kept.crossJoin(F.broadcast(med))
           .withColumn("person_emp_length", F.coalesce(F.col("person_emp_length"), F.lit(0.0)))
           .withColumn("loan_int_rate", F.coalesce(F.col("loan_int_rate"), F.col("_rate_median")))
           .drop("_rate_median"))
    return target_last(out)


def log1p_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace each named column by log(1 + x)."""
    cols = set(cols)
    return df.select([F.log1p(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
