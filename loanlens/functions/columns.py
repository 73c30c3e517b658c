"""Column-expression helpers. All JVM-side; nothing here runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is 0 or null (ANSI mode raises on a bare zero divisor)."""
    return F.try_divide(col_(a), col_(b))


def r6(c: str | Column) -> Column:
    """Round half up to 6 decimals the same way in Spark and DuckDB."""
    return F.floor(col_(c) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def round_doubles(df: DataFrame) -> DataFrame:
    """Apply ``r6`` to every double column (for value-hash comparison)."""
    return df.select([
        r6(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields])


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys come from ``left``."""
    r = right.select(*[F.col(c).alias(f"_rk_{c}" if c in keys else c) for c in right.columns])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_rk_{k}"])
        on = c if on is None else on & c
    return left.join(r, on, how).drop(*[f"_rk_{k}" for k in keys])


def nan_to_null(df: DataFrame) -> DataFrame:
    """One missing value: NaN in double columns becomes null."""
    return df.select([
        F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, INTEGRAL_TYPES)


def right_closed_bins(c: str | Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed interval (e_i, e_{i+1}] holding c; null outside.

    ``Bucketizer`` is left-closed and raises out of range, so it is not used.
    """
    x = col_(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def unpivot(df: DataFrame, ids: list[str], cols: list[str], var: str = "feature",
            val: str = "value", cast: str | None = None) -> DataFrame:
    """Wide -> long via ``DataFrame.unpivot`` (one projection, no shuffle)."""
    src = df.select(*ids, *[F.col(c).cast(cast).alias(c) if cast else F.col(c) for c in cols])
    return src.unpivot(ids, cols, var, val)
