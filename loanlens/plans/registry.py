"""Registry of named queries and their DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` built from the
library's operators. Double columns of its result are rounded half-up to
6 decimals (``r6``) so that value hashes compare across engines; oracles
do the same with ``rounded(sql, cols)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.functions.columns import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
RAW: dict[str, QueryFn] = {}


def register(name: str, oracle: str | None = None, round_result: bool = True):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if round_result else df

        run.__name__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        RAW[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def rounded(sql: str, cols: list[str]) -> str:
    """Wrap an oracle so the named double columns are rounded like ``r6``."""
    if not cols:
        return sql
    rep = ", ".join(f"floor({c}*1e6 + 0.5)/1e6 AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _t"


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    from loanlens.plans import (  # noqa: F401
        q_profile, q_clean, q_rules, q_features, q_encode, q_split, q_evaluate,
        q_drift, q_models, q_stream, q_generic)
