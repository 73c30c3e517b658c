"""Named queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every operator module so that its ``register`` calls run."""
    from loanlens.llm import (  # noqa: F401
        url_filter, mixing, quality, token_ids, line_dedup, language, toxicity, simhash, decontaminate, suffix_repeats,
        substring_dedup, importance, hard_negatives)
