"""Sinks: tables as Parquet or CSV, and small text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """A4: write a table. CSV gets a header; there is no positional index
    (the key is a column). ``partition_by`` enables partition pruning on read."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(fmt)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """Write one small text document (a report) as a single-file text table."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
