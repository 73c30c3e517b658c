"""Run tables: the record of a training run (params, metrics, model path).

Two append-only Parquet tables under a root folder (shared storage on a
cluster): ``run_params(run, name, value)`` and ``run_metrics(run, name,
value)``. A third, ``runs``, gets one row a run, written last: a run counts
only from then on. Readers go through ``runs``, so what a writer left behind
that stopped between its appends is never seen. The latest model of a run
name is found by a k-row query.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.sources.stages import _fs


def metrics_long(row_df: DataFrame, run: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot a one-row metrics frame to (run, name, value)."""
    cols = [c for c, t in row_df.dtypes if c not in exclude and t in ("double", "float", "int", "bigint")]
    long = row_df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "name", "value")
    return long.select(F.lit(run).alias("run"), "name", "value") if run else long


RUNS = "run string, run_name string, model_path string, n_params long, ts timestamp_ntz"
PARAMS = "run string, run_name string, name string, value string, ts timestamp_ntz"


def log_run(spark: SparkSession, root: str, run_name: str, params: dict, metrics: DataFrame,
            model_path: str | None = None) -> str:
    """Append params and metrics, then commit the run; returns its id."""
    run = f"{run_name}-{uuid.uuid4().hex[:8]}"
    ts = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    prow = [(run, run_name, str(k), str(v), ts) for k, v in params.items()]
    if model_path:
        prow.append((run, run_name, "model_path", model_path, ts))
    spark.createDataFrame(prow, PARAMS).write.mode("append").parquet(f"{root}/run_params")
    metrics_long(metrics, run).withColumn("run_name", F.lit(run_name)).withColumn("ts", F.lit(ts)) \
        .write.mode("append").parquet(f"{root}/run_metrics")
    # one row in one file: there whole or not at all
    spark.createDataFrame([(run, run_name, model_path, len(prow), ts)], RUNS).coalesce(1) \
        .write.mode("append").parquet(f"{root}/runs")
    return run


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Committed runs; no rows where there are none."""
    p, fs = _fs(spark, f"{root}/runs")
    if fs is not None and not fs.exists(p):
        return spark.createDataFrame([], RUNS)
    return spark.read.schema(RUNS).parquet(f"{root}/runs")


def run_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``run_params`` or ``run_metrics`` of committed runs."""
    return spark.read.parquet(f"{root}/{name}").join(runs(spark, root).select("run"), "run", "left_semi")


def latest_run(spark: SparkSession, root: str, run_name: str) -> tuple[str, str]:
    """(run, model path) of the newest committed run of that name with a model; error when absent."""
    row = (runs(spark, root).where((F.col("run_name") == run_name) & F.col("model_path").isNotNull())
           .orderBy(F.desc("ts"), F.desc("run")).select("run", "model_path").head())
    if row is None:
        raise FileNotFoundError(f"no model logged for run {run_name!r} under {root}")
    return row["run"], row["model_path"]


def latest_model_path(spark: SparkSession, root: str, run_name: str) -> str:
    """Model path of the newest committed run with that name; error when absent."""
    return latest_run(spark, root, run_name)[1]
