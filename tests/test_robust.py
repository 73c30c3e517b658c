"""Missing values, empty sides, null groups, folder tables and nested stages."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from loanlens.operators import drift as D
from loanlens.operators.evaluate import average_precision
from loanlens.operators.profile import kde
from loanlens.operators.split import stratified_folds, stratified_split, with_weights
from loanlens.session import scratch_path
from loanlens.sources.stages import input_stamp, stage
from loanlens.streaming import jobs as S


def test_nested_stage_on_a_fresh_folder(spark, sf):
    inputs = [f"{sf}/orders.parquet"]
    a = "a" + uuid.uuid4().hex[:6]
    inner = lambda: stage(spark, a, inputs, lambda: spark.range(3))
    assert stage(spark, a + "-outer", inputs, lambda: inner().filter("id > 0")).count() == 2


def test_stamp_follows_part_files(spark):
    d = scratch_path(spark, "stamp-" + uuid.uuid4().hex[:8])
    spark.range(3).coalesce(1).write.parquet(d)
    before = input_stamp(spark, [d])
    spark.range(5).coalesce(1).write.mode("append").parquet(d)
    assert input_stamp(spark, [d]) != before


def test_null_labels_stay_in_split_and_folds(spark):
    df = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("y"))
    sp = stratified_split(df, "k", "y")
    assert sp.count() == 40 and sp.filter("y IS NULL AND split = 'test'").count() == 4
    assert stratified_folds(df, "k", "y", 5).filter("y IS NULL").select("fold").distinct().count() == 5
    assert with_weights(df, "y").filter("weight IS NULL").count() == 0


@pytest.mark.parametrize("name", ["ks_drift", "psi_drift", "js_drift", "chi2_drift", "wasserstein_drift"])
def test_drift_with_an_empty_side(spark, name):
    ref = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    col = "c" if name in ("js_drift", "chi2_drift") else "x"
    rows = getattr(D, name)(ref, ref.limit(0), [col]).collect()
    assert len(rows) == 1


def test_average_precision_without_positives_and_constant_density(spark):
    df = spark.range(10).select(F.lit(0).alias("label"), F.col("id").cast("double").alias("score"))
    assert average_precision(df).first()[0] == 0.0
    assert {r["density"] for r in kde(df.withColumn("z", F.lit(2.0)), "z").collect()} == {None}


@pytest.mark.parametrize("folder", [True, False])
def test_event_stream_reads_files_and_folders(spark, sf, folder):
    d = scratch_path(spark, "ev-" + uuid.uuid4().hex[:8])
    src = spark.read.parquet(f"{sf}/events.parquet")
    if folder:
        src.repartition(3).write.parquet(f"{d}/events.parquet")
        at = d
    else:
        at = sf
    out = S.run_to_parquet(S.events_stream(spark, at, max_files=10).select("event_id"), os.path.join(d, "out"))
    assert out.count() == src.count()
