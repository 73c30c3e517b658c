"""Streaming and model tests: batch = stream on the same rows, late data
beyond the watermark is dropped, model persistence round trip."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from loanlens.operators import train as TR
from loanlens.operators.features import serving_view
from loanlens.operators.score import score_records
from loanlens.plans.base import apps
from loanlens.plans.modeling import prepare
from loanlens.session import scratch_path
from loanlens.streaming import jobs as S


@pytest.fixture(scope="module")
def small_model(spark, sf):
    p = prepare(spark, sf)
    return p, TR.fit_model("gbt", p.train, gbt_iter=5)


def test_stream_scoring_equals_batch(spark, sf, small_model):
    p, m = small_model
    recs = serving_view(apps(spark, sf)).drop("app_ts", "loan_status")
    batch = score_records(recs, p.encoder, p.selected, m, 0.55)
    d = scratch_path(spark, "ll-stream-" + uuid.uuid4().hex[:8])
    recs.write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = S.score_stream(spark, os.path.join(d, "in"), recs.schema, p.encoder, p.selected, m, 0.55,
                            os.path.join(d, "out"))
    cols = ["app_id", "prediction", "risk_level", "recommendation"]
    a = sorted(tuple(r) for r in batch.select(*cols).collect())
    b = sorted(tuple(r) for r in stream.select(*cols).collect())
    assert a == b and len(a) > 0
    pa = dict(batch.select("app_id", "probability_default").collect())
    pb = dict(stream.select("app_id", "probability_default").collect())
    # an invalid record has no probability, but a row that names its broken rules
    assert len(pa) == recs.count() and {k for k in pa if pa[k] is None} == {k for k in pb if pb[k] is None}
    assert all(abs(pa[k] - pb[k]) < 1e-12 for k in pa if pa[k] is not None)
    assert batch.filter("probability_default IS NULL AND coalesce(violations, '') = ''").count() == 0


def test_replay_safe_scoring_equals_batch(spark, sf, small_model):
    p, m = small_model
    recs = serving_view(apps(spark, sf)).drop("app_ts", "loan_status")
    src, out = (scratch_path(spark, f"ll-{x}-" + uuid.uuid4().hex[:8]) for x in ("in", "safe"))
    recs.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.score_stream_safe(stream, out, p.encoder, p.selected, m, 0.55)
    cols = ["app_id", "prediction", "risk_level", "recommendation"]
    batch = score_records(recs, p.encoder, p.selected, m, 0.55, on_invalid="drop").select(*cols).collect()
    got = S.committed(spark, out, "scored").select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and got
    bad = S.committed(spark, out, "quarantine")
    assert bad.count() == recs.count() - len(got) and bad.where("size(violations) = 0").count() == 0


def test_late_events_beyond_watermark_are_dropped(spark):
    """Spark drops a late row against the previous batch's watermark, so the
    late file comes third: batch 0 advances the watermark to 2024-01-11 05:00,
    batch 1 carries it forward, batch 2's row from 2024-01-01 is dropped."""
    import time
    d = scratch_path(spark, "ll-late-" + uuid.uuid4().hex[:8])
    schema = S.EVENTS_SCHEMA
    t = dt.datetime
    files = {
        "a": [(i, t(2024, 1, 10, 1 + i), 1, "view", 10.0, "{}") for i in range(3)] +
             [(9, t(2024, 1, 12, 5), 1, "view", 10.0, "{}")],
        "b": [(10, t(2024, 1, 12, 6), 1, "view", 10.0, "{}")],
        "c": [(100, t(2024, 1, 1, 12), 1, "view", 99.0, "{}")],
    }
    for name, rows in files.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(d, name))
        time.sleep(1.1)  # the file source orders files by modification time
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(d))
    ref = spark.createDataFrame([(10.0,)], "reference_mean double")
    out = S.run_to_memory(S.daily_mean_shift(src, ref), "append").collect()
    days = {r.day for r in out}
    assert dt.date(2024, 1, 10) in days          # closed by the watermark
    assert dt.date(2024, 1, 1) not in days       # arrived after the watermark passed it


def test_model_persistence_roundtrip(spark, small_model):
    p, m = small_model
    d = scratch_path(spark, "ll-model-" + uuid.uuid4().hex[:8])
    TR.save_model([m.model], d)
    loaded = TR.load_model(d)
    a = m.model.transform(p.test).select("app_id", "_prob").collect()
    b = loaded.transform(p.test).select("app_id", "_prob").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_models_output_probabilities(spark, small_model):
    p, _ = small_model
    for kind in ("logreg", "svm"):
        fm = TR.fit_model(kind, p.train, rff_components=32)
        out = fm.predict(p.test).select(F.min("probability_default"), F.max("probability_default")).head()
        assert 0.0 <= out[0] <= out[1] <= 1.0
        met = TR.test_metrics(fm, p.test).head()
        assert 0.5 < met.roc_auc <= 1.0


def test_offline_flow_and_reloaded_scorer(spark, sf):
    from loanlens.plans.offline import load_scorer, train_and_select
    out = scratch_path(spark, "ll-offline-" + uuid.uuid4().hex[:8])
    res = train_and_select(spark, sf, out, k=2, num_trees=5, gbt_iter=5)
    assert res["comparison"].count() == 4 and res["cv_summary"].count() == 4
    assert res["sweep"].count() == 16
    final = res["final"].head()
    assert final.threshold == 0.55 and 0.0 <= final.roc_auc <= 1.0
    scorer = load_scorer(spark, out)
    assert scorer.threshold == 0.55 and len(scorer.selected) > 0
    recs = serving_view(apps(spark, sf)).drop("app_ts", "loan_status")
    scored = scorer(recs)
    assert scored.count() > 0
    assert set(scored.columns) >= {"prediction", "probability_default", "risk_level", "recommendation"}


def test_strict_scoring_raises_on_invalid_batch(spark, sf, small_model):
    p, m = small_model
    recs = serving_view(apps(spark, sf)).drop("app_ts", "loan_status")  # holds ages of 144, missing fields
    with pytest.raises(ValueError, match="Error in record"):
        score_records(recs, p.encoder, p.selected, m, 0.55, on_invalid="raise")
