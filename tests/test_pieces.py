"""Forests whose trees stay in the shared folder: the same model as one held at the driver."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from loanlens.operators import forest as R
from loanlens.operators import grow, pieces
from loanlens.operators import train as TR


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(3000, 4)), 2)
    y = (x[:, 0] * x[:, 1] + 0.5 * rng.normal(size=len(x)) > 0).astype(int)
    rows = [(i, int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [(0, 0, Vectors.dense([1e9, -1e9, 0.0, -0.0])), (None, 1, Vectors.dense([0.5] * 4))]      # keys that repeat or are missing
    return spark.createDataFrame(rows, ["app_id", "label", "features"]).cache()


def probabilities(model, df):
    return sorted((r["app_id"] is None, r["app_id"] or 0, r["label"], r["probability_default"])
                  for r in TR.FittedModel("forest", model).predict(df).collect())


@pytest.mark.parametrize("small", [1 << 16, 150])
def test_a_forest_in_pieces_is_the_held_one(spark, table, tmp_path, monkeypatch, small):
    """With and without a top grown by passes; no tree reaches the driver."""
    forest = R.Forest(7, 30, 1)
    more = spark.createDataFrame([(5, 1, Vectors.dense([float("nan"), 1e300, float("-inf"), -0.0]))], table.schema).union(table)
    monkeypatch.setattr(grow, "LOCAL", small)
    monkeypatch.setattr(grow, "MANY", 1)
    held = R.fit_forest(table, forest, key="app_id")
    want, importances = probabilities(held, more), held.featureImportances.toArray()
    monkeypatch.setattr(R, "HELD", 0)
    monkeypatch.setattr(pieces, "SLICE", 500)
    monkeypatch.setattr(grow, "_attached", lambda *a: pytest.fail("trees at the driver"))
    got = R.fit_forest(table, forest, key="app_id")
    assert isinstance(got, pieces.PiecesModel) and (len(got.top["feature"]) > 7) == (small == 150)
    assert probabilities(got, more) == want
    assert np.allclose(got.featureImportances.toArray(), importances, rtol=1e-6)
    PipelineModel([got]).write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert probabilities(back, more) == want


def test_trees_without_a_record_or_a_split(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD", 0)
    one = spark.createDataFrame([(1, 1, Vectors.dense([1.0, 2.0]))], ["app_id", "label", "features"])
    model = R.fit_forest(one, R.Forest(20), key="app_id")
    monkeypatch.setattr(R, "HELD", 1 << 27)
    assert probabilities(model, one) == probabilities(R.fit_forest(one, R.Forest(20), key="app_id"), one)
    assert probabilities(model, one.where("label = 5")) == []
