"""Landmark kernel map and probabilities calibrated on held-out margins."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanlens.operators import kernel as K
from loanlens.operators import train as TR
from loanlens.plans.base import clean
from loanlens.sources.tables import TARGET

NAMES = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_int_rate", "loan_percent_income"]


@pytest.fixture(scope="module")
def rows(spark):
    df = clean(spark, "/root/testdata/sf0.1")
    m = df.agg(*[F.avg(c).alias(f"m_{c}") for c in NAMES], *[F.stddev_pop(c).alias(f"s_{c}") for c in NAMES]).head()
    df = df.select("app_id", F.col(TARGET).alias("label"),
                   *[((F.col(c) - m[f"m_{c}"]) / m[f"s_{c}"]).alias(c) for c in NAMES]).na.fill(0.0)
    data = TR.assemble(df, NAMES).select("app_id", "label", "features")
    h = F.pmod(F.xxhash64("app_id"), F.lit(10))
    return data.where(h < 2), data.where(h >= 6)


def test_map_reproduces_the_kernel_between_landmarks(rows):
    train, _ = rows
    many = train.limit(50).unionByName(train.limit(50)).unionByName(train.limit(50))      # repeated rows
    m = K.NystromMap.fit(many, components=40)
    assert len(m.landmarks) == 40 and len(np.unique(m.landmarks, axis=0)) == 40
    z = m.apply(m.landmarks)
    assert np.abs(z @ z.T - K.rbf(m.landmarks, m.landmarks, m.gamma)).max() < 1e-6
    out = m.transform(train.limit(5)).select(vector_to_array("features").alias("x"), vector_to_array("kernel").alias("z")).collect()
    for r in out:
        assert np.allclose(m.apply(np.array([r["x"]]))[0], r["z"])


def test_probabilities_are_reliable_on_held_out_rows(rows):
    """Records in ten bins of the predicted probability: the share of positives is near the mean prediction."""
    train, test = rows
    fm = TR.fit_model("svm", train, rff_components=64)
    p = fm.predict(test).select("label", F.col("probability_default").alias("p"))
    bins = p.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("label").alias("y")).collect()
    n = sum(r["n"] for r in bins)
    error = sum(r["n"] * abs(r["p"] - r["y"]) for r in bins) / n
    print("calibration error", error, [(r["b"], r["n"], round(r["p"], 3), round(r["y"], 3)) for r in sorted(bins, key=lambda r: r["b"])])
    assert n > 50_000 and error < 0.03
    assert TR.test_metrics(fm, test).head().roc_auc > 0.6


def test_tables_too_small_for_folds(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(0.0, Vectors.dense(0.0, 1.0)), (1.0, Vectors.dense(1.0, 0.0))], ["label", "features"])
    out = TR.fit_model("svm", df, rff_components=8).predict(df).select("label", "probability_default").collect()
    assert all(0.0 <= r["probability_default"] <= 1.0 for r in out)


def made_up(spark, n=4000):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(0, 0.4, n) > 0.5).astype(float)
    return spark.createDataFrame([(float(b), Vectors.dense(a.tolist()), float(1 + i % 3)) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                                 ["label", "features", "weight"])


def test_machine_is_that_of_linear_svc_without_mapped_rows(spark, monkeypatch):
    """Six machines in step, a pass for all of them; the first is ``LinearSVC``'s on the mapped rows."""
    from pyspark.ml.classification import LinearSVC
    df = made_up(spark)
    m = K.NystromMap.fit(df, components=24)
    mapped = m.transform(df, "features", "z").coalesce(1)
    total = df.agg(F.sum("weight")).head()[0]
    for most in (1, 6):
        want = LinearSVC(featuresCol="z", labelCol="label", weightCol="weight", maxIter=most, regParam=1.0 / total).fit(mapped)
        passes, summed = [], K._hinge

        def counted(blocks, shared, u, offset, left_out, passes=passes, summed=summed):
            passes.append(len(offset))
            return summed(blocks, shared, u, offset, left_out)
        with monkeypatch.context() as mp:
            mp.setattr(K, "_hinge", counted)
            mp.setattr(K.NystromMap, "transform", lambda *a, **k: pytest.fail("mapped rows"))
            mp.setattr(K.minimised, "__defaults__", (most, 10, 1e-6))
            got, _ = K.fit_machine(df, m, "features", "label")
        assert max(passes) == K.FOLDS + 1 and len(passes) <= 20 * most + 1
        assert np.allclose(got.coefficients, want.coefficients.toArray(), rtol=1e-6, atol=1e-8)
        assert got.intercept == pytest.approx(want.intercept, rel=1e-6)


def test_machines_in_step_equal_machines_alone(spark):
    df = made_up(spark, 1500)
    m = K.NystromMap.fit(df, components=12)
    one = K.fit_machine(df, m, "features", "label", calibrate=False)[0]
    six = K.fit_machine(df, m, "features", "label")[0]
    x = np.stack([r["features"].toArray() for r in df.limit(200).collect()])
    assert np.abs(one.margins(x) - six.margins(x)).max() < 0.05


def test_first_gradient_of_the_intercept_is_the_exact_sum(spark, monkeypatch):
    """Balanced classes: zero but for the rounding of the weights, whose sign steers the steps."""
    from fractions import Fraction
    df = TR.balanced_weights(made_up(spark, 3000).drop("weight"))
    want = float(sum(Fraction(r["weight"]) * (-1 if r["label"] else 1) for r in df.select("label", "weight").collect()))
    first, summed = [], K._hinge

    def spied(*a):
        out = summed(*a)
        first.append(out[2][0])
        return out
    monkeypatch.setattr(K, "_hinge", spied)
    monkeypatch.setattr(K.minimised, "__defaults__", (1, 10, 1e-6))
    for parts in (1, 7):
        first.clear()
        K.fit_machine(df.repartition(parts), K.NystromMap.fit(df, components=8), "features", "label")
        assert first[0] == pytest.approx(want, rel=1e-3, abs=1e-17)


def test_fourier_map_fits(spark):
    df = made_up(spark, 600).drop("weight")
    out = TR.fit_model("svm", df, rff_components=16, kernel_map="fourier").predict(df).agg(F.min("probability_default"), F.max("probability_default")).head()
    assert 0.0 <= out[0] < out[1] <= 1.0


def test_kernel_is_exact_without_a_call_for_each_value(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 5)), rng.normal(size=(7, 5))
    x[0], x[1], x[2, 0], x[3] = y[0], 1e3, np.nan, 1e100
    want = np.exp(-0.3 * ((x[:, None, :] - y[None]) ** 2).sum(-1))
    z = -np.concatenate([[0.0, 1e-17, 1e-9], rng.random(5000) * 40, rng.random(500) * 700])
    exps = np.exp(z)
    monkeypatch.setattr(np, "exp", lambda *a, **k: pytest.fail("numpy's exp"))
    got = K.rbf(x, y, 0.3)
    assert np.isnan(got[2]).all() and not np.isnan(np.delete(got, 2, 0)).any()
    assert np.allclose(got, want, rtol=1e-12, atol=1e-300, equal_nan=True) and np.nanmax(got) <= 1.0
    assert np.abs(K._exp(z) / exps - 1).max() < 1e-15
