"""Exact quantiles by nested histograms against numpy and ``percentile``."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanlens.operators import quantiles as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(df, cols, groups=()):
    got = {(*[r[g] for g in groups], r["feature"], r["p"]): r["value"] for r in Q.quantiles_long(df, cols, PROBS, list(groups)).collect()}
    want = df.groupBy(*groups).agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, PROBS))).alias(c) for c in cols]).collect()
    n = 0
    for r in want:
        for c in cols:
            for p, v in zip(PROBS, r[c] or [], strict=False):
                g = got[(*[r[x] for x in groups], c, p)]
                assert g == pytest.approx(v, rel=1e-15, nan_ok=True), (c, p)
                n += 1
    assert n == len(got)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    n = 3000
    hot = np.where(rng.random(n) < 0.34, 7.25, rng.normal(size=n))
    wild = np.concatenate([[1e12, -1e300, 5e-324, 1.7976931348623157e308, -1.7976931348623157e308], rng.normal(0, 1e-9, n - 5)])
    rows = [(int(i % 3) if i % 7 else None, float(hot[i]), float(wild[i]), int(rng.integers(0, 40)), None, float(i) if i % 5 else None,
             float(10.0 ** rng.integers(-300, 300))) for i in range(n)]
    return spark.createDataFrame(rows, "g int, hot double, wild double, few int, none double, some double, tall double").repartition(6)


COLS = ["hot", "wild", "few", "none", "some", "tall"]


@pytest.mark.parametrize("bins", [1 << 14, 300])
def test_equal_to_percentile(values, monkeypatch, bins):
    monkeypatch.setattr(Q, "BINS", bins)
    check(values, COLS)


def test_equal_to_percentile_by_group_with_a_null_group(values):
    check(values, COLS, ["g"])


def test_nan_and_infinities(spark):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (2.0,), (None,), (float("inf"),)]
    check(spark.createDataFrame(rows, "v double"), ["v"])
    check(spark.createDataFrame([(float("nan"),)] * 3, "v double"), ["v"])
    check(spark.createDataFrame([(0.0,), (-0.0,), (5e-324,)], "v double"), ["v"])


def test_many_distinct_values(spark):
    df = spark.range(600_000).select(F.pow(F.lit(1.00001), F.col("id")).alias("b"))
    a = np.sort(np.array([r[0] for r in df.collect()]))
    got = {r["p"]: r["value"] for r in Q.quantiles_long(df, ["b"], [0.5, 0.99]).collect()}
    for p, v in got.items():
        pos = (len(a) - 1) * p
        lo, hi = math.floor(pos), math.ceil(pos)
        assert v == pytest.approx(a[lo] if lo == hi else (hi - pos) * a[lo] + (pos - lo) * a[hi], rel=1e-15)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g int, v double")
    assert Q.quantiles_long(none, ["v"], [0.5]).count() == 0
    assert Q.quantiles_wide(none, ["v"], [0.5]).collect()[0][0] is None
    assert Q.quantiles_wide(none, ["v"], [0.5], ["g"]).count() == 0
