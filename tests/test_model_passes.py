"""What the passes of the model fits cost: counted, not timed."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from loanlens.operators import boosting, grow, trees
from loanlens.operators.quantiles import quantiles_long


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 4)), 2)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=len(x)) > 0).astype(int)
    return spark.createDataFrame([(i, int(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x, y, strict=True))],
                                 ["app_id", "label", "features"]).cache()


def test_bin_edges_are_the_exact_quantiles_without_a_row_for_each_value(spark, monkeypatch):
    rng = np.random.default_rng(1)
    cols = [rng.normal(size=4000), rng.integers(0, 2, 4000).astype(float), np.repeat([-0.0, 0.0, 5.0, -7.5], 1000),
            rng.choice([1e-310, -1e300, 1e300, math.inf, -math.inf, 3.0], 4000), 1.0 + rng.integers(0, 9, 4000) * 2.0 ** -52]
    x = np.stack(cols, 1)
    names = [f"x{j}" for j in range(x.shape[1])]
    probs = [i / 31 for i in range(32)]
    want = {}
    for r in quantiles_long(spark.createDataFrame(x.tolist(), names), names, probs).collect():
        want.setdefault(r["feature"], []).append((r["p"], r["value"]))
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["features"])
    got = trees.vector_quantiles(df, x.shape[1], probs)
    for name, values in zip(names, got, strict=True):
        assert [v for _, v in sorted(want[name])] == pytest.approx(values, rel=0, abs=0, nan_ok=True)
    monkeypatch.setattr("pyspark.sql.DataFrame.unpivot", lambda *a, **k: pytest.fail("a row for each value"))
    edges = trees.bin_edges(df.select("features"), x.shape[1])
    assert edges[1] == [0.0] and edges[2] == [-7.5, 0.0] and len(edges[0]) == 31


def test_places_keep_the_order_of_doubles():
    v = np.array([-math.inf, -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, math.inf, math.nan])
    p = trees.places(v)
    assert (np.diff(p) > 0).all() and trees.places(np.array([-0.0]))[0] == p[4]
    assert [trees.value_at(int(q)) for q in p[:-1]] == v[:-1].tolist() and math.isnan(trees.value_at(int(p[-1])))
    assert trees.places(np.array([-math.nan]))[0] == p[-1]


def test_of_two_children_one_is_summed(table, monkeypatch):
    """Half the nodes of a level are summed, and the trees are those of nodes grown in one task each."""
    def fitted():
        t = boosting.Training.start(table, [boosting.Setting(4)], key="app_id").run(3)
        m = t.model(0)
        t.close()
        return m
    want, asked, summed = fitted(), [], grow._summed

    def counting(blocks, sums, few):
        out = summed(blocks, sums, few)
        asked.append(len(out))
        return out
    monkeypatch.setattr(grow, "_limit", lambda rule, size: 0)
    monkeypatch.setattr(grow, "_summed", counting)
    got = fitted()
    assert max(asked) <= 4 and len(asked) == 12         # 1, 1, 2 and 4 nodes of the four levels at most
    for a, b in zip(got.trees, want.trees, strict=True):
        assert sorted(a.threshold.tolist()) == sorted(b.threshold.tolist()) and sorted(a.value.tolist()) == sorted(b.value.tolist())


def test_boosting_of_a_middling_table_uses_all_cores(spark, table):
    big = spark.range(600_000).selectExpr("id AS app_id", "CAST(id % 2 AS INT) AS label", "array(CAST(id % 7 AS DOUBLE)) AS x")
    from pyspark.ml.functions import array_to_vector
    t = boosting.Training.start(big.select("app_id", "label", array_to_vector("x").alias("features")), [boosting.Setting()], key="app_id")
    parts = t.binned.parts
    t.close()
    assert parts >= min(8, spark.sparkContext.defaultParallelism)


def test_feature_importance_leaves_the_trees_in_their_tasks(spark, table, monkeypatch):
    from types import SimpleNamespace

    from loanlens.operators import train as TR
    from loanlens.plans import q_models
    names = [f"x{j}" for j in range(4)]
    want = TR.feature_importance(TR.fit_model("forest", table), names)
    monkeypatch.setattr(grow, "_attached", lambda *a: pytest.fail("trees at the driver"))
    monkeypatch.setattr(q_models, "prepare", lambda *a: SimpleNamespace(train=table, selected=names))
    monkeypatch.setattr(q_models, "input_stamp", lambda *a: "made up")
    got = q_models.feature_importance(spark, "/nowhere").orderBy("rank").collect()
    assert [r["feature"] for r in got] == [n for n, _ in want]
    assert [r["importance"] for r in got] == pytest.approx([v for _, v in want], rel=1e-9)


def test_the_compared_models_are_fitted_at_once(spark, monkeypatch):
    """Four fits meet at a barrier, which one after another would never pass."""
    from threading import Barrier
    from types import SimpleNamespace

    from loanlens.plans import q_models
    together = Barrier(4, timeout=60)

    def metrics(fm, test):
        return spark.createDataFrame([(fm, 0.5, 0.5, float(len(fm)), 0.5, 0.5)],
                                     "model string, accuracy double, precision double, recall double, f1 double, roc_auc double")
    monkeypatch.setattr(q_models, "prepare", lambda *a: SimpleNamespace(train=None, test=None))
    monkeypatch.setattr(q_models, "input_stamp", lambda *a: "made up at once")
    monkeypatch.setattr(q_models.TR, "fit_model", lambda kind, train: (together.wait(), kind)[1])
    monkeypatch.setattr(q_models.TR, "test_metrics", metrics)
    assert [r["model"] for r in q_models.model_comparison(spark, "/nowhere").collect()] == list(q_models.TR.MODELS)
    assert q_models.best_model(spark, "/nowhere").head()["model"] == "forest"       # the longest name, then the first one


def test_folds_of_all_models_are_fitted_at_once(spark, table, monkeypatch):
    from threading import Barrier

    from pyspark.sql import functions as F

    from loanlens.operators import train as TR
    together, fit, start = Barrier(2, timeout=60), TR.fit_model, TR.Training.start
    waited = []

    def logistic(*a, **k):
        if not waited:
            waited.append(1)
            together.wait()
        return fit(*a, **k)
    monkeypatch.setattr(TR, "fit_model", logistic)
    monkeypatch.setattr(TR.Training, "start", lambda *a, **k: (together.wait(), start(*a, **k))[1])
    df = table.withColumn("fold", F.pmod("app_id", F.lit(2)))
    rows = TR.cross_validate(df, ["logreg", "gbt"], 2, gbt_iter=2).collect()
    assert [(r["model"], r["fold"]) for r in rows] == [("logreg", 0), ("logreg", 1), ("gbt", 0), ("gbt", 1)]


def test_small_features_are_counted_together(monkeypatch):
    """Nine of two bins and one of five: three joint counts, and the sums of counting each alone."""
    rng = np.random.default_rng(3)
    wide = np.array([2] * 5 + [30] + [2] * 4 + [5])
    n = 4000
    x = np.stack([rng.integers(0, w, n) for w in wide]).astype(np.uint8)
    block = boosting.Scored(rng.integers(0, 2, n).astype(np.uint8), np.full(n, -1), np.arange(n).astype(np.uint64), x, rng.normal(size=(1, n)))

    def evidence(b, fits):
        return np.ones((1, n), bool), *boosting.derivatives(b.margin[fits], b.y, 2.5)
    top, columns, counts, count = grow.Nodes.leaves(np.arange(1), None, np.zeros(1), np.zeros(1)), grow._columns(wide, None), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: (counts.append(1), count(*a, **k))[1])
    got = grow._bin_sums(block, evidence, top, np.arange(1), columns)
    together = len(counts)
    monkeypatch.setattr(grow, "JOINT", 0)
    want = grow._bin_sums(block, evidence, top, np.arange(1), columns)
    assert (got == want).all() and together == 2 * 4 and len(counts) == 2 * (4 + 11)


def test_a_single_boosting_fit_has_few_tasks(spark, table, monkeypatch):
    monkeypatch.setattr(boosting, "PART", 1 << 8)
    monkeypatch.setattr(boosting, "WIDE", 1 << 12)
    monkeypatch.setattr(boosting, "PASSES", 1000)
    monkeypatch.setattr("pyspark.SparkContext.defaultParallelism", 1)
    parts = []
    for fits in (1, 4):
        t = boosting.Training.start(table, [boosting.Setting()] * fits, key="app_id")
        parts.append(t.binned.parts)
        t.close()
    assert parts == [1, 3]


def test_passes_have_as_many_tasks_on_every_core(spark, table):
    """One task more than there are cores would leave all but one of them idle in the second half of each pass."""
    cores = spark.sparkContext.defaultParallelism
    assert [trees.even_tasks(p, 6) for p in (1, 6, 7, 9, 12, 13)] == [1, 6, 12, 12, 12, 18]
    binned = trees.Binned.write(table, key="app_id", work=10_000, part=-(-3000 // (cores + 1)))
    assert binned.parts > cores and binned.parts % cores == 0
    assert sum(binned.blocks().map(lambda b: len(b.y)).collect()) == 3000
    binned.delete()


def test_records_are_sent_with_a_bit_for_a_feature_of_two_bins(spark, table, monkeypatch):
    rng = np.random.default_rng(2)
    for bins in ([5, 2, 1, 32, *[2] * 28], [2, 2], [7, 3], [1]):
        bins = np.array(bins)
        x = rng.integers(0, bins, (50, len(bins))).astype(np.uint8)
        sent = grow.squeezed(x, bins)
        assert (grow.widened(sent, bins) == x).all() and (grow.widened(sent[:0], bins) == x[:0]).all()
        assert sent.shape[1] == (bins > 2).sum() + -(-(bins <= 2).sum() // 8)
    from loanlens.operators.forest import Forest, forest_importances
    want = forest_importances(table, Forest(3, 6), key="app_id")
    monkeypatch.setattr(grow, "squeezed", lambda x, bins: x)
    monkeypatch.setattr(grow, "widened", lambda x, bins: x)
    assert (forest_importances(table, Forest(3, 6), key="app_id") == want).all()
