"""Boosting and forests: brute force, joint and separate fits, prefixes, small and large nodes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loanlens.operators import boosting as B
from loanlens.operators import forest as R
from loanlens.operators import grow as G
from loanlens.operators import train as TR
from loanlens.operators.trees import Binned, TreesModel
from loanlens.plans.modeling import prepare


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 5))
    x[:, 3] = x[:, 3] > 0.5
    x[:, 4] = np.round(x[:, 4])
    y = (x[:, 0] + x[:, 3] * x[:, 1] + rng.normal(0, 0.7, 900) > 0.6).astype(int)
    rows = [(i, int(v), int(i % 3), r.tolist()) for i, (v, r) in enumerate(zip(y, x, strict=True))]
    df = spark.createDataFrame(rows, "app_id long, label int, fold int, a array<double>")
    return df.select("app_id", "label", "fold", array_to_vector("a").alias("features")).repartition(5)


def records(df):
    rows = df.orderBy("app_id").collect()
    return np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])


def brute_boosting(x, y, edges, rounds, depth, eta, l2=1.0, least=1.0):
    """Margins after ``rounds`` rounds, node by node and split by split."""
    weight = (y == 0).sum() / (y == 1).sum()
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.zeros(len(y), np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin.astype(np.float64)))
        w = np.where(y == 1, weight, 1.0) * 2.0 ** 20
        g, h = np.rint(w * (p - y)), np.maximum(np.rint(w * p * (1 - p)), 1)
        out = np.zeros(len(y), np.float32)

        def node(at, level, g=g, h=h, out=out):
            a, b = g[at].sum(), h[at].sum()
            best = (1e-6, None)
            for j in range(x.shape[1]) if level < depth else ():
                for c in range(len(edges[j])):
                    left = bins[at, j] <= c
                    la, lb = g[at][left].sum() / 2 ** 20, h[at][left].sum() / 2 ** 20
                    ra, rb, ta, tb = a / 2 ** 20 - la, b / 2 ** 20 - lb, a / 2 ** 20, b / 2 ** 20
                    gain = la * la / (lb + l2) + ra * ra / (rb + l2) - ta * ta / (tb + l2)
                    if lb >= least and rb >= least and gain > best[0]:
                        best = (gain, (j, c))
            if best[1] is None:
                out[at] = np.float32(-eta * a / (b + l2 * 2 ** 20))
                return
            j, c = best[1]
            node(at[bins[at, j] <= c], level + 1)
            node(at[bins[at, j] > c], level + 1)
        node(np.arange(len(y)), 0)
        margin += out
    return margin


def test_boosting_equals_brute_force(spark, table):
    x, y = records(table)
    t = B.Training.start(table, [B.Setting(4, 0.3)], key="app_id").run(4)
    want = brute_boosting(x, y, t.binned.edges, 4, 4, 0.3)
    assert np.array_equal(t.model(0).total(x), want.astype(np.float64))
    t.close()


def test_boosting_equals_brute_force_on_applications(spark, sf):
    train = prepare(spark, sf).train
    x, y = records(train)
    t = B.Training.start(train, [B.Setting(3, 0.3)], key="app_id").run(2)
    got, want = t.model(0).total(x), brute_boosting(x, y, t.binned.edges, 2, 3, 0.3)
    assert np.array_equal(got, want.astype(np.float64)) and len(np.unique(got)) > 8
    t.close()


def same_tree(a, b):
    return all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "threshold", "left", "value"))


def test_prefix_joint_and_separate_fits_agree(spark, table):
    settings = [B.Setting(d, e, s, f) for d, e, s in ((3, 0.1, 0.8), (4, 0.3, 1.0)) for f in (None, 0, 2)]
    joint = B.Training.start(table, settings, fold="fold", key="app_id").run(3)
    early = joint.held_out_counts()
    joint.run(7)
    for i, s in enumerate(settings):
        alone = B.Training.start(table.repartition(2), [s], fold="fold", key="app_id").run(3)
        assert alone.held_out_counts()[0] == early[i]
        alone.run(7)
        assert alone.held_out_counts()[0] == joint.held_out_counts()[i]
        if s.fold is None:
            assert len(joint.trees[i]) == 7 and all(map(same_tree, alone.trees[0], joint.trees[i]))
            assert all(map(same_tree, joint.model(i, 3).trees, alone.trees[0][:3]))
        alone.close()
    joint.close()


@pytest.mark.parametrize("local", [1, 30, 200])
def test_large_nodes_by_passes_give_the_same_trees(spark, table, monkeypatch, local):
    x, _ = records(table)

    def fits():
        t = B.Training.start(table, [B.Setting(4, 0.3, 0.9), B.Setting(2, 0.5)], key="app_id").run(2)
        out = [t.model(0).total(x), t.model(1).total(x)]
        t.close()
        forest = R.fit_forest(table, R.Forest(4, 8, 2), key="app_id")
        return [*out, forest.total(x)], forest.featureImportances.toArray()
    want, importance = fits()
    monkeypatch.setattr(G, "LOCAL", local)
    monkeypatch.setattr(G, "BATCH", 100)
    got, again = fits()
    assert all(np.array_equal(g, w) for g, w in zip(got, want, strict=True)) and np.allclose(importance, again)


def test_checkpoints_between_rounds_change_nothing(spark, table, monkeypatch):
    x, _ = records(table)
    whole = B.Training.start(table, [B.Setting(3)], key="app_id").run(6)
    monkeypatch.setattr(B, "CUT", 2)
    cut = B.Training.start(table, [B.Setting(3)], key="app_id").run(6)
    assert np.array_equal(cut.model().total(x), whole.model().total(x)) and len(cut._files) == 1
    whole.close(), cut.close()


def test_forest_of_fewer_trees_or_levels_is_part_of_the_larger_one(spark, table):
    binned = Binned.write(table, fold="fold", key="app_id")
    blocks = binned.blocks().persist()
    large = R.Forest(9, 12, 2, fold=1).grow(blocks, binned)
    part = large.held_out_counts(blocks, [2, 5, 12], [3, 9])
    for (depth, trees), counts in part.items():
        own = R.Forest(trees, depth, 2, fold=1).grow(blocks, binned)
        assert own.held_out_counts(blocks, [depth], [trees])[depth, trees] == counts
    assert sum(part[2, 3]) == table.where("fold = 1").count()
    scores = large.held_out_scores(spark, blocks).collect()
    tp = sum(1 for r in scores if r["label"] == 1 and r["score"] >= 0.5)
    assert tp == part[12, 9][0]
    blocks.unpersist()


def test_forest_leaves_hold_the_weighted_class_shares(spark, table):
    x, y = records(table)
    m = R.fit_forest(table, R.Forest(30, 30, 1), key="app_id")
    p = m.total(x) / 30
    assert 0 <= p.min() and p.max() <= 1 and ((p >= 0.5) == (y == 1)).mean() > 0.95     # its own records
    assert R.fit_forest(table, R.Forest(3, 30, 200), key="app_id").trees[0].depth <= 3
    top = m.featureImportances.toArray()
    assert top.sum() == pytest.approx(1) and top.argmax() == 0
    grown, _ = R.grow_forest(table, R.Forest(30, 30, 1), key="app_id")
    assert np.allclose(grown.importances(5), top)


def test_models_round_trip_and_nan_goes_right(spark, table, tmp_path):
    for kind in ("gbt", "forest"):
        fm = TR.fit_model(kind, table, gbt_iter=2, num_trees=3)
        path = f"{tmp_path}/{kind}"
        TR.save_model([fm.model], path)
        back = TR.load_model(path).stages[0]
        x, _ = records(table)
        x[::7] = np.nan
        assert isinstance(back, TreesModel) and np.array_equal(back.total(x), fm.model.total(x))
        out = fm.predict(table).select("probability_default")
        lo, hi = out.agg(F.min("probability_default"), F.max("probability_default")).head()
        assert 0 <= lo < hi <= 1


def test_tables_without_one_class_or_without_rows(spark, table):
    one = table.where("label = 0")
    assert TR.fit_model("gbt", one, gbt_iter=2).model.total(records(one)[0]).max() < 0
    assert R.fit_forest(one, R.Forest(2)).total(records(one)[0]).max() == 0
    none = table.where("label = 7")
    assert B.Training.start(none, [B.Setting()]).run(1).model().total(np.zeros((2, 0))).tolist() == [0, 0]


def test_grid_search_reports_every_setting(spark, table):
    grid = {"maxIter": [2, 4], "maxDepth": [2, 3], "stepSize": [0.3], "subsamplingRate": [0.8, 1.0]}
    model, rows = TR.grid_search(table, "gbt", grid, refit=True)
    assert len(rows) == 8 and len({r[1] for r in rows}) == 8 and model.kind == "gbt"
    best = max(rows, key=lambda r: r[2])
    assert f"maxIter={len(model.model.trees)}" in best[1]
    # each row is the mean recall of fits of that setting alone
    for _, params, recall in rows[:3]:
        p = dict(kv.split("=") for kv in params.split(";"))
        t = B.Training.start(table, [B.Setting(int(p["maxDepth"]), float(p["stepSize"]), float(p["subsamplingRate"]), f) for f in range(3)],
                             fold="fold", key="app_id").run(int(p["maxIter"]))
        assert recall == pytest.approx(np.mean([c[0] / (c[0] + c[3]) for c in t.held_out_counts()]))
        t.close()
    none, rows = TR.grid_search(table, "forest", {"numTrees": [2, 3], "maxDepth": [3, 5], "minInstancesPerNode": [1, 4]})
    assert none is None and len(rows) == 8 and all(0 <= r[2] <= 1 for r in rows)


def test_cross_validation_covers_models_and_folds(spark, table):
    rows = TR.cross_validate(table, ["gbt", "forest"], 3, num_trees=5, gbt_iter=5).collect()
    assert {(r["model"], r["fold"]) for r in rows} == {(m, f) for m in ("gbt", "forest") for f in range(3)}
    assert all(0.6 < r["roc_auc"] <= 1 for r in rows)


@pytest.mark.parametrize("local", [1, 1 << 16])
def test_importances_leave_the_trees_in_their_tasks(spark, table, monkeypatch, local):
    forest = R.Forest(20, 30, 1, balanced=False)
    want = R.grow_forest(table, forest, key="app_id")[0].importances(5)
    monkeypatch.setattr(G, "LOCAL", local)
    monkeypatch.setattr(G, "_attached", lambda *_: pytest.fail("trees on the driver"))
    assert np.allclose(R.forest_importances(table, forest, key="app_id"), want, rtol=1e-12)


def test_filled_bins_split_as_all_bins():
    rng = np.random.default_rng(5)
    bins = np.array([7, 2, 5, 1, 3])
    x = np.stack([rng.integers(0, w, 300) for w in bins], 1).astype(np.uint8)
    y, copies = rng.integers(0, 2, 300), rng.integers(1, 4, 300)
    rule = G.Rule("gini", np.array([9]), np.array([2.0]), np.ones(1), np.array([[0.7, 1.9]]), np.array([11], np.uint64), 3)
    got = G.grow_local(x, np.zeros(300, int), copies * (y == 0.0), copies * (y == 1.0), rule.key, rule.depth, rule, bins)
    at, deep = got.walk(np.ascontiguousarray(x.T), np.array([0])), 0
    for node in np.flatnonzero(got.feature >= 0).tolist():
        picks, best, root = rule.picks(got.key[[node]], 5)[0], G.Best(1), np.array([0])
        mine = np.flatnonzero([node in path(got, r) for r in x])
        for j in picks.tolist():
            ha, hb = (np.bincount(x[mine, j], copies[mine] * (y[mine] == c), bins[j])[None] for c in (0, 1))
            best.consider(rule, root, j, ha, hb, got.a[[node]], got.b[[node]])
        assert (best.feature[0], best.cut[0], best.gain[0]) == (got.feature[node], got.cut[node], got.gain[node])
        deep += 1
    assert deep > 20 and (got.feature[at] < 0).all()


def path(nodes, record):
    k, out = 0, {0}
    while nodes.feature[k] >= 0:
        k = int(nodes.left[k] + (record[nodes.feature[k]] > nodes.cut[k]))
        out.add(k)
    return out
