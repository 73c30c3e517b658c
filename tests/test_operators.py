"""Unit tests: golden rows (serving record mutations, drift pairs), bins,
encoder round trip, global ranks, split/fold invariants, metric bounds."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanlens.operators import drift as D
from loanlens.operators import encode as EN
from loanlens.operators import evaluate as EV
from loanlens.operators import rules as R
from loanlens.operators.features import derive_features
from loanlens.operators.ranks import ranked, score_bucket
from loanlens.operators.split import stratified_folds, stratified_split
from loanlens.plans.base import clean, scored


# ------------------------------------------------------------------ rules

@pytest.mark.parametrize("mutation,rule", [
    ({"person_income": -1000.0}, "person_income:range"),
    ({"person_home_ownership": "INVALID"}, "person_home_ownership:domain"),
    ({"loan_intent": "INVALID"}, "loan_intent:domain"),
    ({"loan_grade": "H"}, "loan_grade:domain"),
    ({"person_age": 15}, "person_age:range"),
    ({"person_age": 17}, "person_age:range"),
    ({"person_age": 110}, "person_age:range"),
    ({"person_age": 101}, "person_age:range"),
    ({"loan_amnt": 100.0}, "loan_amnt:range"),
    ({"loan_amnt": 150000.0}, "loan_amnt:range"),
    ({"cb_person_default_on_file": 2}, "cb_person_default_on_file:domain"),
    ({"person_age": None}, "missing:person_age"),
])
def test_rule_violations(records, mutation, rule):
    v = R.with_violations(records(mutation)).select("violations").head()[0]
    assert rule in v


def test_sample_and_zero_income_are_valid(records):
    v = R.with_violations(records({}, {"person_income": 0.0})).select(F.size("violations")).collect()
    assert [r[0] for r in v] == [0, 0]


@pytest.mark.parametrize("mutation", [{"loan_int_rate": 1.5}, {"loan_percent_income": 1.5}])
def test_api_profile_limits(records, mutation):
    v = R.with_violations(records(mutation), "api").select("violations").head()[0]
    assert v, "API schema rejects share > 1"


def test_batch_fails_as_a_whole(records):
    df = records({}, {"person_age": 15})
    with pytest.raises(ValueError, match="record 1"):
        R.assert_valid(df)
    assert R.assert_valid(records({}, {})) is not None


def test_empty_batch_gives_empty_result(records, spark):
    empty = records({}).where(F.lit(False))
    ok, bad = R.split_valid(empty)
    assert ok.count() == 0 and bad.count() == 0


# ------------------------------------------------------------------ derived features

def test_bins_are_right_closed(spark):
    df = spark.createDataFrame(
        [(18, 0.0, 1000.0, "Y"), (25, 1.5, 0.0, "N"), (26, None, 10.0, "X"), (70, 123.0, 5.0, "Y")],
        "person_age int, person_emp_length double, person_income double, cb_person_default_on_file string"
    ).withColumn("loan_amnt", F.lit(100.0))
    out = derive_features(df, "train").collect()
    assert [r.age_bucket for r in out] == [None, "18-24", "25-34", "65+"]
    assert [r.emp_length_bin for r in out] == ["0", "2-3", "0", None]
    assert [r.default_flag for r in out] == [1, 0, 0, 1]
    assert out[1].loan_to_income is None  # zero income -> null in training
    serve = derive_features(df.withColumn("cb_person_default_on_file", F.lit(1)), "serve").collect()
    assert serve[1].loan_to_income == pytest.approx(100.0 / 0.01)


# ------------------------------------------------------------------ encoder

def test_encoder_fit_transform_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (5.0, None)], "x double, c string")
    enc = EN.FittedEncoder.fit(df, ["x"], ["c"])
    assert enc.medians["x"] == 3.0 and enc.modes["c"] == "b" and enc.categories["c"] == ["a", "b"]
    out = enc.transform(df).collect()
    assert [r["c_b"] for r in out] == [0.0, 1.0, 1.0, 1.0]  # null -> mode
    import statistics
    xs = [1.0, 3.0, 3.0, 5.0]
    assert out[0]["x"] == pytest.approx((1.0 - 3.0) / statistics.pstdev(xs))
    unknown = enc.transform(spark.createDataFrame([(1.0, "zzz")], "x double, c string")).head()
    assert unknown["c_a"] == 0.0 and unknown["c_b"] == 0.0
    path = str(tmp_path / "enc")
    enc.save(spark, path)
    enc2 = EN.FittedEncoder.load(spark, path)
    assert enc2.output_names == enc.output_names and enc2.means == enc.means


def test_correlation_drop_follows_column_order(spark):
    df = spark.createDataFrame([(float(i), float(2 * i), float((i * 7) % 5)) for i in range(20)], "a double, b double, c double")
    assert EN.correlation_drop(df, ["a", "b", "c"]) == ["b"]
    assert EN.correlation_drop(df, ["b", "a", "c"]) == ["a"]


# ------------------------------------------------------------------ ranks, split, folds

def test_bucketed_rank_equals_global_window(spark):
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), (((F.col("id") * 7919) % 1000) / 1000.0).alias("s"),
                                     F.col("id"))
    a = ranked(df, ["g"], score_bucket("s", 64), [F.col("s"), F.col("id")], "rk")
    b = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("s", "id")))
    j = a.join(b, ["g", "id"])
    assert j.where(F.col("rk") != F.col("rk2")).count() == 0


def test_split_sizes_exact_and_folds_cover_rows(spark, sf):
    df = clean(spark, sf)
    sp = stratified_split(df)
    counts = {(r.loan_status, r.split): r["count"] for r in sp.groupBy("loan_status", "split").count().collect()}
    import math
    for cls in (0, 1):
        n = counts.get((cls, "train"), 0) + counts.get((cls, "test"), 0)
        assert counts[(cls, "test")] == math.ceil(n * 0.2)
    folds = stratified_folds(df)
    assert folds.count() == df.count()
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2


# ------------------------------------------------------------------ evaluation

def test_metric_bounds_and_auc_agreement(spark, sf):
    s = scored(spark, sf)
    auc = EV.roc_auc(s).head()[0]
    trap = EV.auc_trapezoid(EV.roc_curve(s)).head()[0]
    assert 0.0 <= auc <= 1.0 and auc == pytest.approx(trap, abs=1e-9)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert auc == pytest.approx(ev.evaluate(s.withColumn("label", F.col("label").cast("double"))), abs=1e-9)
    sw = EV.threshold_sweep(s).orderBy("idx").collect()
    assert len(sw) == 16 and sw[9].threshold == 0.55
    assert all(0 <= r.f1 <= 1 for r in sw)


# ------------------------------------------------------------------ drift golden pairs

def _pair(spark, target):
    ref = spark.createDataFrame([(0, 0.2), (1, 0.6), (0, 0.3), (1, 0.8)], f"{target} int, score double")
    cur = spark.createDataFrame([(0, 0.25), (1, 0.55), (1, 0.7), (1, 0.9)], f"{target} int, score double")
    return ref, cur


@pytest.mark.parametrize("target", ["default", "default_flag"])
def test_drift_golden_pairs(spark, target):
    ref, cur = _pair(spark, target)
    t = D.resolve_target(ref, cur, "default")
    assert t == target
    ov = D.drift_overview(ref, cur).head()
    assert (ov.reference_rows, ov.current_rows) == (4, 4)
    td = D.target_drift(ref, cur, t).head()
    assert td.reference_rate == 0.5 and td.current_rate == 0.75 and td.rate_change == pytest.approx(0.25)
    ms = D.mean_shift(ref, cur, ["score"]).head()
    assert ms.reference_mean == pytest.approx(0.475) and ms.current_mean == pytest.approx(0.6)
    assert ms.mean_shift == pytest.approx(0.125)
    html = D.report_html(ref, cur, "default")
    assert "Monitoring summary" in html and "Target drift" in html


def test_psi_zero_on_identical_sides(spark, sf):
    df = clean(spark, sf)
    psi = D.psi_drift(df, df, ["loan_int_rate", "person_income"]).collect()
    assert all(abs(r.psi) < 1e-12 for r in psi)
    ks = D.ks_drift(df, df, ["person_income"]).head()
    assert ks.ks_stat == 0.0 and ks.p_value == 1.0


def test_distributed_quantiles_equal_percentile(spark, sf):
    from loanlens.operators.quantiles import quantiles_long
    from loanlens.plans.base import feat
    df = feat(spark, sf)
    cols, ps = ["person_income", "loan_to_income", "loan_int_rate"], [0.1, 0.25, 0.5, 0.9]
    got = {(r.feature, r.p): r.value for r in quantiles_long(df, cols, ps).collect()}
    ref = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in ps])).alias(c) for c in cols]).head()
    for c in cols:
        for i, p in enumerate(ps):
            assert got[(c, p)] == pytest.approx(ref[c][i], rel=1e-12)


def test_csv_roundtrip_and_report_files(spark, sf):
    import uuid
    from loanlens.plans.base import apps
    from loanlens.session import scratch_path
    from loanlens.sources.io import write_table
    from loanlens.sources.tables import read_applications_csv
    base = scratch_path(spark, "io-" + uuid.uuid4().hex[:8])
    a = apps(spark, sf)
    write_table(a, base + "/csv", "csv")
    back = read_applications_csv(spark, base + "/csv")
    assert back.count() == a.count() and back.columns == a.columns
    assert back.exceptAll(a).count() == 0
    ref, cur = _pair(spark, "default")
    D.write_report(ref, cur, base + "/report")
    html = "\n".join(r.value for r in spark.read.text(base + "/report/monitoring_report.html").collect())
    assert "Monitoring summary" in html and "Target drift" in html
    assert spark.read.parquet(base + "/report/drift_summary").count() == 1


def test_top_k_equals_global_window(spark):
    from loanlens.operators.ranks import top_k
    df = spark.range(0, 5000).select((F.col("id") % 4).alias("g"), (F.col("id") % 97).cast("string").alias("v"),
                                     ((F.col("id") * 31) % 113).alias("n"))
    order = [F.desc("n"), F.asc("v")]
    a = top_k(df, ["g"], order, 3, "v", salt=16).select("g", "v", "n", "rank")
    w = Window.partitionBy("g").orderBy(*order)
    b = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3).select("g", "v", "n", "rank")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cumulative_equals_global_running_sum(spark):
    from loanlens.operators.ranks import cumulative
    df = spark.range(0, 2000).select((((F.col("id") * 7919) % 2000) / 2000.0).alias("s"), (F.col("id") % 3).alias("x"))
    a = cumulative(df, score_bucket("s", 32), [F.col("s")], ["x"]).select("s", "x_cum")
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    b = df.select("s", F.sum("x").over(w).alias("x_cum"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_grouped_distributed_quantiles(spark, sf):
    from loanlens.operators.quantiles import quantiles_long
    df = clean(spark, sf)
    got = {(r.loan_status, r.p): r.value for r in quantiles_long(df, ["person_income"], [0.25, 0.5], ["loan_status"]).collect()}
    ref = df.groupBy("loan_status").agg(F.percentile("person_income", F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect()
    for r in ref:
        assert got[(r.loan_status, 0.25)] == pytest.approx(r.q[0]) and got[(r.loan_status, 0.5)] == pytest.approx(r.q[1])


def test_envelopes_are_bounded_and_lossless(spark, sf):
    from loanlens.plans.base import apps
    from loanlens.sources.batches import explode_envelopes, to_envelopes
    a = apps(spark, sf)
    for by in ("key", "position"):
        env = to_envelopes(a, by=by)
        assert env.select(F.max(F.size("applications"))).head()[0] <= 100
        assert explode_envelopes(env).count() == a.count()


def test_json_envelopes_roundtrip(spark, sf):
    import uuid
    from loanlens.plans.base import apps
    from loanlens.session import scratch_path
    from loanlens.sources.batches import explode_envelopes, read_envelopes_json, to_envelopes
    path = scratch_path(spark, "env-" + uuid.uuid4().hex[:8])
    a = apps(spark, sf)
    to_envelopes(a).select("applications").write.json(path)
    back = explode_envelopes(read_envelopes_json(spark, path))
    assert back.count() == a.count()
    assert back.select("app_id").distinct().count() == a.count()


def test_target_resolution_fallback_and_binary_check(spark):
    ref = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.7)], "name string, grade int, score double")
    cur = spark.createDataFrame([("c", 2, 0.1)], "name string, grade int, score double")
    assert D.resolve_target(ref, cur, "default") == "grade"  # first integer column in both
    td = D.target_drift(ref, cur, "grade")
    with pytest.raises(ValueError, match="outside 0/1"):
        D.check_binary_target(td)
    assert D.check_binary_target(td, cast="truncate") is td
    with pytest.raises(ValueError):
        D.resolve_target(ref.select("name"), cur.select("name"), "default")


def test_report_text_of_golden_pair(spark):
    ref, cur = _pair(spark, "default")
    html = D.report_html(ref, cur, "default")
    assert "<td>4</td><td>4</td>" in html                                     # rows by side
    assert "<td>0.5</td><td>0.75</td><td>0.25</td><td>0</td>" in html         # target rates and their change
    assert "<td>score</td><td>0.475</td><td>0.6</td><td>0.125</td>" in html   # mean shift
    assert {"psi", "mean_shift", "rate_change"} <= set(__import__("re").findall("<th>(.*?)</th>", html))


def test_corr_matrix_pairwise_complete_with_nulls(spark):
    import numpy as np
    from loanlens.operators.profile import corr_matrix
    rows = [(float(i), (float(i * i % 7) if i % 4 else None), float((i * 3) % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in corr_matrix(df, ["a", "b", "c"]).collect()}
    def pair(x, y):
        m = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
        return float(np.corrcoef([p for p, _ in m], [q for _, q in m])[0, 1])
    cols = list(zip(*rows))
    assert got[("a", "b")] == pytest.approx(pair(cols[0], cols[1]))
    assert got[("b", "c")] == pytest.approx(pair(cols[1], cols[2]))
    assert got[("a", "c")] == pytest.approx(pair(cols[0], cols[2]))


def test_trapezoid_on_arbitrary_points(spark):
    pts = spark.createDataFrame([(float(x), float(x) ** 2) for x in range(-50, 51)], "fpr double, tpr double")
    area = EV.auc_trapezoid(pts).head()[0]
    import numpy as np
    xs = np.arange(-50, 51, dtype=float)
    assert area == pytest.approx(float(np.trapezoid(xs ** 2, xs)))


def test_registered_tuning_has_the_reference_sizes(monkeypatch):
    import inspect
    from types import SimpleNamespace

    from loanlens.operators import train as TR
    from loanlens.plans import offline, q_models
    seen = {}

    class Frame:
        def select(self, *_):
            return self

    class Session:
        def createDataFrame(self, rows, schema):
            return rows

    def prepare(spark, d, fit_on="train", k=5, importance=True):
        seen["folds"] = k
        return SimpleNamespace(data=Frame(), train=Frame())

    def cross_validate(df, kinds, k, num_trees=100, gbt_iter=100):
        seen["cv"] = (tuple(kinds), k, num_trees, gbt_iter)

    monkeypatch.setattr(q_models, "prepare", prepare)
    monkeypatch.setattr(TR, "grid_search", lambda df, kind, grid: (None, [(kind, grid)]))
    monkeypatch.setattr(TR, "cross_validate", cross_validate)
    monkeypatch.setattr(TR, "cv_summary", lambda per_fold: per_fold)
    assert dict(q_models.grid_search(Session(), "")) == TR.REFERENCE_GRIDS and seen["folds"] == 5
    q_models.cv_summary(Session(), "")
    assert seen["cv"] == (TR.MODELS, 5, 100, 100)
    fit = inspect.signature(TR.fit_model).parameters
    assert fit["num_trees"].default == fit["gbt_iter"].default == 100
    run = inspect.signature(offline.train_and_select).parameters
    assert run["full_grid"].default is True and run["k"].default == 5
    assert run["num_trees"].default == run["gbt_iter"].default == 100


def test_correlated_pairs_are_pairwise_complete_at_any_width(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 18))
    x[:, 17] = x[:, 2] * 3 + 0.2 * x[:, 3] + 1e6
    x[:, 16] = 0.1
    pdf = pd.DataFrame(x, columns=[f"f.{i}" for i in range(18)]).mask(rng.random((400, 18)) < 0.1)
    df = spark.createDataFrame([[None if v != v else float(v) for v in r] for r in pdf.to_numpy()], list(pdf.columns))
    for k in (3, 18):
        names = list(pdf.columns)[-k:]
        r = pdf[names].corr().abs().to_numpy()
        want = {(names[i], names[j]): r[i, j] for i in range(k) for j in range(i + 1, k) if r[i, j] > 0.05}
        got = {(p["a"], p["b"]): p["abs_r"] for p in EN.correlated_pairs(df.repartition(5), names, 0.05).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert EN.correlated_pairs(df.limit(0), list(pdf.columns)).count() == 0
    assert EN.correlated_pairs(df, ["f.1"]).count() == 0


def test_encoder_has_no_category_limit_by_default(spark):
    df = spark.range(1100).selectExpr("CAST(id AS STRING) AS c")
    enc = EN.FittedEncoder.fit(df, [], ["c"])
    assert len(enc.output_names) == 1100
    with pytest.raises(ValueError, match="too many categories"):
        EN.FittedEncoder.fit(df, [], ["c"], max_categories=1000)


def test_forests_grow_below_depth_12(spark):
    import inspect

    import numpy as np
    from pyspark.ml.linalg import Vectors

    from loanlens.operators import train as TR
    assert inspect.signature(EN.importance_filter).parameters["max_depth"].default == 30
    rng = np.random.default_rng(5)
    rows = [(float(rng.random() < 0.5), Vectors.dense(rng.normal(size=4))) for _ in range(1500)]
    m = TR.fit_model("forest", spark.createDataFrame(rows, ["label", "features"]), num_trees=2)
    assert max(t.depth for t in m.model.trees) > 12
