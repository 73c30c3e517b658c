"""Skew: one value / key / class holds a third (or more) of all rows.

The operators must stay exact and must not put the hot group into one task.
"""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loanlens.operators import evaluate as EV
from loanlens.operators.quantiles import quantiles_long
from loanlens.operators.ranks import CUTS, cut_bucket, md5_bucket, md5_order_key, sketch_cuts, top_k
from loanlens.operators.split import class_counts, stratified_split, with_weights

N = 30000


@pytest.fixture(scope="module")
def skewed(spark):
    # a third of the rows share value 5.0, key 7, score 0.5; class 0 holds two thirds
    return spark.range(N).select(
        F.col("id").alias("app_id"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise((F.col("id") * 7919 % 10007) / 100.0).alias("value"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("hot_key"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise((F.col("id") * 31 % 997) / 997.0).alias("score"),
        F.when(F.col("id") % 3 == 1, F.lit(1)).otherwise(F.lit(0)).alias("label"))


def test_quantiles_exact_with_a_hot_value(skewed):
    ps = [0.1, 1 / 3, 0.5, 0.9]
    got = {r.p: r.value for r in quantiles_long(skewed, ["value"], ps).collect()}
    ref = skewed.agg(F.percentile("value", F.array(*[F.lit(p) for p in ps]))).head()[0]
    assert [got[p] for p in ps] == pytest.approx(ref)


def test_top_k_with_a_hot_value(skewed):
    g = skewed.groupBy("hot_key").agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.lit(1))
    order = [F.desc("n"), F.asc("hot_key")]
    a = top_k(g, ["grp"], order, 3, "hot_key").select("hot_key", "n").collect()
    b = g.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(*order))) \
         .where(F.col("r") <= 3).select("hot_key", "n").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert max(a, key=lambda r: r.n).hot_key == 7  # the hot key (a third of the rows) ranks first


def test_split_exact_and_hot_class_spread_over_buckets(skewed):
    sizes = {r["label"]: r["n"] for r in class_counts(skewed, "label").collect()}
    sp = stratified_split(skewed, key="app_id", label="label")
    got = {(r.label, r.split): r["count"] for r in sp.groupBy("label", "split").count().collect()}
    import math
    for c, n in sizes.items():
        assert got[(c, "test")] == math.ceil(n * 0.2)
    # the ranking window partitions by (class, md5 bucket): the hot class spreads
    b = skewed.withColumn("_o", md5_order_key("app_id")).withColumn("_bk", md5_bucket("_o", 3))
    biggest = b.groupBy("label", "_bk").count().agg(F.max("count")).head()[0]
    assert biggest < N / 100


def test_roc_auc_with_a_hot_score(skewed):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    auc = EV.roc_auc(skewed).head()[0]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert auc == pytest.approx(ev.evaluate(skewed.withColumn("label", F.col("label").cast("double"))), abs=1e-9)


def test_envelopes_bounded_with_a_hot_key(spark, skewed):
    from loanlens.sources import batches as B
    recs = skewed.select(F.col("hot_key").alias("app_id"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("person_age", "int"), ("person_income", "double"), ("person_home_ownership", "string"),
        ("person_emp_length", "double"), ("loan_intent", "string"), ("loan_grade", "string"),
        ("loan_amnt", "double"), ("loan_int_rate", "double"), ("loan_percent_income", "double"),
        ("cb_person_default_on_file", "string"), ("cb_person_cred_hist_length", "int"))])
    env = B.to_envelopes(recs, by="position")
    assert env.select(F.max(F.size("applications"))).head()[0] <= 100
    assert B.explode_envelopes(env).count() == N


def test_roc_auc_with_scores_outside_unit_interval(skewed):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    margins = skewed.withColumn("score", (F.col("score") - 0.5) * 100.0)  # raw margins in [-50, 50]
    auc = EV.roc_auc(margins).head()[0]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert auc == pytest.approx(ev.evaluate(margins.withColumn("label", F.col("label").cast("double"))), abs=1e-9)
    ap = EV.average_precision(margins).head()[0]
    assert 0.0 <= ap <= 1.0


@pytest.mark.parametrize("shape", ["outlier", "crowded", "nulls"])
def test_sketch_cuts_spread_any_distribution(spark, shape):
    v = F.col("id") * 1.0
    value = {"outlier": F.when(F.col("id") == 0, 1e12).otherwise(v),
             "crowded": F.when(F.col("id") % 10 > 0, 0.5 + v * 1e-12).otherwise(v),
             "nulls": F.when(F.col("id") > 0, v)}[shape]
    h = spark.range(N).select(value.cast("double").alias("v")).unionByName(
        spark.createDataFrame([(float("nan"),), (float("-inf"),)], "v double"))
    b = h.crossJoin(sketch_cuts(h, "v")).select("v", cut_bucket("v").alias("b"), cut_bucket("v", descending=True).alias("d"))
    assert b.groupBy("b").count().agg(F.max("count")).head()[0] <= 3 * N / (CUTS + 1)
    rows = b.orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and all(r.b + r.d == CUTS for r in rows)
    assert rows[0].b == 0 and rows[-1].b == CUTS


def test_curves_and_distances_with_an_outlier(spark, skewed):
    from loanlens.operators import drift as D
    far = skewed.withColumn("score", F.when(F.col("app_id") == 1, 1e12).otherwise(F.col("score")))
    rows = far.select("label", "score").collect()
    pos, neg = sorted(r.score for r in rows if r.label == 1), [r.score for r in rows if r.label == 0]
    from bisect import bisect_left, bisect_right
    won = sum((len(pos) - bisect_right(pos, s)) + (bisect_right(pos, s) - bisect_left(pos, s)) / 2 for s in neg)
    assert EV.roc_auc(far).head()[0] == pytest.approx(won / len(pos) / len(neg), abs=1e-9)
    assert EV.auc_trapezoid(EV.roc_curve(far)).head()[0] == pytest.approx(won / len(pos) / len(neg), abs=1e-9)
    ref, cur = far.where("label = 0"), far.where("label = 1")
    both = sorted(pos + neg)
    sn = sorted(neg)
    cdf = [(bisect_right(sn, x) / len(sn), bisect_right(pos, x) / len(pos)) for x in both]
    assert D.ks_drift(ref, cur, ["score"]).head().ks_stat == pytest.approx(max(abs(a - b) for a, b in cdf))
    w = sum(abs(a - b) * (y - x) for (a, b), x, y in zip(cdf, both, both[1:]))
    assert D.wasserstein_drift(ref, cur, ["score"]).head().wasserstein == pytest.approx(w)


def test_trapezoid_of_repeated_x(spark):
    pts = [(0.0, 0.0), (0.0, 0.4), (0.0, 0.2), (0.5, 0.5), (0.5, 0.9), (1.0, 1.0)]
    area = EV.auc_trapezoid(spark.createDataFrame(pts, "fpr double, tpr double")).head()[0]
    assert area == pytest.approx(0.5 * (0.4 + 0.5) / 2 + 0.5 * (0.9 + 1.0) / 2)
    assert EV.auc_trapezoid(spark.createDataFrame([], "fpr double, tpr double")).head()[0] == 0.0


def test_split_does_not_shuffle_whole_rows(spark, skewed, capsys):
    stratified_split(skewed.withColumn("wide", F.lit("x")), key="app_id", label="label").explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


@pytest.mark.parametrize("limit", [10_000, 0])
def test_split_of_many_and_null_classes(spark, monkeypatch, limit):
    from loanlens.operators import split as S
    monkeypatch.setattr(S, "MAX_BROADCAST_CLASSES", limit)
    df = spark.range(4000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 97).alias("c"))
    got = {(r.c, r.split): r["count"] for r in S.stratified_split(df, "id", "c").groupBy("c", "split").count().collect()}
    import math
    for r in class_counts(df, "c").collect():
        test = math.ceil(r.n * 0.2)
        assert got[(r.c, "test")] == test and got.get((r.c, "train"), 0) == r.n - test
    whole = {r.split for r in S.stratified_split(df, "id", "c", test_size=0.0).collect()}
    assert whole == {"train"}
    assert S.stratified_split(df.limit(0), "id", "c").count() == 0


def test_weights_leave_the_rows_of_a_class_in_their_tasks(spark, skewed):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as for a table too large to be broadcast
    try:
        got = with_weights(skewed.repartition(6), "label")
        tasks = got.groupBy("label", F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.label: round(r.w, 9) for r in tasks} == {0: 0.75, 1: 1.5}
    assert max(r.n for r in tasks if r.label == 0) < N / 4
