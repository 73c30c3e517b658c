"""Model training, cross-validation and tuning.

Four imbalanced binary classifiers, as in the reference:

* logistic regression, L2 with C = 1, balanced weights: the same objective
  as scikit-learn's by algebra (``regParam = 1 / (C * sum(weights))``,
  ``standardization=False``);
* random forest, 100 trees, balanced weights, seed 42, depth at most 30
  (:mod:`loanlens.operators.forest`);
* gradient-boosted trees, 100 rounds, depth 6, step 0.3, L2 term 1, positive
  weight n0/n1: second-order boosting on quantile bins
  (:mod:`loanlens.operators.boosting`);
* RBF SVM re-aimed: a Nyström landmark map (or random Fourier features,
  Rahimi & Recht 2007) with numpy, a linear machine with ``LinearSVC``'s
  objective and balanced weights, then Platt scaling fitted on margins of held-out folds
  (:mod:`loanlens.operators.kernel`).

All models expose one ``probability_default`` column. Folds are a column
(``split.stratified_folds``). Cross-validation and tuning of the tree models
grow all folds and settings together, and a setting that only has fewer
rounds, fewer trees or a smaller depth limit in a forest is scored from a
part of the larger fit, which equals its own fit.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.operators.boosting import Setting, Training
from loanlens.operators.evaluate import evaluate_all
from loanlens.operators.forest import Forest, fit_forest, forest_importances
from loanlens.operators.kernel import NystromMap, fit_machine
from loanlens.operators.trees import Binned

MODELS = ("logreg", "forest", "gbt", "svm")

# The reference's tuning grids under Spark's parameter names
# (n_estimators -> maxIter / numTrees, max_depth -> maxDepth, learning_rate
# -> stepSize, subsample -> subsamplingRate, min_samples_leaf ->
# minInstancesPerNode; min_samples_split is left out).
REFERENCE_GRIDS = {
    "gbt": {"maxIter": [100, 200, 300], "maxDepth": [4, 5, 6], "stepSize": [0.01, 0.05, 0.1],
            "subsamplingRate": [0.8, 0.9, 1.0]},
    "forest": {"numTrees": [100, 200, 300], "maxDepth": [10, 15, 20], "minInstancesPerNode": [2, 4, 6]},
}
SMALL_GRIDS = {
    "gbt": {"maxDepth": [3, 5], "maxIter": [10, 20]},
    "forest": {"maxDepth": [5, 10], "numTrees": [10, 20]},
}


def assemble(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """Vector of the **selected** named columns only (keeps column pruning upstream)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=names, outputCol=out).transform(df)


def balanced_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """n / (2 n_c) per row, by a join with the class table."""
    from loanlens.operators.split import with_weights
    return with_weights(df, label, name)


def positive_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """1 for negatives, n0/n1 for positives (boosting's scale_pos_weight)."""
    from loanlens.operators.split import class_ratio
    ratio = class_ratio(df, label).first()["ratio"]
    ratio = 1.0 if ratio is None else ratio
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


# ------------------------------------------------------------------ RFF for the SVM

@dataclass
class FourierMap:
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi)."""
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, names: list[str], n_components: int = 256, seed: int = 42,
            gamma: float | None = None) -> "FourierMap":
        if gamma is None:  # scikit-learn's gamma='scale': 1 / (n_features * Var(X))
            long = df.select(*names).unpivot([], names, "f", "v")
            var = long.agg(F.var_pop("v")).head()[0] or 1.0
            gamma = 1.0 / (len(names) * var)
        rng = np.random.default_rng(seed)
        w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(len(names), n_components))
        b = rng.uniform(0.0, 2 * np.pi, size=n_components)
        return cls(w, b)

    @property
    def weights(self) -> np.ndarray:
        """Of the last product, as in ``NystromMap``: none."""
        return np.eye(self.w.shape[1])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.w.shape[1]) * np.cos(x @ self.w + self.b)

    apply = raw

    def transform(self, df: DataFrame, in_col: str = "features", out_col: str = "rff") -> DataFrame:
        apply = self.apply

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(xs):  # one Arrow batch: (rows x d) @ (d x D) in numpy
            import pandas as pd
            if len(xs) == 0:
                return pd.Series([], dtype=object)
            return pd.Series(list(apply(np.stack(xs.to_numpy()))))

        return df.withColumn(out_col, array_to_vector(rff(vector_to_array(F.col(in_col)))))


# ------------------------------------------------------------------ fitting

@dataclass
class FittedModel:
    kind: str
    model: object
    extra: object = None  # Platt model of the SVM

    def predict(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``probability_default`` (probability of class 1)."""
        if self.kind == "svm":
            p = self.extra.transform(self.model.with_margin(df, features)).withColumn("probability_default", vector_to_array("_pp")[1])
            return p.drop("_margin_v", "_pp", "_praw", "_ppred")
        out = self.model.transform(df)
        return out.withColumn("probability_default", vector_to_array("_prob")[1]) \
                  .drop("_prob", "_raw", "_pred")


def record_key(df: DataFrame, name: str = "app_id") -> "str | None":
    """The column that names a record, where there is one: it draws the record into samples."""
    return name if name in df.columns else None


def setting_of(params: dict) -> Setting:
    return Setting(params.get("maxDepth", 6), params.get("stepSize", 0.3), params.get("subsamplingRate", 1.0))


def forest_of(params: dict, num_trees: int = 100, max_depth: int = 30, seed: int = 42) -> Forest:
    return Forest(params.get("numTrees", num_trees), params.get("maxDepth", max_depth), params.get("minInstancesPerNode", 1), seed=seed)


def fit_model(kind: str, train: DataFrame, features: str = "features", label: str = "label",
              seed: int = 42, max_depth: int = 30, num_trees: int = 100, gbt_iter: int = 100,
              rff_components: int = 256, kernel_map: str = "nystrom", **params) -> FittedModel:
    """Fit one of ``MODELS`` on (features, label); ``rff_components`` is the size of the kernel map
    (``'nystrom'`` landmarks or ``'fourier'`` features)."""
    common = dict(featuresCol=features, labelCol=label, rawPredictionCol="_raw", predictionCol="_pred")
    if kind == "logreg":
        tw = balanced_weights(train, label)
        total_w = tw.agg(F.sum("weight")).head()[0]
        est = LogisticRegression(weightCol="weight", maxIter=1000, elasticNetParam=0.0,
                                 regParam=1.0 / (params.get("C", 1.0) * total_w),
                                 standardization=False, probabilityCol="_prob", **common)
        return FittedModel(kind, est.fit(tw))
    if kind == "forest":
        return FittedModel(kind, fit_forest(train, forest_of(params, num_trees, max_depth, seed), label, features, record_key(train)))
    if kind == "gbt":
        grown = Training.start(train, [setting_of(params)], label, features, None, record_key(train), seed=seed)
        model = grown.run(params.get("maxIter", gbt_iter)).model(0)
        grown.close()
        return FittedModel(kind, model)
    if kind == "svm":
        if kernel_map == "nystrom":
            fmap = NystromMap.fit(train, features, rff_components, seed)
        else:
            dim = len(train.select(features).head()[0])
            a = train.select(vector_to_array(features).alias("_a"))
            fmap = FourierMap.fit(a.select(*[F.col("_a")[i].alias(f"x{i}") for i in range(dim)]), [f"x{i}" for i in range(dim)],
                                  rff_components, seed)
        svc, platt = fit_machine(balanced_weights(train, label), fmap, features, label, seed, params.get("C", 1.0),
                                 params.get("regParam"))
        return FittedModel(kind, svc, platt)
    raise ValueError(f"unknown model {kind!r}")


@dataclass
class Importances:
    """What a forest's importances are read from where its trees stayed in their tasks."""
    featureImportances: DenseVector  # noqa: N815 - as pyspark.ml names it


def fit_importances(train: DataFrame, features: str = "features", label: str = "label", seed: int = 42, max_depth: int = 30,
                    num_trees: int = 100, **params) -> FittedModel:
    """Grow the forest of :func:`fit_model` for its importances alone: no tree reaches the driver, and it cannot predict."""
    imp = forest_importances(train, forest_of(params, num_trees, max_depth, seed), label, features, record_key(train))
    return FittedModel("forest", Importances(DenseVector(imp)))


def test_metrics(fm: FittedModel, test: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: model, accuracy, precision, recall, f1, roc_auc on ``test``."""
    p = fm.predict(test).select(F.col(label).alias("label"), F.col("probability_default").alias("score"))
    return evaluate_all(p, threshold).select(F.lit(fm.kind).alias("model"), "accuracy", "precision",
                                             "recall", "f1", "roc_auc")


def cross_validate(df: DataFrame, kinds: list[str], k: int, fold_col: str = "fold",
                   label: str = "label", parallelism: int = 4, seed: int = 42, num_trees: int = 100, gbt_iter: int = 100,
                   max_depth: int = 30, **fit_params) -> DataFrame:
    """Per model and fold, fit on the other folds and score the held-out fold.

    Returns (model, fold, metrics...). Folds are exact stratified (a column).
    Boosting grows all folds together; a forest's folds share one binned
    table; the other models have one fit a fold. Up to ``parallelism`` of these
    are submitted at once from driver threads (as ``CrossValidator`` does). The
    driver moves no records. Boosting weighs positives by the ratio of the
    whole table.
    """
    from concurrent.futures import ThreadPoolExecutor
    spark, key = df.sparkSession, record_key(df)

    def measured(kind: str, fold: int, scores: DataFrame):
        return [(kind, *r, fold) for r in evaluate_all(scores, 0.5).select("accuracy", "precision", "recall", "f1", "roc_auc").collect()]

    def one(kind: str, f: int):
        fm = fit_model(kind, df.where(F.col(fold_col) != f), label=label, seed=seed, **fit_params)
        return measured(kind, f, fm.predict(df.where(F.col(fold_col) == f)).select(F.col(label).alias("label"),
                                                                                   F.col("probability_default").alias("score")))

    def boosted(kind: str):
        grown = Training.start(df, [Setting(fold=f) for f in range(k)], label, "features", fold_col, key, seed=seed).run(gbt_iter)
        scores = grown.held_out_scores()
        grown.close()
        return [r for f in range(k) for r in measured(kind, f, scores.where(F.col("fit") == f))]

    def forests(kind: str):
        binned = Binned.write(df, label, "features", fold_col, key, work=num_trees)
        blocks = binned.blocks().persist()
        rows = [r for f in range(k)
                for r in measured(kind, f, Forest(num_trees, max_depth, fold=f, seed=seed).grow(blocks, binned).held_out_scores(spark, blocks))]
        blocks.unpersist()
        binned.delete()
        return rows

    whole = {"gbt": boosted, "forest": forests}
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        # the longest first; boosting's many short passes leave cores to the others
        started = {kind: [ex.submit(whole[kind], kind)] for kind in ("gbt", "forest") if kind in kinds}
        started |= {kind: [ex.submit(one, kind, f) for f in range(k)] for kind in kinds if kind not in whole}
        rows = [r for kind in kinds for part in started[kind] for r in part.result()]
    schema = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double, fold int"
    return spark.createDataFrame(rows, schema)


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population std of each metric per model."""
    ms = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    aggs = []
    for m in ms:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy("model").agg(*aggs)


def grid_search(df: DataFrame, kind: str, grid: dict[str, list], fold_col: str = "fold", label: str = "label",
                seed: int = 42, refit: bool = False):
    """Every setting of the grid over the folds, scored on recall of class 1.

    Returns (model, rows): rows are (model, parameters, mean recall over the
    folds), the model is the best setting fitted on all records, or None
    without ``refit``. Settings that differ in rounds (boosting), or in the
    number of trees or the depth limit (forest), share their fits.
    """
    names = sorted(grid)
    settings = [dict(zip(names, v, strict=True)) for v in product(*[grid[n] for n in names])]
    k = int(df.agg(F.max(fold_col)).head()[0]) + 1
    score = {"gbt": _boosting_recalls, "forest": _forest_recalls}[kind](df, settings, k, fold_col, label, seed)
    rows = [(kind, ";".join(f"{n}={p[n]}" for n in names), float(m)) for p, m in zip(settings, score, strict=True)]
    if not refit:
        return None, rows
    best = settings[max(range(len(rows)), key=lambda i: rows[i][2])]      # the first of equal ones
    return fit_model(kind, df, label=label, seed=seed, **best), rows


def _recall(counts: tuple[int, int, int, int]) -> float:
    tp, _, _, fn = counts
    return tp / (tp + fn) if tp + fn else 0.0


def _boosting_recalls(df, settings: list[dict], k: int, fold_col: str, label: str, seed: int) -> list[float]:
    """Mean recall of each setting: one fit a fold for all settings with the same trees, read at their rounds."""
    fits = list(dict.fromkeys(setting_of(p) for p in settings))
    grown = Training.start(df, [replace(s, fold=f) for s in fits for f in range(k)], label, "features", fold_col, record_key(df), seed=seed)
    at = {}
    for rounds in sorted({p.get("maxIter", 100) for p in settings}):
        counts = grown.run(rounds).held_out_counts()
        for i, s in enumerate(fits):
            at[s, rounds] = sum(map(_recall, counts[i * k:(i + 1) * k])) / k
    grown.close()
    return [at[setting_of(p), p.get("maxIter", 100)] for p in settings]


def _forest_recalls(df, settings: list[dict], k: int, fold_col: str, label: str, seed: int) -> list[float]:
    """Mean recall of each setting: one fit a fold and leaf size, read at each number of trees and depth."""
    want = [forest_of(p, seed=seed) for p in settings]
    sizes, depths = sorted({w.trees for w in want}), sorted({w.max_depth for w in want})
    binned = Binned.write(df, label, "features", fold_col, record_key(df), work=sizes[-1])
    blocks = binned.blocks().persist()
    at = {}
    for leaf in sorted({w.min_leaf for w in want}):
        folds = [Forest(sizes[-1], depths[-1], leaf, f, seed=seed).grow(blocks, binned).held_out_counts(blocks, depths, sizes)
                 for f in range(k)]
        for d, n in product(depths, sizes):
            at[leaf, d, n] = sum(_recall(c[d, n]) for c in folds) / k
    blocks.unpersist()
    binned.delete()
    return [at[w.min_leaf, w.max_depth, w.trees] for w in want]


def feature_importance(fm: FittedModel, names: list[str]) -> list[tuple[str, float]]:
    """(name, importance) of a tree model, descending."""
    imp = fm.model.featureImportances.toArray().tolist()
    return sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))


def save_model(stages: list[Transformer], path: str) -> None:
    """Persist fitted stages as a ``PipelineModel`` directory."""
    PipelineModel(stages).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
