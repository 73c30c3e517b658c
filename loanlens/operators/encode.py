"""Fitted transforms and feature selection.

``FittedEncoder`` replaces the reference's ColumnTransformer (median impute +
standard scale for numbers; most-frequent impute + one-hot for text). The
fit is three aggregation passes (moments + sketches, medians, category
counts) that return k constants (medians, means, population stds, modes,
sorted category lists); ``transform`` is one
``select`` of named double columns built from those constants, so it works
the same on a batch DataFrame and on a stream, stays in whole-stage codegen,
and keeps Catalyst's column pruning (features stay named columns; a
``VectorAssembler`` is only applied to the selected ones).

Definitions follow the reference's library, not Spark ML's defaults:
scaling uses the **population** std (std 0 -> 1), median is exact and
interpolated, mode ties go to the smallest value, unknown categories encode
as all zeros.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



@dataclass
class FittedEncoder:
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)

    # ---------------------------------------------------------------- fit
    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], categorical: list[str],
            quantiles: str = "exact", max_categories: int | None = None) -> "FittedEncoder":
        enc = cls(list(numeric), list(categorical))
        # pass 1: per numeric column count, rows, mean and population variance,
        # all in one aggregation (k values to the driver)
        if numeric:
            from loanlens.operators.profile import quantile_row
            aggs = [F.count(F.lit(1)).alias("_rows")]
            for c in numeric:
                x = F.col(c).cast("double")
                aggs += [F.count(x).alias(f"{c}__c"), F.avg(x).alias(f"{c}__m"), F.var_pop(x).alias(f"{c}__v")]
            mom = df.agg(*aggs).head()
            # then exact medians
            qrow = quantile_row(df, numeric, [0.5], ["median"], quantiles).head()
            n = mom["_rows"]
            for c in numeric:
                med = qrow[f"{c}__median"]
                enc.medians[c] = None if med is None else float(med)
                cnt, mu, var = mom[f"{c}__c"], mom[f"{c}__m"], mom[f"{c}__v"]
                # mean / population std after imputing the (n - cnt) nulls with the
                # median: exact parallel-variance combination of the two groups
                k = n - cnt if med is not None else 0
                tot = cnt + k
                if tot == 0:
                    enc.means[c], enc.stds[c] = 0.0, 1.0
                    continue
                mu = mu if mu is not None else 0.0
                m_all = (cnt * mu + k * (med or 0.0)) / tot
                m2 = (var or 0.0) * cnt + cnt * (mu - m_all) ** 2 + k * ((med or 0.0) - m_all) ** 2
                sd = (m2 / tot) ** 0.5
                enc.means[c] = m_all
                enc.stds[c] = sd if sd > 0.0 else 1.0
        # pass 3: (column, value) counts of all text columns in one grouped
        # aggregation; no limit unless max_categories sets one per column
        if categorical:
            cnt = (df.select(*categorical).unpivot([], categorical, "feature", "value")
                   .where(F.col("value").isNotNull())
                   .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
            cap = None if max_categories is None else max_categories * len(categorical)
            rows = (cnt if cap is None else cnt.limit(cap + 1)).collect()  # k category counts
            by: dict[str, list[tuple[str, int]]] = {c: [] for c in categorical}
            for r in rows:
                by[r["feature"]].append((r["value"], r["n"]))
            wide = {} if cap is None else {c: len(v) for c, v in by.items() if len(v) > max_categories}
            if wide or (cap is not None and len(rows) > cap):
                raise ValueError(f"too many categories to one-hot encode (> {max_categories} per column): "
                                 f"{wide or 'total over cap'}")
            for c in categorical:
                vals = by[c]
                enc.modes[c] = min(vals, key=lambda t: (-t[1], t[0]))[0] if vals else None
                enc.categories[c] = sorted(v for v, _ in vals)
        return enc

    # ---------------------------------------------------------- transform
    def _imputed(self, c: str) -> Column:
        med = self.medians.get(c)
        x = F.col(c).cast("double")
        return x if med is None else F.coalesce(x, F.lit(med))

    def numeric_exprs(self) -> list[Column]:
        return [((self._imputed(c) - F.lit(self.means[c])) / F.lit(self.stds[c])).alias(c)
                for c in self.numeric]

    def onehot_exprs(self) -> list[Column]:
        out = []
        for c in self.categorical:
            filled = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            for v in self.categories[c]:
                out.append(F.when(filled == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{v}"))
        return out

    @property
    def output_names(self) -> list[str]:
        """numeric names, then ``column_category`` in fitted order."""
        return list(self.numeric) + [f"{c}_{v}" for c in self.categorical for v in self.categories[c]]

    def transform(self, df: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """numeric then one-hot columns; other columns dropped except ``keep``."""
        return df.select(*[F.col(k) for k in keep], *self.numeric_exprs(), *self.onehot_exprs())

    # -------------------------------------------------------------- params
    def params_rows(self) -> list[tuple]:
        """Long params table rows (kind, column, position, key, value)."""
        rows = []
        for i, c in enumerate(self.numeric):
            rows += [("median", c, i, None, self.medians.get(c)), ("mean", c, i, None, self.means[c]),
                     ("std", c, i, None, self.stds[c])]
        for i, c in enumerate(self.categorical):
            rows.append(("mode", c, i, self.modes[c], None))
            rows += [("category", c, j, v, None) for j, v in enumerate(self.categories[c])]
        return rows

    PARAMS_SCHEMA = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("column", T.StringType()),
        T.StructField("position", T.IntegerType()), T.StructField("key", T.StringType()),
        T.StructField("value", T.DoubleType())])

    def params_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.params_rows(), self.PARAMS_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        self.params_df(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedEncoder":
        rows = spark.read.parquet(path).collect()  # k rows of fitted constants
        num = sorted({(r.position, r.column) for r in rows if r.kind == "mean"})
        cat = sorted({(r.position, r.column) for r in rows if r.kind == "mode"})
        enc = cls([c for _, c in num], [c for _, c in cat])
        for r in rows:
            if r.kind == "median":
                enc.medians[r.column] = r.value
            elif r.kind == "mean":
                enc.means[r.column] = r.value
            elif r.kind == "std":
                enc.stds[r.column] = r.value
            elif r.kind == "mode":
                enc.modes[r.column] = r.key
        for c in enc.categorical:
            enc.categories[c] = [r.key for r in sorted(
                (r for r in rows if r.kind == "category" and r.column == c), key=lambda r: r.position)]
        return enc

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def long_features(df: DataFrame, names: list[str], key: str = "app_id") -> DataFrame:
    """Wide encoded frame -> (key, feature, value) (one projection, no shuffle)."""
    return df.select(key, *names).unpivot([key], names, "feature", "value")


# ------------------------------------------------------------ feature filters

def correlated_pairs(enc_df: DataFrame, names: list[str], threshold: float = 0.85) -> DataFrame:
    """All pairs (i < j) with |r| > threshold over the encoded columns.

    Pairwise complete (nulls and NaN are missing), whatever the number of
    columns. A pair with a constant column has no r.
    """
    r = F.abs(F.col("r"))
    return pair_correlations(enc_df, names).where(r > threshold).select("a", "b", "i", "j", r.alias("abs_r"))


#: Columns of one block, and block pairs whose sums one task holds (six matrices of BLOCK x BLOCK doubles each).
BLOCK = 512
HELD = 4
#: Tasks of one pass over some block pairs; each sends on its sums once.
PASS_TASKS = 64


def pair_correlations(df: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """(a, b, i, j, r) of all pairs i < j, from sums of products of centred values, block of columns by block.

    The columns are written once as one array a block. A pass adds up at most
    ``HELD`` pairs of blocks and reads those blocks' arrays only, so a task's
    memory does not grow with the number of columns; all passes are one job,
    and one grouped sum adds the tasks' matrices. Up to ``block`` columns are
    one pass over the given table.
    """
    spark = df.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "a string, b string, i int, j int, r double")
    starts = list(range(0, len(names), block))
    cell = [F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("nan"))) for n in names]
    x = df.select(*[F.array(*cell[lo:lo + block]).alias(f"b{k}") for k, lo in enumerate(starts)])
    if len(starts) > 1:
        from loanlens.sources.stages import written
        x = written(x, "column-blocks")
    means = _column_means(x, starts, len(names))
    pairs = [(k, m) for k in range(len(starts)) for m in range(k, len(starts))]
    t = None
    for lo in range(0, len(pairs), HELD):
        part = pairs[lo:lo + HELD]
        rows = x.select(*[f"b{k}" for k in sorted({k for p in part for k in p})])
        if len(pairs) > HELD:
            rows = rows.coalesce(PASS_TASKS)
        sums = rows.mapInArrow(_pair_sums(part, starts, means), "i int, j int, " + ", ".join(f"{p} double" for p in _SUMS))
        t = sums if t is None else t.unionByName(sums)
    t = t.groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in _SUMS])
    n, sx, sy, sxx, syy, sxy = (F.col(p) for p in _SUMS)
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    # what rounding leaves of a constant column is no variance
    r = F.when((n > 0) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy), (sxy - sx * sy / n) / (F.sqrt(vx) * F.sqrt(vy)))
    name = F.array(*[F.lit(c) for c in names])
    return t.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), "i", "j", r.alias("r"))


_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrix(batch, name: str) -> np.ndarray:
    """Rows x columns of one block's arrays, NaN where a value is missing."""
    values = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1) if batch.num_rows else values.reshape(0, 0)


def _column_means(x: DataFrame, starts: list[int], k: int) -> np.ndarray:
    """Mean of every column, 0 where it has no value: one pass, k sums from each task."""
    def sums(batches):
        import pyarrow as pa
        n, s = np.zeros(k), np.zeros(k)
        for batch in batches:
            for b, lo in enumerate(starts):
                v = _matrix(batch, f"b{b}")
                if len(v):
                    n[lo:lo + v.shape[1]] += np.count_nonzero(~np.isnan(v), axis=0)
                    s[lo:lo + v.shape[1]] += np.nansum(v, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(s)], names=["i", "n", "s"])

    out = np.zeros(k)
    for r in x.mapInArrow(sums, "i long, n double, s double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"] / r["n"] if r["n"] else 0.0
    return out


def _pair_sums(pairs: list[tuple[int, int]], starts: list[int], means: np.ndarray):
    """Sums of products of the columns of some block pairs, one row for each pair of columns i < j."""
    def sums(batches):
        import pyarrow as pa
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            held = {}
            for b in {b for p in pairs for b in p}:
                v = _matrix(batch, f"b{b}")
                v = v - means[starts[b]:starts[b] + v.shape[1]]
                there = ~np.isnan(v)
                v = np.where(there, v, 0.0)
                held[b] = v, there.astype(float)
            for p in pairs:
                (v, w), (u, z) = held[p[0]], held[p[1]]
                part = np.stack([w.T @ z, v.T @ z, w.T @ u, (v * v).T @ z, w.T @ (u * u), v.T @ u])
                total[p] = total[p] + part if p in total else part
        for (a, b), part in total.items():
            i, j = np.meshgrid(starts[a] + np.arange(part.shape[1]), starts[b] + np.arange(part.shape[2]), indexing="ij")
            up = i < j
            yield pa.RecordBatch.from_arrays([pa.array(i[up].astype(np.int32)), pa.array(j[up].astype(np.int32)),
                                              *[pa.array(m[up]) for m in part]], names=["i", "j", *_SUMS])
    return sums


def correlation_drop(enc_df: DataFrame, names: list[str], threshold: float = 0.85,
                     policy: str = "later", target: str | None = None) -> list[str]:
    """F8: names to drop.

    ``policy='later'`` (the reference's code): drop column j when any earlier
    column i < j has |r| > threshold, whether or not i is itself dropped.
    ``policy='weaker_target'``: of each such pair drop the one with the
    weaker |corr| to ``target`` (what the reference's prose promises).
    """
    pairs = correlated_pairs(enc_df, names, threshold).collect()
    if policy == "later":
        drop = {p["b"] for p in pairs}
    elif policy == "weaker_target":
        from loanlens.operators.profile import corr_with_target
        tc = {r["feature"]: abs(r["r"] or 0.0) for r in corr_with_target(enc_df, names, target).collect()}
        drop = {p["b"] if tc[p["a"]] >= tc[p["b"]] else p["a"] for p in pairs}
    else:
        raise ValueError(policy)
    return [n for n in names if n in drop]


def variance_table(enc_df: DataFrame, names: list[str]) -> DataFrame:
    """population variance of every column (one aggregation)."""
    row = enc_df.agg(*[F.var_pop(F.col(n)).alias(n) for n in names])
    return row.unpivot([], names, "feature", "variance")


def variance_keep(enc_df: DataFrame, names: list[str], threshold: float = 0.01) -> list[str]:
    v = {r["feature"]: r["variance"] for r in variance_table(enc_df, names).collect()}
    return [n for n in names if v[n] is not None and v[n] > threshold]


def importance_filter(enc_df: DataFrame, names: list[str], label: str = "loan_status",
                      threshold: float = 0.01, num_trees: int = 100, seed: int = 42,
                      max_depth: int = 30) -> DataFrame:
    """forest importances; keep >= threshold, ordered by importance desc."""
    from pyspark.ml.feature import VectorAssembler

    from loanlens.operators.forest import Forest, forest_importances
    spark = enc_df.sparkSession
    key = [c for c in ("app_id",) if c in enc_df.columns]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(
        enc_df.select(*key, F.col(label).cast("double").alias("label"), *names))
    imp = forest_importances(data, Forest(num_trees, max_depth, balanced=False, seed=seed), key=key[0] if key else None).tolist()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.where(F.col("importance") >= threshold).orderBy(F.desc("importance"), "feature")


def select_features(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """the fitted names in order; a missing name raises an AnalysisException."""
    return df.select(*keep, *names)
