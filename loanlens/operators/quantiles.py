"""Exact quantiles by nested value histograms: no sort of values, no map of them.

Spark's ``percentile`` keeps a map of every distinct value in one task. Here
each wanted rank is closed in on, for all columns, groups and targets at once:

1. one aggregation gives count, least and largest value of every column;
2. a pass counts rows by bin (``BINS`` bins between the two, by exponent where
   they differ in it); running sums over the bins of a column tell which bin
   holds each wanted rank;
3. only rows in such boundary bins are counted again, in bins between the
   least and largest value the bin holds, until every boundary bin holds one
   distinct value.

A bin's largest value always has a bin of its own, so each pass narrows every
open bin; values spread at random need two or three passes, any doubles six. A pass has
map-side counts, so a hot value is one row a task, and shuffles at most
``BINS`` rows for each open bin. The driver holds one row for each column,
group and target. The result equals ``percentile(c, p)`` (linear
interpolation between ranks, as pandas and ``quantile_cont``); NaN counts as
the largest value.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.columns import null_safe_join

BINS = 1 << 14


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """Place of a value between two finite ones, from 0 to 1 and not falling.

    By exponent where the two differ in it, so that a few passes reach any
    value, otherwise in proportion.
    """
    def between(x, a, b):
        return F.coalesce(F.try_divide(x - a, b - a), F.lit(0.0))

    tiny = F.lit(-1075.0)       # under the exponent of every double but zero
    size = F.coalesce(F.log2(F.abs(v)), tiny)
    top = F.coalesce(F.log2(F.greatest(F.abs(lo), F.abs(hi))), tiny)
    by_sign = F.lit(0.5) + F.signum(v) * 0.5 * between(size, tiny, top)
    up, down = between(size, F.log2(lo), F.log2(hi)), between(-size, -F.log2(-lo), -F.log2(-hi))
    return (F.when((lo <= 0) & (hi >= 0), by_sign).when((lo > 0) & (hi * 0.5 > lo), up).when((hi < 0) & (lo * 0.5 < hi), down)
            .otherwise(between(v, lo, hi)))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """Bin of a value between two finite ones, not falling in the value; values outside are in bins of their own."""
    inner = F.greatest(F.least(F.floor(F.nanvl(_share(v, lo, hi), F.lit(0.0)) * (BINS - 1)), F.lit(BINS - 2)), F.lit(0))
    return (F.when(F.isnan(v), BINS + 1).when(v == float("inf"), BINS).when(v == float("-inf"), -1)
            .when(v >= hi, BINS - 1).when(v <= lo, 0).otherwise(inner)).cast("int")


class _Target:
    """One wanted rank: its rank within the open bin, the path of bins to it, and the bin's bounds."""

    def __init__(self, where: tuple, feature: str, rank: int, lo: float, hi: float):
        self.where, self.feature, self.rank, self.lo, self.hi = where, feature, rank, lo, hi
        self.path: tuple[int, ...] = ()
        self.value: "float | None" = None

    @property
    def key(self) -> tuple:
        return (*self.where, self.feature, *self.path)


def _open(targets: list[_Target]) -> list[_Target]:
    return [t for t in targets if t.value is None]


def _narrow(df: DataFrame, groups: list[str], types: list[T.StructField], targets: list[_Target], bounds: list[DataFrame]) -> None:
    """One pass: find the next bin of every open target. ``bounds`` are the open bins of each pass so far."""
    spark, level = df.sparkSession, len(bounds)
    todo = _open(targets)
    steps = [f"_b{i}" for i in range(level)]
    keys = [*groups, "feature", *steps]
    path = [T.StructField("feature", T.StringType()), *[T.StructField(s, T.IntegerType()) for s in steps]]
    rows = sorted({(*t.key, t.lo, t.hi) for t in todo}, key=repr)
    bounds.append(spark.createDataFrame(rows, T.StructType([*types, *path, T.StructField("_lo", T.DoubleType()),
                                                             T.StructField("_hi", T.DoubleType())])))
    cols = sorted({t.feature for t in todo})
    x = (df.select(*groups, *[F.col(c).cast("double").alias(c) for c in cols])
         .unpivot(groups, cols, "feature", "_v").where(F.col("_v").isNotNull()))
    for i, b in enumerate(bounds):      # one row for each column, group and target at most
        x = null_safe_join(x, F.broadcast(b), [*groups, "feature", *steps[:i]])
        x = x.withColumn(f"_b{i}", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    last = f"_b{level}"
    hist = x.groupBy(*keys, last).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    run = Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)     # BINS + 3 rows at most
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    wanted = spark.createDataFrame([(*t.key, t.rank, i) for i, t in enumerate(todo)],
                                   T.StructType([*types, *path, T.StructField("_rank", T.LongType()), T.StructField("_i", T.IntegerType())]))
    found = (null_safe_join(hist, F.broadcast(wanted), keys)
             .where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
             .select("_i", last, "_before", "_least", "_most").collect())
    for r in found:
        t = todo[r["_i"]]
        t.rank, t.path, t.lo, t.hi = t.rank - r["_before"], (*t.path, r[last]), r["_least"], r["_most"]
        if t.lo == t.hi or t.lo != t.lo:
            t.value = t.lo


def _quantiles(df: DataFrame, cols: list[str], probs: list[float], groups: list[str]) -> Iterator[tuple[tuple, str, float, "float | None"]]:
    """(group, column, p, value) of every group and column; None for columns without values."""
    types = [T.StructField(g, df.schema[g].dataType) for g in groups]
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"_n{i}"), F.min(finite(v)).alias(f"_lo{i}"), F.max(finite(v)).alias(f"_hi{i}")]
    stats = df.groupBy(*groups).agg(*aggs).collect()       # one row a group
    targets: dict[tuple, _Target] = {}
    for s in stats:
        where = tuple(s[g] for g in groups)
        for i, c in enumerate(cols):
            lo, hi = s[f"_lo{i}"], s[f"_hi{i}"]
            for p in probs if s[f"_n{i}"] else ():
                for k in (floor((s[f"_n{i}"] - 1) * p), ceil((s[f"_n{i}"] - 1) * p)):
                    targets.setdefault((where, c, k), _Target(where, c, k, lo if lo is not None else 0.0, hi if hi is not None else 0.0))
    todo, bounds = list(targets.values()), []
    while _open(todo):
        _narrow(df, groups, types, todo, bounds)
    for s in stats:
        where = tuple(s[g] for g in groups)
        for i, c in enumerate(cols):
            n = s[f"_n{i}"]
            for p in probs:
                if not n:
                    yield where, c, p, None
                    continue
                pos = (n - 1) * p
                lo, hi = floor(pos), ceil(pos)
                a, b = targets[where, c, lo].value, targets[where, c, hi].value
                yield where, c, p, a if lo == hi or a == b else (hi - pos) * a + (pos - lo) * b


def quantiles_long(df: DataFrame, cols: list[str], probs: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups..., feature, p, value): exact interpolated quantiles of every column that has values."""
    groups = list(groups or [])
    rows = [(*w, c, float(p), v) for w, c, p, v in _quantiles(df, cols, probs, groups) if v is not None]
    schema = T.StructType([*[T.StructField(g, df.schema[g].dataType) for g in groups], T.StructField("feature", T.StringType()),
                           T.StructField("p", T.DoubleType()), T.StructField("value", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema)


def quantiles_wide(df: DataFrame, cols: list[str], probs: list[float], groups: list[str] | None = None,
                   names: list[str] | None = None) -> DataFrame:
    """One row per group (without groups: one row); column ``<feature>__<name>`` per (column, prob)."""
    groups = list(groups or [])
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    by: dict[tuple, list] = {}
    for w, _, _, v in _quantiles(df, cols, probs, groups):
        by.setdefault(w, []).append(v)
    schema = T.StructType([*[T.StructField(g, df.schema[g].dataType) for g in groups],
                           *[T.StructField(f"{c}__{n}", T.DoubleType()) for c in cols for n in names]])
    return df.sparkSession.createDataFrame([(*w, *v) for w, v in by.items()], schema)
