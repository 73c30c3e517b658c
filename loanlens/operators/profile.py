"""Profiling: shape, info, describe, nulls, rates, correlation, IQR, skew,
box summaries, histogram and density.

Every profile is one (or two) aggregation passes over all columns at once;
results are long k-row tables ``(feature, ...)``. Statistics follow the
pandas definitions: sample std and skewness, interpolated quantiles,
pairwise-complete Pearson correlation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.columns import categorical_columns, null_safe_join, numeric_columns, safe_div


def quantile_row(df: DataFrame, cols: list[str], qs: list[float], names: list[str],
                 mode: str = "exact", groups: list[str] | None = None) -> DataFrame:
    """One row per group with ``<col>__<name>`` quantile columns.

    ``exact``: interpolated, by nested histograms (``operators.quantiles``);
    ``approx``: ``percentile_approx``, one pass.
    """
    from loanlens.operators.quantiles import quantiles_wide
    groups = list(groups or [])
    if mode != "approx":
        return quantiles_wide(df, cols, qs, groups, names)
    aggs = []
    for c in cols:
        arr = F.transform(F.percentile_approx(F.col(c).cast("double"), qs, 10000), lambda x: x.cast("double"))
        aggs += [arr[i].alias(f"{c}__{n}") for i, n in enumerate(names)]
    return df.groupBy(*groups).agg(*aggs)


def _stack_structs(row_df: DataFrame, names: list[str], var: str = "feature") -> DataFrame:
    """One-row frame whose columns are structs of equal type -> long rows."""
    return row_df.unpivot([], names, var, "s").select(var, "s.*")


# --- B1 / B2 ---------------------------------------------------------------

def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def profile_info(df: DataFrame) -> DataFrame:
    """Non-null count and type per column, in column order (``df.info()``)."""
    aggs = [F.struct(F.lit(i).alias("position"), F.count(F.col(f.name)).alias("non_null"),
                     F.lit(f.dataType.simpleString()).alias("dtype")).alias(f.name)
            for i, f in enumerate(df.schema.fields)]
    return _stack_structs(df.agg(*aggs), df.columns, "column")


# --- B3 / B4 ---------------------------------------------------------------

def describe_numeric(df: DataFrame, cols: list[str] | None = None, quantiles: str = "exact") -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column.

    Pass 1: moments of every column in one aggregation (a k-value row reaches
    the driver); then the quartiles (``quantile_row``). The moments come back
    into the plan as literals.
    """
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        aggs += [F.count(F.col(c)).alias(f"{c}__count"), F.avg(F.col(c)).alias(f"{c}__mean"),
                 F.stddev_samp(F.col(c)).alias(f"{c}__std"), F.min(F.col(c)).cast("double").alias(f"{c}__min"),
                 F.max(F.col(c)).cast("double").alias(f"{c}__max")]
    m = df.agg(*aggs).head()
    qr = quantile_row(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], quantiles)
    row = qr.select(*[F.struct(
        F.lit(m[f"{c}__count"]).cast("bigint").alias("count"), F.lit(m[f"{c}__mean"]).cast("double").alias("mean"),
        F.lit(m[f"{c}__std"]).cast("double").alias("std"), F.lit(m[f"{c}__min"]).cast("double").alias("min"),
        F.col(f"{c}__q25").alias("q25"), F.col(f"{c}__q50").alias("q50"), F.col(f"{c}__q75").alias("q75"),
        F.lit(m[f"{c}__max"]).cast("double").alias("max")).alias(c) for c in cols])
    return _stack_structs(row, cols)


def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count / unique / top / freq per text column; top ties -> smallest value.

    One unpivot + one grouped count (one row per distinct (column, value));
    the top value comes from a salted two-level top-1, so a high-cardinality
    column is not ranked in a single task.
    """
    cols = cols or categorical_columns(df)
    long = df.select(*cols).unpivot([], cols, "feature", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))
    from loanlens.operators.ranks import top_k
    totals = counts.groupBy("feature").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"))
    top = top_k(counts, ["feature"], [F.desc("n"), F.asc("value")], 1, "value") \
        .select("feature", F.col("value").alias("top"), F.col("n").alias("freq"))
    return totals.join(top, "feature")  # k rows each


# --- B5 / B6 / B7 ----------------------------------------------------------

def null_report(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percent of all rows."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    row = df.agg(*aggs)
    return (row.unpivot(["_n"], df.columns, "column", "null_count")
            .where(F.col("null_count") > 0)
            .select("column", "null_count",
                    (F.col("null_count") * 100.0 / F.col("_n")).alias("null_pct")))


def default_rate(df: DataFrame, target: str = "loan_status") -> DataFrame:
    return df.agg((F.avg(F.col(target)) * 100.0).alias("default_rate_pct"),
                  F.count(F.lit(1)).alias("n_rows"))


def half_up(c: Column, digits: int) -> Column:
    """Round half up (the same in every engine, unlike ``round`` on doubles)."""
    s = float(10 ** digits)
    return F.floor(c * F.lit(s) + F.lit(0.5)) / F.lit(s)


def class_balance(df: DataFrame, target: str = "loan_status") -> DataFrame:
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))  # one row per class
    tot = g.agg(F.sum("n").alias("_tot"))
    return g.crossJoin(F.broadcast(tot)).select(target, "n", half_up(F.col("n") * 100.0 / F.col("_tot"), 2).alias("pct"))


# --- B8 / B9 ---------------------------------------------------------------

def _pair_corr(a: str, b: str, masked: bool = True) -> Column:
    """Pearson r over rows where both are non-null; null for a constant column.

    ``masked=False`` drops the pairwise null masks, valid (and much cheaper:
    no per-pair CASE inside the aggregation) when neither column has nulls.
    """
    if masked:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        xa = F.when(both, F.col(a).cast("double"))
        xb = F.when(both, F.col(b).cast("double"))
    else:
        xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
    return safe_div(F.covar_pop(xa, xb), F.stddev_pop(xa) * F.stddev_pop(xb))


def nullable_columns(df: DataFrame, cols: list[str]) -> set[str]:
    """Columns holding at least one null (one aggregation, k numbers to the driver)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).head()
    return {c for c in cols if row[c]}


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Long upper triangle (a, b, r), i < j, in one aggregation pass.

    Column order of ``cols`` is kept: position columns ``i``/``j`` are
    returned so callers (the correlation filter) can apply order-dependent
    rules. A first small pass finds the columns with nulls; only pairs
    involving them carry pairwise-complete masks. For very wide inputs use
    ``corr_matrix_ml``.
    """
    cols = cols or numeric_columns(df)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, i int, j int, r double")
    nulls = nullable_columns(df, cols)
    aggs = [F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"),
                     F.lit(i).alias("i"), F.lit(j).alias("j"),
                     _pair_corr(cols[i], cols[j], cols[i] in nulls or cols[j] in nulls).alias("r")).alias(f"p{i}_{j}")
            for i, j in pairs]
    names = [f"p{i}_{j}" for i, j in pairs]
    return df.agg(*aggs).unpivot([], names, "_k", "s").select("s.*")


def corr_matrix_ml(df: DataFrame, cols: list[str]) -> list[list[float]]:
    """k x k Pearson matrix via ``pyspark.ml.stat.Correlation`` (no nulls allowed).

    One treeAggregate over an assembled vector: the right tool beyond ~15
    columns, where pairwise SQL aggregates exceed codegen limits.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(df.select(*cols)).select("_v")
    m = Correlation.corr(vec, "_v").head()[0]
    return m.toArray().tolist()


def corr_with_target(df: DataFrame, cols: list[str], target: str = "loan_status") -> DataFrame:
    nulls = nullable_columns(df, cols + [target])
    aggs = [_pair_corr(c, target, c in nulls or target in nulls).alias(c) for c in cols]
    return df.agg(*aggs).unpivot([], cols, "feature", "r")


# --- B10 / B11 / B12 -------------------------------------------------------

def sample_skew(c: str) -> Column:
    """pandas ``Series.skew()``: adjusted Fisher-Pearson, null when n < 3."""
    n = F.count(F.col(c)).cast("double")
    return F.when(n >= 3, F.skewness(F.col(c)) * F.sqrt(n * (n - 1)) / (n - 2))


def iqr_outliers(df: DataFrame, cols: list[str], quantiles: str = "exact") -> DataFrame:
    """IQR rule per column: q1, q3, bounds, outliers (strict), percent of all rows, skew.

    Pass 1: one aggregation of row count and skewness (k values to the
    driver), then the quartiles (``quantile_row``).
    Pass 2: that row is broadcast-joined back and all outlier counts are
    conditional sums of a single aggregation.
    """
    m = df.agg(F.count(F.lit(1)).alias("_n"), *[sample_skew(c).alias(f"{c}__skew") for c in cols]).head()
    qr = quantile_row(df, cols, [0.25, 0.75], ["q1", "q3"], quantiles)
    stats = qr.select("*", F.lit(m["_n"]).cast("bigint").alias("_n"),
                      *[F.lit(m[f"{c}__skew"]).cast("double").alias(f"{c}__skew") for c in cols])
    joined = df.select(*cols).crossJoin(F.broadcast(stats))
    aggs2 = [F.first("_n").alias("_n")]
    for c in cols:
        q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs2.append(F.struct(
            F.first(q1).alias("q1"), F.first(q3).alias("q3"),
            F.first(q3 - q1).alias("iqr"), F.first(lo).alias("lower"), F.first(hi).alias("upper"),
            F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias("outlier_count"),
            F.first(F.col(f"{c}__skew")).alias("skew")).alias(c))
    row = joined.agg(*aggs2)
    return (row.unpivot(["_n"], cols, "feature", "s")
            .select("feature", "s.*", "_n")
            .withColumn("outlier_pct", F.col("outlier_count") * 100.0 / F.col("_n"))
            .drop("_n"))


def skewness_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.struct(F.count(F.col(c)).alias("n"), sample_skew(c).alias("skew")).alias(c)
                    for c in cols]).unpivot([], cols, "feature", "s").select("feature", "s.*")


def top_outlier_features(iqr: DataFrame, n: int = 20) -> DataFrame:
    return iqr.orderBy(F.desc("outlier_pct"), F.desc("skew"), F.asc("feature")).limit(n)


def skewed_columns(df: DataFrame, cols: list[str], threshold: float = 1.0) -> list[str]:
    """Names with sample skew > threshold (k values reach the driver)."""
    rows = skewness_profile(df, cols).where(F.col("skew") > threshold).select("feature").collect()
    return [r[0] for r in rows]


# --- B14 / B15 -------------------------------------------------------------

def rate_by(df: DataFrame, x: str, hue: str = "loan_status") -> DataFrame:
    """Counts of (x, hue) and percent within each x (map-side partial counts)."""
    g = df.groupBy(x, hue).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(x))
    return g.select(x, hue, "n", (F.col("n") * 100.0 / tot).alias("pct_within"))


def box_summary(df: DataFrame, value: str, by: str | None = "loan_status",
                quantiles: str = "exact") -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers (last value inside 1.5 IQR), outliers."""
    keys = [by] if by else []
    stats = quantile_row(df, [value], [0.25, 0.5, 0.75], ["q1", "median", "q3"], quantiles, keys) \
        .select(*keys, *[F.col(f"{value}__{n}").alias(n) for n in ("q1", "median", "q3")])
    stats = stats.withColumn("lower", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
                 .withColumn("upper", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # one row per class on the right; Catalyst broadcasts it where it is small
    j = (null_safe_join(df.select(*keys, value), stats, keys) if keys
         else df.select(value).crossJoin(F.broadcast(stats)))
    v = F.col(value)
    inside = (v >= F.col("lower")) & (v <= F.col("upper"))
    out = j.groupBy(*keys, "q1", "median", "q3", "lower", "upper").agg(
        F.min(F.when(inside, v)).cast("double").alias("whisker_low"),
        F.max(F.when(inside, v)).cast("double").alias("whisker_high"),
        F.count_if(v.isNotNull() & ~inside).alias("n_outliers"),
        F.count(v).alias("n"))
    return out


# --- B16 / B17 -------------------------------------------------------------

def histograms(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] of every column in one aggregation.

    (feature, bin, bin_lo, bin_hi, n); the max falls in the last bin, a
    zero-width column in bin 0. Ranges are one k-row aggregate, broadcast.
    """
    rng = df.agg(*[F.struct(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi")).alias(c)
                   for c in cols]).unpivot([], cols, "feature", "r").select("feature", "r.*")
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], cols, "feature", "value").where(F.col("value").isNotNull())
            .join(F.broadcast(rng), "feature"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.coalesce(F.least(F.floor(safe_div(F.col("value") - F.col("_lo"), w)), F.lit(bins - 1)), F.lit(0)).cast("int")
    return (long.groupBy("feature", b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
            .select("feature", "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "n"))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """One column's histogram (``histograms`` without the feature column)."""
    return histograms(df, [c], bins).drop("feature")


def kdes(df: DataFrame, cols: list[str], grid: int = 200, fine_bins: int = 1024) -> DataFrame:
    """Gaussian densities of every column on ``grid`` points over [min, max].

    Binned KDE with Scott's bandwidth (sample std * n^(-1/5)): rows are
    reduced to <= ``fine_bins`` bin centres with counts per column (one
    aggregation, map-side combined), then each density is a sum over
    bins x grid (<= 1024 x 200 rows per column), so the cost beyond the one
    pass does not grow with the data. Output (feature, gi, x, density,
    scaled_density = density x data range, dimensionless).
    """
    spark = df.sparkSession
    st = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
                           F.count(F.col(c)).alias("n"), F.stddev_samp(F.col(c)).alias("sd")).alias(c)
                  for c in cols]).unpivot([], cols, "feature", "s").select("feature", "s.*")
    st = st.withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))) \
           .withColumn("fw", (F.col("hi") - F.col("lo")) / F.lit(float(fine_bins)))
    long = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], cols, "feature", "value").where(F.col("value").isNotNull())
            .join(F.broadcast(st), "feature"))  # one row per column
    fb = F.coalesce(F.least(F.floor(safe_div(F.col("value") - F.col("lo"), F.col("fw"))),
                            F.lit(fine_bins - 1)), F.lit(0))
    binned = (long.groupBy("feature", fb.alias("fb")).agg(F.count(F.lit(1)).alias("cnt"))
              .join(F.broadcast(st), "feature")
              .withColumn("centre", F.col("lo") + (F.col("fb") + 0.5) * F.col("fw")))
    pts = spark.range(grid).select(F.col("id").cast("int").alias("gi"))
    g = pts.crossJoin(F.broadcast(st.select("feature", "lo", "hi"))).select(
        "feature", "gi",
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("gi") / F.lit(float(grid - 1))).alias("x"))
    z = safe_div(F.col("x") - F.col("centre"), F.col("bw"))  # constant column: null density
    dens = safe_div(F.sum(F.col("cnt") * F.exp(-0.5 * z * z)),
                    F.first("n") * F.first("bw") * F.lit(math.sqrt(2 * math.pi)))
    # bins x grid per column: <= fine_bins x grid rows each, joined on the column name
    out = g.join(binned, "feature").groupBy("feature", "gi", "x").agg(dens.alias("density"))
    return out.join(F.broadcast(st.select("feature", "lo", "hi")), "feature").select(
        "feature", "gi", "x", "density", (F.col("density") * (F.col("hi") - F.col("lo"))).alias("scaled_density"))


def kde(df: DataFrame, c: str, grid: int = 200, fine_bins: int = 1024) -> DataFrame:
    """One column's density (``kdes`` without the feature column)."""
    return kdes(df, [c], grid, fine_bins).drop("feature")