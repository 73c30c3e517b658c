"""Drift between a reference and a current table.

Both sides are stacked with a ``side`` column and profiled in one
aggregation per kind of column (numeric / text), never one job per column.
Only k-row summaries are joined (broadcast) or sent to the driver.

Simple report (the reference's fallback): row counts, target rate per side
and its absolute change, absolute mean shift per numeric column, top 3
values with counts per side for other columns. Distribution distances
(re-aimed from the third-party drift presets): two-sample KS with an
asymptotic p-value, PSI on reference deciles, Wasserstein-1, Jensen-Shannon
distance and chi-square for text columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.columns import INTEGRAL_TYPES, NUMERIC_TYPES
from loanlens.operators.ranks import cumulative, cut_bucket, sketch_cuts
from loanlens.operators.report import page
from loanlens.sources.stages import written

# Fixed default decision thresholds (parameters; the library's own are unknown).
PSI_THRESHOLD = 0.2
KS_P_THRESHOLD = 0.05
JS_THRESHOLD = 0.1
EPS = 1e-4  # share floor inside PSI logs

# Names that a target column may have.
TARGET_CANDIDATES = ["default_flag", "loan_status", "target", "y"]


# ------------------------------------------------------------------ schema

def resolve_target(ref: DataFrame, cur: DataFrame, target: str = "default") -> str:
    """Requested name, then 'default', then fixed candidates present in
    both tables, then the first integer column of ``ref`` present in both."""
    names = [target] + (["default"] if target != "default" else []) + TARGET_CANDIDATES
    for n in names:
        if n in ref.columns and n in cur.columns:
            return n
    for f in ref.schema.fields:
        if f.name in cur.columns and isinstance(f.dataType, INTEGRAL_TYPES):
            return f.name
    raise ValueError(f"no shared target column among {ref.columns}")


def shared_columns(ref: DataFrame, cur: DataFrame, target: str,
                   exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numeric, other) columns present in both, target excluded; numeric
    only when numeric on both sides."""
    num, oth = [], []
    for f in ref.schema.fields:
        if f.name == target or f.name in exclude or f.name not in cur.columns:
            continue
        both = isinstance(f.dataType, NUMERIC_TYPES) and isinstance(cur.schema[f.name].dataType, NUMERIC_TYPES)
        (num if both else oth).append(f.name)
    return num, oth


def stacked(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    return ref.select(F.lit("reference").alias("side"), *cols).unionByName(
        cur.select(F.lit("current").alias("side"), *cols))


# ------------------------------------------------------------------ simple report

def drift_overview(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Row counts per side (two scans, one row)."""
    return ref.agg(F.count(F.lit(1)).alias("reference_rows")).crossJoin(
        F.broadcast(cur.agg(F.count(F.lit(1)).alias("current_rows"))))  # one row each


def target_drift(ref: DataFrame, cur: DataFrame, target: str) -> DataFrame:
    """Target rate per side after an int cast, and the absolute change.

    ``n_non_binary`` counts values outside {0, 1} after the cast;
    ``check_binary_target`` raises on it unless ``cast='truncate'``.
    """
    def side(df, name):
        t = F.col(target).cast("int")
        return df.agg(F.avg(t).alias(f"{name}_rate"), F.count_if(~t.isin(0, 1)).alias(f"{name}_bad"))
    j = side(ref, "reference").crossJoin(F.broadcast(side(cur, "current")))  # one row each
    return j.select("reference_rate", "current_rate",
                    F.abs(F.col("current_rate") - F.col("reference_rate")).alias("rate_change"),
                    (F.col("reference_bad") + F.col("current_bad")).alias("n_non_binary"))


def check_binary_target(td: DataFrame, cast: str = "strict") -> DataFrame:
    if cast != "truncate":
        bad = td.select("n_non_binary").head()[0]
        if bad:
            raise ValueError(f"target has {bad} values outside 0/1; pass cast='truncate' to accept")
    return td


def mean_shift(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """One aggregation over both sides, k rows out."""
    s = stacked(ref, cur, cols)
    aggs = [F.avg(F.when(F.col("side") == sd, F.col(c))).alias(f"{c}__{sd}")
            for c in cols for sd in ("reference", "current")]
    row = s.agg(*aggs)
    parts = [F.struct(F.col(f"{c}__reference").alias("reference_mean"),
                      F.col(f"{c}__current").alias("current_mean")).alias(c) for c in cols]
    out = row.select(*parts).unpivot([], cols, "feature", "s").select("feature", "s.*")
    return out.withColumn("mean_shift", F.abs(F.col("current_mean") - F.col("reference_mean")))


def top_categories(ref: DataFrame, cur: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    """Top k values per side and column; null counts as the value 'nan'."""
    s = stacked(ref, cur, cols)
    s = s.select("side", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols])
    long = s.unpivot(["side"], cols, "feature", "value")
    g = long.groupBy("side", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    from loanlens.operators.ranks import top_k as _top_k
    return _top_k(g, ["side", "feature"], [F.desc("n"), F.asc("value")], k, "value")


def drift_summary(ref: DataFrame, cur: DataFrame, target: str = "default",
                  exclude: tuple[str, ...] = ()) -> DataFrame:
    """One row per shared column: numeric mean shift or top-3 text per side."""
    t = resolve_target(ref, cur, target)
    num, oth = shared_columns(ref, cur, t, exclude)
    spark = ref.sparkSession
    schema = ("feature string, kind string, reference_mean double, current_mean double, "
              "mean_shift double, reference_top string, current_top string")
    out = spark.createDataFrame([], schema)
    if num:
        m = mean_shift(ref, cur, num).select(
            "feature", F.lit("numeric").alias("kind"), "reference_mean", "current_mean", "mean_shift",
            F.lit(None).cast("string").alias("reference_top"), F.lit(None).cast("string").alias("current_top"))
        out = out.unionByName(m)
    if oth:
        tc = top_categories(ref, cur, oth).withColumn(
            "item", F.concat(F.col("value"), F.lit(":"), F.col("n").cast("string")))
        agg = tc.groupBy("feature").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == "reference",
                         F.struct("rank", "item")))), lambda x: x["item"]), ";").alias("reference_top"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == "current",
                         F.struct("rank", "item")))), lambda x: x["item"]), ";").alias("current_top"))
        out = out.unionByName(agg.select("feature", F.lit("categorical").alias("kind"),
                                         F.lit(None).cast("double").alias("reference_mean"),
                                         F.lit(None).cast("double").alias("current_mean"),
                                         F.lit(None).cast("double").alias("mean_shift"),
                                         "reference_top", "current_top"))
    return out


def report_sections(ref: DataFrame, cur: DataFrame, target: str = "default", exclude: tuple[str, ...] = (),
                    cast: str = "strict") -> dict[str, DataFrame]:
    """The tables of the report by heading; a target outside 0/1 is an error unless ``cast='truncate'``."""
    t = resolve_target(ref, cur, target)
    num, oth = shared_columns(ref, cur, t, exclude)
    out = {"Rows by side": drift_overview(ref, cur), "Target drift": check_binary_target(target_drift(ref, cur, t), cast)}
    if num:
        out["Means of numeric columns"] = mean_shift(ref, cur, num).orderBy(F.desc_nulls_last("mean_shift"), "feature")
        out["Stability index of numeric columns"] = psi_drift(ref, cur, num).orderBy(F.desc_nulls_last("psi"), "feature")
    if oth:
        out["Most frequent values"] = top_categories(ref, cur, oth).orderBy("feature", "side", "rank")
        out["Jensen-Shannon distance of other columns"] = js_drift(ref, cur, oth).orderBy("feature")
    return out


def report_html(ref: DataFrame, cur: DataFrame, target: str = "default",
                exclude: tuple[str, ...] = (), cast: str = "strict") -> str:
    """The report's tables as one HTML page."""
    return page("Monitoring summary", report_sections(ref, cur, target, exclude, cast))


# ------------------------------------------------------------------ distances

def _value_hist(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n_ref, n_cur) over the merged distinct values."""
    s = stacked(ref, cur, cols).select("side", *[F.col(c).cast("double").alias(c) for c in cols])
    long = s.unpivot(["side"], cols, "feature", "value").where(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "reference").alias("n_ref"),
        F.count_if(F.col("side") == "current").alias("n_cur"))


def _ecdf(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """Merged histogram with both empirical CDFs and the next distinct value.

    The histogram is written once and bucketed per column by sketch cuts of
    its distinct values, so outliers and crowded ranges spread alike. Bucket
    totals (and each bucket's first value) form a small table whose running
    sums are the offsets. One window over (feature, bucket) then yields the
    inclusive running counts and ``lead(value)``; the last value of a bucket
    takes the first value of the next non-empty bucket. No window spans a
    whole column.
    """
    h = written(_value_hist(ref, cur, cols), "value-histogram")
    cuts = sketch_cuts(h, "value", ["feature"], {"tot_ref": "n_ref", "tot_cur": "n_cur"})
    h = h.join(F.broadcast(cuts), "feature").withColumn("_bk", cut_bucket("value")).drop("_cuts")  # one row a column
    tot = h.groupBy("feature", "_bk").agg(F.sum("n_ref").alias("_tr"), F.sum("n_cur").alias("_tc"),
                                          F.min("value").alias("_fv"))
    wb = Window.partitionBy("feature").orderBy("_bk")  # 1,024 rows a column at most
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("feature", "_bk",
                      F.coalesce(F.sum("_tr").over(before), F.lit(0)).alias("_or"),
                      F.coalesce(F.sum("_tc").over(before), F.lit(0)).alias("_oc"),
                      F.lead("_fv").over(wb).alias("_nb"))
    w = Window.partitionBy("feature", "_bk").orderBy("value")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    j = h.join(offs, ["feature", "_bk"])
    return j.select("feature", "value", "tot_ref", "tot_cur",
                    F.try_divide((F.sum("n_ref").over(upto) + F.col("_or")).cast("double"), F.col("tot_ref")).alias("F_ref"),
                    F.try_divide((F.sum("n_cur").over(upto) + F.col("_oc")).cast("double"), F.col("tot_cur")).alias("F_cur"),
                    F.coalesce(F.lead("value").over(w), F.col("_nb")).alias("next_value"))


def ks_pvalue(lam: Column) -> Column:
    """Asymptotic two-sample KS p-value Q(lam), lam = sqrt(nm/(n+m)) D.

    Two fast-converging forms of the Kolmogorov distribution: for lam < 1,
    Q = 1 - sqrt(2 pi)/lam * sum_k exp(-(2k-1)^2 pi^2 / (8 lam^2)) (6 terms);
    otherwise Q = 2 sum_k (-1)^(k-1) exp(-2 k^2 lam^2) (8 terms). Clipped to
    [0, 1]; 1 for lam < 0.05.
    """
    small = None
    for k in range(1, 7):
        t = F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi ** 2 / 8.0) / (lam * lam))
        small = t if small is None else small + t
    small = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * small
    large = None
    for k in range(1, 9):
        t = F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
        large = t if large is None else large + t
    q = F.when(lam < 1.0, small).otherwise(large)
    return F.when(lam < 0.05, F.lit(1.0)).otherwise(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))


def ks_drift(ref: DataFrame, cur: DataFrame, cols: list[str], p_threshold: float = KS_P_THRESHOLD) -> DataFrame:
    """D = max |F_ref - F_cur| per numeric column, p-value, drifted flag."""
    e = _ecdf(ref, cur, cols)
    g = e.groupBy("feature").agg(F.max(F.abs(F.col("F_ref") - F.col("F_cur"))).alias("ks_stat"),
                                 F.first("tot_ref").alias("n_ref"), F.first("tot_cur").alias("n_cur"))
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    g = g.withColumn("_lam", F.sqrt(F.try_divide(n * m, n + m)) * F.col("ks_stat"))
    g = g.withColumn("p_value", ks_pvalue(F.col("_lam"))).drop("_lam")
    return g.withColumn("drifted", (F.col("p_value") < p_threshold).cast("int"))


def wasserstein_drift(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """W1 = sum |F_ref(x_i) - F_cur(x_i)| * (x_{i+1} - x_i) per numeric column."""
    e = _ecdf(ref, cur, cols)
    gap = F.col("next_value") - F.col("value")
    return e.groupBy("feature").agg(
        F.coalesce(F.sum(F.abs(F.col("F_ref") - F.col("F_cur")) * gap), F.lit(0.0)).alias("wasserstein"))


def psi_drift(ref: DataFrame, cur: DataFrame, cols: list[str], threshold: float = PSI_THRESHOLD,
              eps: float = EPS, quantiles: str = "exact") -> DataFrame:
    """PSI over 10 bins cut at the reference deciles (right-closed).

    The deciles are one row (``quantile_row``), broadcast to every row; each
    column's bin is the number of deciles strictly below the value (plain
    comparisons, whole-stage codegen), then the integer bins are unpivoted
    and counted per side in one aggregation.
    """
    from loanlens.operators.profile import quantile_row
    qs = [i / 10.0 for i in range(1, 10)]
    names = [f"d{i}" for i in range(1, 10)]
    qr = quantile_row(ref, cols, qs, names, quantiles)
    s = stacked(ref, cur, cols).crossJoin(F.broadcast(qr))
    bins = []
    for c in cols:
        x = F.col(c).cast("double")
        b = None
        for n in names:
            t = F.when(x > F.col(f"{c}__{n}"), 1).otherwise(0)
            b = t if b is None else b + t
        bins.append(F.when(x.isNotNull(), b).alias(c))
    long = s.select("side", *bins).unpivot(["side"], cols, "feature", "bin").where(F.col("bin").isNotNull())
    cnt = long.groupBy("feature", "bin").agg(
        F.count_if(F.col("side") == "reference").alias("n_ref"),
        F.count_if(F.col("side") == "current").alias("n_cur"))
    return _psi_from_counts(cnt, threshold, eps)


def _psi_from_counts(cnt: DataFrame, threshold: float, eps: float) -> DataFrame:
    tot = cnt.groupBy("feature").agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"))
    c = cnt.join(F.broadcast(tot), "feature")
    some = (F.col("tot_ref") > 0) & (F.col("tot_cur") > 0)  # an empty side: null
    pr = F.when(some, F.greatest(F.try_divide(F.col("n_ref").cast("double"), F.col("tot_ref")), F.lit(eps)))
    pc = F.when(some, F.greatest(F.try_divide(F.col("n_cur").cast("double"), F.col("tot_cur")), F.lit(eps)))
    g = c.groupBy("feature").agg(F.sum((pc - pr) * F.log(pc / pr)).alias("psi"))
    return g.withColumn("drifted", (F.col("psi") > threshold).cast("int"))


def target_psi(ref: DataFrame, cur: DataFrame, target: str, threshold: float = PSI_THRESHOLD,
               eps: float = EPS) -> DataFrame:
    """PSI of the target's class shares."""
    s = stacked(ref, cur, [target])
    cnt = s.groupBy(F.lit(target).alias("feature"), F.col(target).cast("string").alias("bin")).agg(
        F.count_if(F.col("side") == "reference").alias("n_ref"),
        F.count_if(F.col("side") == "current").alias("n_cur"))
    return _psi_from_counts(cnt, threshold, eps)


def _category_counts(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    s = stacked(ref, cur, cols).select("side", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c)
                                                 for c in cols])
    long = s.unpivot(["side"], cols, "feature", "value")
    cnt = long.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "reference").alias("n_ref"),
        F.count_if(F.col("side") == "current").alias("n_cur"))
    tot = cnt.groupBy("feature").agg(F.sum("n_ref").alias("tot_ref"), F.sum("n_cur").alias("tot_cur"))
    return cnt.join(F.broadcast(tot), "feature")


def js_drift(ref: DataFrame, cur: DataFrame, cols: list[str], threshold: float = JS_THRESHOLD) -> DataFrame:
    """Jensen-Shannon distance (natural log) between category shares."""
    c = _category_counts(ref, cur, cols)
    p, q = (F.try_divide(F.col(f"n_{s}").cast("double"), F.col(f"tot_{s}")) for s in ("ref", "cur"))
    m = (p + q) / 2.0
    kl = lambda a: F.when(a.isNull(), F.lit(None)).when(a > 0, a * F.log(a / m)).otherwise(F.lit(0.0))
    g = c.groupBy("feature").agg(F.sum(0.5 * kl(p) + 0.5 * kl(q)).alias("_js"))
    return g.select("feature", F.sqrt(F.when(F.col("_js") < 0, F.lit(0.0)).otherwise(F.col("_js"))).alias("js_distance")) \
            .withColumn("drifted", (F.col("js_distance") > threshold).cast("int"))


def chi2_drift(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """Chi-square statistic of the 2 x k table (reference vs current) and its dof."""
    c = _category_counts(ref, cur, cols)
    n = F.col("tot_ref") + F.col("tot_cur")
    col_tot = F.col("n_ref") + F.col("n_cur")
    e_ref, e_cur = F.col("tot_ref") * col_tot / n, F.col("tot_cur") * col_tot / n
    term = F.try_divide((F.col("n_ref") - e_ref) ** 2, e_ref) + F.try_divide((F.col("n_cur") - e_cur) ** 2, e_cur)
    return c.groupBy("feature").agg(F.sum(term).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))


def drift_share(per_column: DataFrame) -> DataFrame:
    """Share of drifted columns (dataset-level drift of the preset)."""
    return per_column.agg(F.count(F.lit(1)).alias("n_columns"), F.sum("drifted").alias("n_drifted"),
                          (F.sum("drifted") / F.count(F.lit(1))).alias("share_drifted"))


def quality_by_side(ref: DataFrame, cur: DataFrame, label: str, score: str | None,
                    threshold: float = 0.5) -> DataFrame:
    """H1-H3 per side; a missing score column counts as the literal 0.0."""
    from loanlens.operators.evaluate import metrics_from_counts
    sc = (lambda df: F.col(score)) if score else (lambda df: F.lit(0.0))
    s = ref.select(F.lit("reference").alias("side"), F.col(label).alias("label"), sc(ref).alias("score")) \
        .unionByName(cur.select(F.lit("current").alias("side"), F.col(label).alias("label"), sc(cur).alias("score")))
    p, y = F.col("score") >= threshold, F.col("label") == 1
    cm = s.groupBy("side").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                               F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))
    h = written(s.groupBy("side", "score").agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")), "side-histogram")
    hb = h.crossJoin(F.broadcast(sketch_cuts(h, "score")))  # one row
    c = cumulative(hb, cut_bucket("score", descending=True), [F.desc("score")], ["pos", "neg"], groups=["side"])
    auc = c.groupBy("side").agg(F.try_divide(F.sum(F.col("neg") * (F.col("pos_cum") - F.col("pos") / 2.0)),
                                             F.sum("neg") * F.sum("pos")).alias("roc_auc"))
    return metrics_from_counts(cm).join(auc, "side")


def write_report(ref: DataFrame, cur: DataFrame, out_dir: str, target: str = "default",
                 exclude: tuple[str, ...] = ()) -> str:
    """A10: drift summary table (Parquet) and the HTML report next to it."""
    from loanlens.sources.io import write_table, write_text
    t = resolve_target(ref, cur, target)
    write_table(drift_summary(ref, cur, t, exclude), f"{out_dir}/drift_summary")
    write_text(ref.sparkSession, report_html(ref, cur, t, exclude), f"{out_dir}/monitoring_report.html")
    return out_dir
