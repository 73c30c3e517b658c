"""Global order without a single-task window.

``Window.orderBy(x)`` with no partition moves every row into one task, and
partitioning only by class gives two tasks. Instead (SURVEY §4.3):

1. put every row in a bucket by a monotone function of the order key: a hash
   prefix, or for values of any distribution the cuts of a quantile sketch
   (``sketch_cuts``, ``cut_bucket``), so that an outlier or a narrow range
   does not fill one bucket;
2. count rows (or sum values) per (group, bucket): at most groups x B rows;
3. cumulate those small totals into per-bucket offsets (a window over the
   k-row table) and broadcast them back;
4. rank / cumulate inside (group, bucket) partitions and add the offset.

The result equals the global window; the sort work is spread over
groups x B tasks. B is a parameter: raise it as the data grows so each
bucket stays within one task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.columns import null_safe_join
from loanlens.sources.stages import written

# Default bucket count of the offset scheme (16^4). Only non-empty buckets
# reach the offsets table, so small inputs pay nothing; at ~1e11 rows a
# (group, bucket) window partition holds ~2 million rows.
BUCKETS = 65536
ROWS_PER_BUCKET = 2048
# Cuts of a quantile sketch; one less than a power of two.
CUTS = 1023


def hex_digits_for(n: int, cap: int = 4) -> int:
    """md5-prefix length giving about ROWS_PER_BUCKET rows per bucket (1..cap)."""
    d = 1
    while d < cap and 16 ** d * ROWS_PER_BUCKET < n:
        d += 1
    return d


def md5_order_key(key: str, seed: int = 42) -> Column:
    """Seeded pseudo-random order: md5 of 'key|seed' (same text in DuckDB)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def md5_bucket(order_col: str, hex_digits: int = 4) -> Column:
    """First hex digits of an md5 string as an int bucket (monotone in the string)."""
    return F.conv(F.substring(F.col(order_col), 1, hex_digits), 16, 10).cast("int")


def score_bucket(score_col: str, buckets: "int | Column" = BUCKETS, descending: bool = False,
                 lo: "float | Column" = 0.0, hi: "float | Column" = 1.0) -> Column:
    """Bucket of a score in [lo, hi] (default [0, 1]); higher scores get higher
    buckets unless descending. Pass the observed min / max (columns of a
    one-row aggregate) for scores of any range."""
    nb = buckets if isinstance(buckets, Column) else F.lit(buckets)
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    frac = F.coalesce(F.try_divide(F.col(score_col) - lo_c, hi_c - lo_c), F.lit(0.0))
    b = F.least(F.greatest(F.floor(frac * nb), F.lit(0)), nb - 1).cast("int")
    return (nb - 1 - b) if descending else b


def sketch_cuts(hist: DataFrame, value: str, groups: list[str] | None = None,
                sums: dict[str, str] | None = None) -> DataFrame:
    """(groups..., _cuts, sums...): ``CUTS`` rising cut values of each group, from a quantile sketch.

    ``hist`` has one row for each distinct value (of a group), so the cuts
    share out distinct values whatever their distribution or frequency. The
    sketch is merged map-side; its error is a tenth of a bucket. ``sums``
    (name -> column) adds totals of the group in the same pass. The table (one
    row a group, 8 KB each) is written: every branch sees the same cuts.
    """
    shares = ", ".join(f"{i / (CUTS + 1)!r}D" for i in range(1, CUTS + 1))
    cuts = F.expr(f"percentile_approx(CAST(`{value}` AS DOUBLE), array({shares}), {10 * (CUTS + 1)})")
    aggs = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    return written(hist.groupBy(*(groups or [])).agg(cuts.alias("_cuts"), *aggs), "cuts")


def cut_bucket(value: str, descending: bool = False, cuts: str = "_cuts") -> Column:
    """Number of cuts below a value (0 to ``CUTS``) by binary search, or its
    reverse. Null comes first and NaN last, as in ``ORDER BY``."""
    v = F.col(value).cast("double")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(CUTS.bit_length()))])
    b = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(F.col(cuts), at + s - 1) < v, at + s).otherwise(at))
    return (F.lit(CUTS) - b) if descending else b


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[Column],
           name: str = "rank") -> DataFrame:
    """Add ``name`` = 1-based row_number within ``groups`` in ``order``.

    ``bucket`` must be non-decreasing in ``order`` (ties in order must share
    a bucket). Equal to ``row_number() over (partition by groups order by
    order)`` without a single-partition window. Meant for few groups (class
    labels, columns): the offsets table has groups x buckets rows. Null groups
    are groups like any other.
    With many groups a plain ``Window.partitionBy(groups)`` is already
    spread over tasks and needs no buckets.
    """
    b = df.withColumn("_bk", bucket)
    sizes = b.groupBy(*groups, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*groups).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*groups, "_bk", F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*groups, "_bk").orderBy(*order)
    out = (null_safe_join(b, offs, [*groups, "_bk"])
           .withColumn(name, (F.row_number().over(w) + F.col("_off")).cast("long")))
    return out.drop("_bk", "_off")


def cumulative(df: DataFrame, bucket: Column, order: list[Column], sums: list[str],
               groups: list[str] | None = None, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``sums`` in ``order`` (ties: rows must be distinct in order).

    Same offset scheme as ``ranked``: per-bucket totals are cumulated on the
    small table and added to a running sum inside each bucket partition. A
    null bucket comes first. Without groups the join and the window share one
    shuffle by bucket.
    """
    groups = groups or []
    b = df.withColumn("_bk", F.coalesce(bucket, F.lit(-1)))
    tot = b.groupBy(*groups, "_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wo = Window.partitionBy(*groups).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*groups, "_bk", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                                         for c in sums])
    w = Window.partitionBy(*groups, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = null_safe_join(b, offs, [*groups, "_bk"]) if groups else b.join(offs, "_bk")
    for c in sums:
        out = out.withColumn(f"{c}{suffix}", F.sum(c).over(w) + F.col(f"_o_{c}"))
    return out.drop("_bk", *[f"_o_{c}" for c in sums])


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, salt_col: str,
          salt: int = 256, name: str = "rank") -> DataFrame:
    """Rows ranked 1..k within ``groups`` by ``order`` (exact, two levels).

    Level 1 keeps the top k inside (groups, hash(salt_col) mod salt); level 2
    ranks the at most salt x k survivors per group. A group with many
    distinct rows (a high-cardinality column) is thus spread over ``salt``
    tasks instead of one. ``order`` must be a total order (include a
    tiebreaker) for the result to be deterministic.
    """
    s = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salt))
    w1 = Window.partitionBy(*groups, s).orderBy(*order)
    first = df.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1")
    w2 = Window.partitionBy(*groups).orderBy(*order)
    return first.withColumn(name, F.row_number().over(w2)).where(F.col(name) <= k)
