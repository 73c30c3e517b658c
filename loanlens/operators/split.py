"""Stratified split, stratified folds and class weights.

Both the split and the folds follow a seeded md5 order inside each class. The
split puts the first ``ceil(test_size * n_c)`` rows of each class in the test
part. It needs no ranking of all rows: a histogram of hash prefixes tells in
which bucket that row lies, only the rows of that one bucket are ranked, and
the place of the last test row is the class's cut; the split is a comparison
with it, so whole rows are not shuffled. Folds are ``(rank - 1) mod k``
(``ranks.ranked``, spread over class x hash-prefix tasks). The result is a
column, never a positional join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.columns import null_safe_join
from loanlens.operators.ranks import hex_digits_for, md5_bucket, md5_order_key, ranked
from loanlens.sources.stages import written

#: Classes up to which their table (about 100 bytes a row) is broadcast.
MAX_BROADCAST_CLASSES = 10_000


def _class_ranked(df: DataFrame, key: str, label: str, seed: int, hex_digits: int) -> DataFrame:
    d = df.withColumn("_ord", md5_order_key(key, seed))
    return ranked(d, [label], md5_bucket("_ord", hex_digits), [F.col("_ord"), F.col(key)], "_rk")


def largest_class(df: DataFrame, label: str) -> int:
    """Rows of the largest class (one row reaches the driver)."""
    return class_counts(df, label).agg(F.max("n")).first()[0] or 0


def _with_classes(df: DataFrame, classes: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """Join a table of one row a class: broadcast while it is small, by shuffle for a label of many values."""
    return null_safe_join(df, F.broadcast(classes) if n <= MAX_BROADCAST_CLASSES else classes, keys, how)


def split_cuts(df: DataFrame, key: str, label: str, test_size: float, seed: int, hex_digits: int = 4) -> tuple[DataFrame, int]:
    """(label, _cut) with the place (md5, key) of each class's last test row, and the number of classes.

    Reads the two columns twice: once to count rows by class and hash prefix
    (map-side combined), once for the rows of the boundary prefix. A class
    without test rows has no cut.
    """
    rows = df.select(label, F.struct(md5_order_key(key, seed).alias("o"), F.col(key).alias("k")).alias("_at"))
    rows = rows.withColumn("_bk", md5_bucket("_at.o", hex_digits))
    sizes = rows.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    cls = Window.partitionBy(label)     # 16 ** hex_digits rows a class at most
    upto = F.sum("_n").over(cls.orderBy("_bk").rowsBetween(Window.unboundedPreceding, 0))
    goal = F.ceil(F.sum("_n").over(cls) * F.lit(test_size))
    edge = written(sizes.withColumn("_upto", upto).withColumn("_goal", goal)
                   .where((F.col("_upto") >= F.col("_goal")) & (F.col("_upto") - F.col("_n") < F.col("_goal")))
                   .select(label, "_bk", (F.col("_goal") - F.col("_upto") + F.col("_n")).alias("_need")), "split-edge")
    n = edge.count()
    last = F.row_number().over(Window.partitionBy(label).orderBy("_at"))
    cuts = (_with_classes(rows, edge, [label, "_bk"], n).withColumn("_rk", last).where(F.col("_rk") == F.col("_need"))
            .select(label, F.col("_at").alias("_cut")))
    return written(cuts, "split-cuts"), n


def stratified_split(df: DataFrame, key: str = "app_id", label: str = "loan_status",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` ('train' / 'test'), exact ceil(test_size * n_c) test rows per class.

    Rows with a null label are a class of their own. ``key`` is expected to be
    unique; rows that repeat a key go to the same part, so a repeated key at
    the cut can add to the test part.
    """
    cuts, n = split_cuts(df, key, label, test_size, seed)
    at = F.struct(md5_order_key(key, seed).alias("o"), F.col(key).alias("k"))
    r = _with_classes(df, cuts, [label], n, "left")
    is_test = F.col("_cut").isNotNull() & (at <= F.col("_cut"))
    return r.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_cut")


def stratified_folds(df: DataFrame, key: str = "app_id", label: str = "loan_status",
                     k: int = 5, seed: int = 42, hex_digits: int | None = None) -> DataFrame:
    """Add ``fold`` in [0, k): round-robin over the seeded order within each class."""
    if hex_digits is None:
        hex_digits = hex_digits_for(largest_class(df, label))
    r = _class_ranked(df, key, label, seed, hex_digits)
    return r.withColumn("fold", F.pmod(F.col("_rk") - 1, F.lit(k)).cast("int")).drop("_ord", "_rk")


def class_counts(df: DataFrame, label: str = "loan_status") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_ratio(df: DataFrame, label: str = "loan_status") -> DataFrame:
    """n0 / n1 (the positive-class weight of the boosting model)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")) \
             .withColumn("ratio", F.try_divide(F.col("n0").cast("double"), F.col("n1")))


def class_weights(df: DataFrame, label: str = "loan_status") -> DataFrame:
    """Balanced weights n / (n_classes * n_c) per class (k rows)."""
    c = class_counts(df, label)
    total = c.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(F.broadcast(total)).select(  # one row
        label, "n", (F.col("_n") / (F.col("_k") * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label: str = "loan_status", name: str = "weight") -> DataFrame:
    """Attach the balanced weight column by a join with the class table.

    Rows are not shuffled by their class while there are few: that would leave one task for each class.
    """
    w = written(class_weights(df, label).select(label, F.col("weight").alias(name)), "class-weights")
    return _with_classes(df, w, [label], w.count(), "left")
