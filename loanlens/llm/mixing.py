"""Mixing sources to target weights by hash-threshold histograms.

Every source has a word budget (target). Whole passes over the source are
taken first; what is left of the budget is taken from the documents whose
hash lies under a threshold. The threshold comes from sums of sizes by
(source, hash bucket): the bucket in which the running sum passes the
budget is the boundary, and only its rows are counted again by the next
hash bits, until a boundary bucket holds one hash value. Then one filter on
the hash decides each document; no documents are sorted. All of it is
DataFrame code.

Defined results: a null text has size 0; a null source is a source of its
own, ordered last; rows with equal ids have equal hashes and are taken or
left together; an empty table gives an empty result; extra columns are kept
by :func:`apply_mix` and ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import WORD, drop_stage, free_name, staged, table, word_count
from loanlens.llm.registry import register

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BITS = 10          # hash bits of one histogram level
HASH_BITS = 60


def sizes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, h): the narrow table every later pass reads."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col)), 64 - HASH_BITS)
    return docs.select(F.col(id_col).alias("doc_id"), "source", word_count(F.col("text")).alias("size"), h.alias("h"))


def targets(per_source: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    The total is shared by weight; a target stops at ``max_repeat`` times its
    source and the rest is shared again among the others. The fixed point is
    ``least(cap, level * weight)`` with one level for all sources: with the
    sources in order of cap / weight and the first k capped, the level is the
    largest (total - their caps) / (weights of the others).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    after = ratio.rowsBetween(0, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = (per_source.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]),
                                                      ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * F.lit(max_repeat)))
    everyone = Window.partitionBy()
    w = (w.withColumn("_total", F.sum("source_size").over(everyone))
         .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                     / F.sum("weight").over(after))
         .withColumn("_level", F.max("_level").over(everyone)))
    return w.select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")).alias("target"))


def _same(a, b):
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, goals: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, source_size, target, passes, cut): rows with h < cut are taken once more.

    ``cut`` is chosen so that the sizes under it come nearest to the budget
    that whole passes leave.
    """
    # lo, hi: the range of hashes that still holds the boundary; budget: what it has to give
    state = goals.select("source", "source_size", "target",
                         F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
                         .cast("long").alias("passes"))
    state = state.withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    state = staged(state.withColumn("lo", F.lit(0).cast("long")).withColumn("open", F.col("budget") > 0), "mix-state")
    left = HASH_BITS
    while left > 0:
        shift = max(0, left - bits)
        b = state.filter("open").select(F.col("source").alias("s_source"), "lo")
        inside = rows.join(b, _same(F.col("source"), F.col("s_source"))
                           & (F.shiftright(F.col("h"), left) == F.shiftright(F.col("lo"), left)))
        hist = (inside.groupBy("s_source", F.shiftright("h", shift).alias("bucket"))
                .agg(F.sum("size").alias("in_bucket"), F.min("h").alias("h_min"), F.max("h").alias("h_max")))
        run = Window.partitionBy("s_source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("in_bucket").over(run))
        hit = (hist.join(state.filter("open").select(F.col("source").alias("t_source"), "budget"),
                         _same(F.col("s_source"), F.col("t_source")))
               .filter((F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("in_bucket") < F.col("budget"))))
        hit = hit.select(F.col("s_source").alias("f_source"), "bucket", (F.col("upto") - F.col("in_bucket")).alias("under"),
                         "in_bucket", "h_min", "h_max")
        rest = F.col("budget") - F.col("under")
        one = F.col("h_min") == F.col("h_max")
        # one hash value in the bucket: take it if that comes nearer to the budget
        cut_one = F.when(2 * rest >= F.col("in_bucket"), F.col("h_min") + 1).otherwise(F.col("h_min"))
        found = F.col("bucket").isNotNull()
        new = state.join(hit, _same(F.col("source"), F.col("f_source")), "left").select(
            "source", "source_size", "target", "passes",
            F.when(found, rest).otherwise(F.col("budget")).alias("budget"),
            F.when(found, F.when(one, cut_one).otherwise(F.shiftleft(F.col("bucket"), shift)))
            .otherwise(F.col("lo")).alias("lo"),
            F.when(found, ~one).otherwise(F.lit(False)).alias("open"))
        old, state = state, staged(new, "mix-state")
        drop_stage(old)
        left = shift
        if state.filter("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "passes", F.col("lo").alias("cut"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: doc_id, h, size, source_size, target, copies, taken."""
    rows = staged(sizes(docs), "mix-sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    cuts = thresholds(rows, goals).withColumnRenamed("source", "c_source")
    copies = (F.col("passes") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0))
    return (rows.join(cuts, _same(F.col("source"), F.col("c_source"))).withColumn("copies", copies.cast("int"))
            .select("doc_id", "source", "h", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def apply_mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 to ``max_repeat`` times)."""
    rows = staged(sizes(docs), "mix-sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    cuts = thresholds(rows, goals).select(F.col("source").alias("_c_source"), "passes", "cut")
    h = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id")), 64 - HASH_BITS)
    n = (F.col("_c.passes") + F.when(h < F.col("_c.cut"), 1).otherwise(0)).cast("int")
    out = docs.alias("_d").join(cuts.alias("_c"), _same(F.col("_d.source"), F.col("_c._c_source")))
    copy = free_name(docs, "_copy")
    return (out.select("_d.*", F.explode(F.array_repeat(F.lit(1), n)).alias(copy)).drop(copy))


@register("op7_mixing")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document by the mix of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
