"""SimHash near-duplicates by multi-index hashing.

Fingerprint: the text is lower-cased (A-Z), cut into words and into shingles
of ``shingle`` words; a bit is set if it is set in more than half of the
shingles' XXH64 values. Distinct fingerprints, not documents, are linked, so
a group of equal copies is one row from then on.

Links at ``max_bits`` or fewer differing bits: the fingerprint is cut into m
segments. If every segment of two linked fingerprints differed by more than
its radius, the whole would differ by more than ``max_bits``; with r =
max_bits // m, the first (max_bits - r m + 1) segments have radius r, the
others r - 1. Every fingerprint therefore looks up, in the table of each
segment, all values of the small Hamming ball around its own value; matches
are verified on all 64 bits inside the join. m follows from the number of
fingerprints by the cost of probes and candidates: 5 to 3 segments up to
about 1e8 distinct fingerprints (``max_bits`` 4), then two of 32 bits.

A segment value shared by more than ``hot`` times as many fingerprints as
evenly spread ones would share it (a dense group of near copies) would yield
all pairs of the group. Such fingerprints are
linked another way, also exact: two fingerprints at ``max_bits`` or fewer
share a member of their Hamming balls in the 64-bit space, one of radius
floor(max_bits / 2), the other of radius ceil(max_bits / 2). All members of
the larger ball are linked to the smallest fingerprint of the smaller one,
from which they differ by ``max_bits`` at most. That is linear in the group.

Components come from min-label contraction over written tables; nothing is
collected to the driver.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; texts with fewer words than a shingle use all their words as
one; null ids sort last as representatives; repeated rows share their
fingerprint; an empty table gives an empty result. Other columns are passed
through by :func:`keep_one` and ignored elsewhere. Long texts are hashed in
blocks of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import LOWER, UPPER, drop_stage, free_name, staged, table, without
from loanlens.llm.registry import register

SHINGLE = 4
MAX_BITS = 4
SEED = 42
HOT = 64
PROBE = 4
BLOCK_WORDS = 200_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: _BITS[k] counts, for byte value k, its eight bits.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text (see the module's text)."""
    import xxhash
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = max(1, len(words) - shingle + 1) if words else 0
    if not n:
        return 0
    ones = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK_WORDS):
        part = words[lo:lo + BLOCK_WORDS + shingle - 1]
        m = min(n - lo, BLOCK_WORDS)
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = ends[min(shingle, len(part)) - 1:][:m]
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:m].tolist(), last.tolist(), strict=True)),
                        np.uint64, m).astype("<u8").view(np.uint8).reshape(m, 8)
        for k in range(8):
            ones[k] += np.bincount(h[:, k], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): fp is the fingerprint as a signed long, th a hash of the text."""
    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return docs.select("doc_id", F.xxhash64("text").alias("th"), fp("text").alias("fp"))


def ball_masks(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits among ``bits``."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)] if radius >= 0 else []


def lookup_cost(n: int, parts: list[tuple[int, int, int]]) -> tuple[int, float]:
    """(probes, expected candidates) of one fingerprint among ``n`` evenly spread ones."""
    sizes = [(sum(math.comb(bits, r) for r in range(radius + 1)), bits) for _, bits, radius in parts]
    return sum(s for s, _ in sizes), sum(n * s / (1 << bits) for s, bits in sizes)


def segments(n: int, max_bits: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment for about ``n`` fingerprints.

    Few wide segments have large balls (probes), many narrow ones have
    crowded values (candidates). The number of segments is the one with the
    least work for a fingerprint, a probe (a shuffled row) counted as
    ``PROBE`` candidates (rows met inside the join). More than ``max_bits`` +
    1 segments have no use.
    """
    def cut(m: int) -> list[tuple[int, int, int]]:
        r, wide = max_bits // m, max_bits - max_bits // m * m + 1
        edges = [64 * i // m for i in range(m + 1)]
        return [(lo, hi - lo, r if i < wide else r - 1) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]

    def work(parts) -> float:
        probes, candidates = lookup_cost(n, parts)
        return PROBE * probes + candidates
    # one segment is the whole fingerprint: its ball has hundreds of thousands of members from 4 bits on
    return min((cut(m) for m in range(min(2, max_bits + 1), max_bits + 2)), key=work)


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all pairs within ``max_bits``.

    Every pair outside hot segment values is an edge; inside them the edges
    are stars that connect the same fingerprints.
    """
    n = fps.count()
    parts = [s for s in segments(n, max_bits) if s[2] >= 0]
    value = lambda c, s: F.shiftrightunsigned(c, s[0]).bitwiseAND((1 << s[1]) - 1)
    keyed = fps.select("fp", F.posexplode(F.array(*[value(F.col("fp"), s) for s in parts])).alias("seg", "v"))
    even = F.array(*[F.lit(max(1.0, n / (1 << bits))) for _, bits, _ in parts])
    sizes = staged(keyed.groupBy("seg", "v").agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") > hot * even[F.col("seg")]).drop("n"), "hot-values")
    balls = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
    for i, (_, bits, radius) in enumerate(parts):
        balls = balls.when(F.col("seg") == i, F.transform(F.array(*[F.lit(m).cast("long") for m in ball_masks(bits, radius)]),
                                                          lambda m: m.bitwiseXOR(F.col("v"))))
    probes = keyed.select("fp", "seg", F.explode(balls).alias("v"))
    some_hot = not sizes.isEmpty()
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    t, p = keyed, probes
    if some_hot:
        t, p = (x.join(sizes, ["seg", "v"], "left_anti") for x in (t, p))
    t, p = t.withColumnRenamed("fp", "a"), p.withColumnRenamed("fp", "b")
    # the ball is symmetric, so the smaller of two fingerprints is always found by the larger
    out = p.join(t.hint("merge"), (t["seg"] == p["seg"]) & (t["v"] == p["v"]) & (t["a"] < p["b"]) & near(t["a"], p["b"])).select("a", "b")
    if some_hot:
        inside = staged(probes.join(sizes, ["seg", "v"], "left_semi").select("fp").distinct(), "hot-members")
        masks = F.array(*[F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long") for m in ball_masks(64, (max_bits + 1) // 2)])
        center = inside.select("fp", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("c"))
        # exploded rows are many times what the planner takes them for, so no side is broadcast
        inner = F.bit_count(F.col("c").bitwiseXOR(F.col("fp"))) <= max_bits // 2
        least = F.min(F.when(inner, F.col("fp"))) if max_bits % 2 else F.min("fp")
        star = center.join(center.groupBy("c").agg(least.alias("a"), F.min("fp").alias("y"), F.max("fp").alias("z"))
                           .filter("a IS NOT NULL AND y < z").select("c", "a").hint("merge"), "c")
        out = out.unionByName(star.filter("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")))
    return out.distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b).

    Each round maps every node to its smallest neighbour (or itself) and
    contracts the edges; the nodes left at least halve where edges are left.
    """
    edges = staged(edges.select("a", "b"), "edges")
    label = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = staged(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "step")
        if label is None:
            new = step.withColumnRenamed("to", "root")
        else:
            hop = step.select(F.col("node").alias("root"), F.col("to"))
            new = label.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        old_label, label = label, staged(new, "label")
        moved = (edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
                 .join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
                 .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct())
        old, edges = edges, staged(moved, "edges")
        for x in (old, step, old_label):
            if x is not None:
                drop_stage(x)
    else:
        raise RuntimeError("components did not settle")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(rows: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with root and component_id, the smallest doc_id reachable over links.

    Columns of ``rows`` with these two names are replaced.
    """
    rows = without(rows, "root", "component_id")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    member = components(links(fps.select("fp"), max_bits, hot))
    of = fps.join(member, fps["fp"] == member["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component: the smallest (doc_id, hash of the text), once if rows repeat."""
    rows = staged(fingerprints(docs, shingle), "simhash")
    near = near_duplicates(rows, max_bits)
    # null ids sort behind all others
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "th")
    keep = near.groupBy("root").agg(F.min(order).alias("k")).select(
        F.col("k.doc_id").alias("_k_id"), F.col("k.th").alias("_k_th"))
    th = free_name(docs, "_th")
    d = docs.withColumn(th, F.xxhash64("text"))
    kept = d.join(keep, d["doc_id"].eqNullSafe(keep["_k_id"]) & (d[th] == keep["_k_th"]), "left_semi")
    return kept.dropDuplicates(["doc_id", th]).drop(th)


@register("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    rows = staged(fingerprints(table(spark, sf_dir, "documents")), "simhash")
    return near_duplicates(rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
