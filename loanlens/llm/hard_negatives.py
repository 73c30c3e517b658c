"""Hard negatives of anchor vectors by a secondary-sort shuffle.

Anchors are the rows whose id is divisible by ``every``; an anchor's score
with a row is the inner product of their whole-number vectors. Its positives
are its first rows of the same label, and each positive opens a window of
scores, from its own down to ``floor_pct`` per cent of it, whose first rows of
other labels are the positive's negatives.

Scores. Rows are dealt into chunks; each chunk meets all anchors, which pass
it block after block (the query set against all rows), and scores are one
matrix product a block. A chunk sends on at most ``positives`` rows of the
anchor's label, later at most ``negatives`` rows for each of the anchor's
windows, highest scores first: the first rows of the whole table are among
the first rows of its chunks, so nothing is lost and what is shuffled does not
hold all pairs.

Secondary sort. Each sent row is packed into a key (anchor, descending score
with positives before negatives of the same score, id). The rows are dealt by
anchor and sorted within the partitions by the whole key; one pass over a
sorted partition opens a window at each positive, gives each negative to the
windows that are open for its score, and forgets all at the next anchor. It
holds the open windows (``positives`` of them), never an anchor's rows.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; a shorter vector counts as continued by
zeros; every row counts, equal rows too, but rows with the anchor's own id are
not its partners; equal anchor rows (id, label and vector) are one anchor,
other rows that share an anchor's id are anchors of their own; an anchor
without positives or a positive without negatives gives no row; an empty
table gives an empty result; other columns are ignored, whatever their names.
Components are exact while their products' sums fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import staged, table
from loanlens.llm.registry import register

EVERY = 100
POSITIVES = 5
NEGATIVES = 5
FLOOR_PCT = 80
SCALE = 256
#: Rows of a chunk, which a task holds (as doubles), and anchors of a block.
CHUNK = 1 << 16
BLOCK = 512


def vectors(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """(id, label, vec) of the rows that take part; vec holds floor(256 x)."""
    x = F.col("embedding")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
            .select(F.col("vec_id").cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                    whole.alias("vec")))


def _matrix(cells: pa.Array) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones continued by zeros."""
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    size = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: in doubles while these are exact, else in 64-bit whole numbers."""
    width = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :width], anchors[:, :width]
    if width * np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) < 2 ** 53:
        return (rows @ anchors.T).astype(np.int64)
    return rows.astype(np.int64) @ anchors.astype(np.int64).T


class Chunk:
    """Rows of one chunk in order of id, so that a stable sort by score breaks ties by id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vecs = ids[order], labels[order], vecs[order]

    def positives(self, ids, labels, vecs, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, scores, ids) of each anchor's first k rows of its label."""
        for label in np.unique(labels).tolist():
            own, which = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
            if not len(own):
                continue
            scores = _scores(self.vecs[own], vecs[which])
            for j, a in enumerate(which.tolist()):
                best = own[first(scores[:, j], self.ids[own] != ids[a], k)]
                yield a, _scores(self.vecs[best], vecs[a:a + 1])[:, 0], self.ids[best]

    def negatives(self, ids, labels, vecs, windows: list[list[int]], k: int, floor_pct: int):
        """(anchor, scores, ids) of the first k rows of other labels in each of the anchor's windows."""
        scores = _scores(self.vecs, vecs)
        for a, tops in enumerate(windows):
            s = scores[:, a]
            inside = (100 * s <= 100 * max(tops)) & (100 * s >= floor_pct * min(tops))
            at = np.flatnonzero(inside & (self.labels != labels[a]) & (self.ids != ids[a]))
            at = at[np.argsort(-s[at], kind="stable")]
            wanted = np.zeros(len(at), bool)
            for top in tops:
                lo = np.searchsorted(-s[at], -top)
                hi = np.searchsorted(-100 * s[at], -floor_pct * top, side="right")
                wanted[lo:min(hi, lo + k)] = True
            at = at[wanted]
            yield a, s[at], self.ids[at]


def first(scores: np.ndarray, able: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores among ``able``, ties by place."""
    at = np.flatnonzero(able)
    if len(at) > k:
        line = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= line]
    return at[np.argsort(-scores[at], kind="stable")][:k]


def _meet(find, with_windows: bool):
    """Rows sorted by (chunk, anchor), the chunk's own rows (anchor -1) first -> (anchor, score, id)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        chunk, held, number = None, None, None

        def close(parts: list[tuple]) -> tuple:
            ids, labels = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            width = max(p[2].shape[1] for p in parts)
            vecs = np.concatenate([np.pad(p[2], ((0, 0), (0, width - p[2].shape[1]))) for p in parts])
            return ids, labels, vecs

        for b in batches:
            c, anchors, ids, labels = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False)
                                       for n in ("chunk", "anchor", "id", "label"))
            vecs = b.column(b.schema.get_field_index("vec"))
            tops = b.column(b.schema.get_field_index("tops")).to_pylist() if with_windows else None
            edges = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | ((anchors[1:] < 0) != (anchors[:-1] < 0)), True])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if c[lo] != number:
                    own, held, number = [], None, c[lo]
                if anchors[lo] < 0:
                    own.append((ids[lo:hi], labels[lo:hi], _matrix(vecs.slice(lo, hi - lo))))
                    continue
                if not own and held is None:
                    continue        # a chunk without rows
                if held is None:
                    held, own = Chunk(*close(own)), []
                for at in range(lo, hi, BLOCK):
                    to = min(hi, at + BLOCK)
                    args = (ids[at:to], labels[at:to], _matrix(vecs.slice(at, to - at)))
                    out = [(anchors[at + a], s, i) for a, s, i in find(held, *args, tops[at:to] if with_windows else None)]
                    if not out:
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array([a for a, _, _ in out], np.int64), [len(s) for _, s, _ in out])),
                         pa.array(np.concatenate([s for _, s, _ in out])), pa.array(np.concatenate([i for _, _, i in out]))],
                        names=["anchor", "score", "id"])
    return rows


def _against(rows: DataFrame, anchors: DataFrame, chunks: int, find, with_windows: bool = False) -> DataFrame:
    """(anchor, score, id) found by ``find`` in each chunk of rows for every anchor."""
    tops = "tops" if with_windows else F.lit(None).cast("array<long>").alias("tops")
    own = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int").alias("chunk"),
                      F.lit(-1).cast("long").alias("anchor"), "id", "label", "vec", F.lit(None).cast("array<long>").alias("tops"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "anchor", "id", "label", "vec", tops)
    both = own.unionByName(asked).repartition(chunks, "chunk").sortWithinPartitions("chunk", "anchor")
    return both.mapInArrow(_meet(find, with_windows), "anchor long, score long, id long")


def _stream(positives: int, negatives: int, floor_pct: int):
    """Rows sorted by (anchor, key, id) -> (anchor, positive_id, rank, negative_id, positive_score, negative_score)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, opened, windows = None, 0, []
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("anchor", "key", "id")]
            for a, key, row in zip(*cols, strict=True):
                if a != anchor:
                    anchor, opened, windows = a, 0, []
                score = -(key >> 1)
                if not key & 1:
                    if opened < positives:
                        opened += 1
                        windows.append([score, row, 0])
                    continue
                windows = [w for w in windows if w[2] < negatives and 100 * score >= floor_pct * w[0]]
                for w in windows:
                    w[2] += 1
                    for o, v in zip(out, (a, w[1], w[2], row, w[0], score), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 2 else pa.int64()) for i, x in enumerate(out)],
                                             names=["anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return emit


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         floor_pct: int = FLOOR_PCT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (id, label, vec).

    A negative's score lies between ``floor_pct`` per cent of the positive's
    and the positive's own. ``rows`` is read three times: pass a written table.
    """
    spark = rows.sparkSession
    n = rows.count()
    chunks = max(-(-n // CHUNK), 2 * spark.sparkContext.defaultParallelism)
    asked = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "label", "vec"])
    # numbers that grow with the partition tell equal ids apart; written once, so that they stay
    anchors = staged(asked.withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")

    def same(chunk, ids, labels, vecs, _):
        return chunk.positives(ids, labels, vecs, positives)

    def other(chunk, ids, labels, vecs, tops):
        return chunk.negatives(ids, labels, vecs, tops, negatives, floor_pct)

    keyed = lambda df, flag: df.select("anchor", (F.col("score") * -2 + flag).alias("key"), "id")
    by_key = lambda df: df.repartition("anchor").sortWithinPartitions("anchor", "key", "id")
    found = by_key(keyed(_against(rows, anchors, chunks, same), 0)).mapInArrow(_leading(positives), "anchor long, key long, id long")
    found = staged(found, "negatives-positives")
    tops = found.groupBy("anchor").agg(F.collect_list(-F.shiftright("key", 1)).alias("tops"))  # at most ``positives``
    sent = keyed(_against(rows, anchors.join(tops, "anchor"), chunks, other, True), 1)
    mined = by_key(found.unionByName(sent)).mapInArrow(
        _stream(positives, negatives, floor_pct),
        "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return (mined.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _leading(k: int):
    """The first k rows of each anchor of rows sorted by (anchor, key, id)."""
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, seen = None, 0
        for b in batches:
            a = b.column(0).to_numpy()
            start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
            if len(a) and a[0] == anchor:
                place[:start[1] if len(start) > 1 else len(a)] += seen
            if len(a):
                anchor, seen = a[-1], place[-1] + 1
            yield b.filter(pa.array(place < k))
    return lead


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
             CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
      FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
                   AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@register("op13_hard_negatives", SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels moved to the next class."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = staged(vectors(table(spark, sf_dir, "embeddings"), label), "negatives-rows")
    return mine(rows)
