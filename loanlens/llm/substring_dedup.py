"""Repeats of ``length`` words found by difference-cover anchors and removed.

A word goes if it lies in a window of ``length`` words of one document that
also starts in a document with a smaller id.

Anchors. A difference cover of a period v is a set of residues such that any
two positions meet it together after the same shift of less than v. Only
positions with such a residue are hashed, each over the next
``length - v + 1`` words: two equal windows, wherever they start, have an
equal anchor at the same place inside them. For 50 words the period is 31
with 6 residues, so 19 % of the positions are hashed, 20 words each.

Extending. An anchor that occurs in several documents is compared with the
words around it, as far as a window that contains it can reach (30 words on
either side, less at a text's ends):

1. where all occurrences of the anchor, or several of them, have the same
   surroundings, the match extends to all of these windows at once: they go
   from every document but the smallest one with these surroundings;
2. the smallest documents of different surroundings still may share some of
   these windows: the anchor is extended to each window around it, windows
   are met by the 128-bit hash of their words, and the later document's goes.

No pairs of occurrences are made. Every step is an aggregation with a
map-side part or a join with its result in which frequent keys are dealt over
many tasks (:func:`loanlens.llm.joins.counted_join`).

Defined results: a null or empty text has no words; rows with a null id stay
whole and are nobody's smaller document; equal ids are one document to each
other (nothing is removed between them), equal rows have equal results;
shorter texts stay whole; an empty table gives an empty result; extra columns
are ignored, whatever their names. Long texts are hashed in pieces, with the
overlap their windows need. Ids are whole numbers (read as long).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import drop_stage, staged, table
from loanlens.llm.joins import counted_join
from loanlens.llm.registry import register
from loanlens.llm.rolling import Runs, columns, mix, signed, text_bytes, word_hashes
from loanlens.llm.suffix_repeats import numbered

LENGTH = 50
# Smallest difference covers (perfect difference sets) by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18),
          57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Words hashed together.
BLOCK = 1 << 17
_POS = 40   # a place packs: row | word position


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """(period, residues): the longest period that leaves an anchor over a third of ``length`` words."""
    if length < 2:
        raise ValueError("length must be two words or more")
    period = max(v for v in COVERS if 3 * v <= 2 * length)
    return period, COVERS[period]


def _anchor_rows(length: int):
    period, residues = cover_for(length)
    width, reach = length - period + 1, period - 1
    is_cover = np.isin(np.arange(period), residues)

    def anchors(parts: list[tuple[int, int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
        """Parts are (doc, row, words of the document, place of the first word, of the first anchor, hashes)."""
        sizes = np.array([len(p[5]) for p in parts])
        base = np.cumsum(sizes) - sizes
        runs = Runs(mix(np.concatenate([p[5] for p in parts])))
        which = np.repeat(np.arange(len(parts)), sizes)
        doc, row, n, first, lo = (np.array(x, np.int64) for x in list(zip(*parts, strict=True))[:5])
        pos = np.arange(sizes.sum()) - base[which] + first[which]
        hi = np.minimum(lo + BLOCK, n - width + 1)
        at = np.flatnonzero(is_cover[pos % period] & (pos >= lo[which]) & (pos < hi[which]))
        which, pos = which[at], pos[at]
        left, right = np.minimum(reach, pos), np.minimum(reach, n[which] - width - pos)
        h = runs(at, at + width)
        around = mix(runs(at - left, at + width + right) ^ (left << 32 | right).astype(np.uint64))
        return pa.RecordBatch.from_arrays([signed(h), signed(around), pa.array(doc[which]), pa.array(row[which] << _POS | pos)],
                                          names=["h", "c", "doc", "at"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for doc, row, text in columns(b, "doc", "row", "text"):
                words = word_hashes(text_bytes(text))
                if len(words) < length:
                    continue
                for lo in range(0, len(words) - width + 1, BLOCK):
                    first = max(0, lo - reach)
                    part = words[first:lo + BLOCK + width + reach]
                    parts.append((doc.as_py(), row.as_py(), len(words), first, lo, part))
                    held += len(part)
                    if held >= BLOCK:
                        yield anchors(parts)
                        parts, held = [], 0
        if parts:
            yield anchors(parts)
    return rows


def _places(cell: pa.Scalar, row: int) -> np.ndarray:
    """Sorted word positions of this row in a list of places."""
    if not cell.is_valid:
        return np.zeros(0, np.int64)
    at = cell.values.to_numpy(zero_copy_only=False)
    return np.sort(at[at >> _POS == row] & (1 << _POS) - 1)


def _around(anchors: np.ndarray, n: int, length: int, period: int) -> np.ndarray:
    """Whether each window of a text of ``n`` words contains one of the anchors."""
    edge = np.zeros(n - length + 2, np.int64)
    np.add.at(edge, np.maximum(anchors - period + 1, 0), 1)
    np.add.at(edge, np.minimum(anchors, n - length) + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _window_rows(length: int):
    period, _ = cover_for(length)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, text, open_, sure in columns(b, "doc", "row", "text", "open", "sure"):
                words = word_hashes(text_bytes(text))
                anchors = _places(open_, row.as_py())
                if len(words) < length or not len(anchors):
                    continue
                wanted = _around(anchors, len(words), length, period)
                wanted &= ~_around(_places(sure, row.as_py()), len(words), length, period)
                for lo in range(0, len(wanted), BLOCK):
                    at = np.flatnonzero(wanted[lo:lo + BLOCK])
                    part = words[lo:lo + BLOCK + length - 1]
                    g1 = Runs(mix(part ^ np.uint64(1)))(at, at + length)
                    g2 = Runs(mix(part ^ np.uint64(2)))(at, at + length)
                    yield pa.RecordBatch.from_arrays(
                        [signed(g1), signed(g2), pa.array(np.full(len(at), doc.as_py(), np.int64)),
                         pa.array((at + lo) | row.as_py() << _POS)], names=["g1", "g2", "doc", "at"])
    return rows


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, at, anchor): places whose windows also start in a smaller document.

    ``docs`` is (doc, row, text). A place is one window or, where ``anchor``
    is true, an anchor whose every window goes.
    """
    occ = docs.filter("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(_anchor_rows(length), "h long, c long, doc long, at long")
    shared = staged(occ.groupBy("h").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("c").alias("c0"),
                                         F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"))
                    .filter("d0 < d1").select("h", "d0", F.expr("c0 < c1").alias("many"), "n"), "substring-shared")
    hits = staged(counted_join(occ, shared, ["h"]).filter("many OR d0 < doc"), "substring-hits")
    many = hits.filter("many").select("h", "c", "doc", "at")
    around = staged(many.groupBy("h", "c").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")), "substring-around")
    judged = staged(counted_join(many, around, ["h", "c"]).select("doc", "at", F.expr("first < doc").alias("sure"))
                    .unionByName(hits.filter("NOT many").select("doc", "at", F.lit(True).alias("sure"))), "substring-judged")
    lists = judged.groupBy("doc").agg(F.collect_list(F.when(~F.col("sure"), F.col("at"))).alias("open"),
                                      F.collect_list(F.when(F.col("sure"), F.col("at"))).alias("sure"))
    texts = docs.join(lists.filter(F.size("open") > 0), "doc").select("doc", "row", "text", "open", "sure")
    windows = staged(texts.mapInArrow(_window_rows(length), "g1 long, g2 long, doc long, at long"), "substring-windows")
    twice = staged(windows.groupBy("g1", "g2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"),
                                                   F.count(F.lit(1)).alias("n")).filter("first < last").drop("last"), "substring-twice")
    late = counted_join(windows, twice, ["g1", "g2"]).filter("first < doc")
    out = staged(judged.filter("sure").select("doc", "at", F.lit(True).alias("anchor"))
                 .unionByName(late.select("doc", "at", F.lit(False).alias("anchor"))), "substring-places")
    for done in (shared, hits, around, judged, windows, twice):
        drop_stage(done)
    return out


def _cut(length: int):
    period, _ = cover_for(length)
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc, row, text, windows, anchors in columns(b, "doc", "row", "text", "windows", "anchors"):
                words = text_bytes(text).split()
                n, spans = len(words), []
                at, ach = _places(windows, row.as_py()), _places(anchors, row.as_py())
                if len(at) or len(ach):
                    bad = _around(ach, n, length, period)
                    bad[at] = True
                    edge = np.zeros(n + 1, np.int64)
                    edge[:len(bad)] += bad
                    edge[length:length + len(bad)] -= bad
                    border = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(edge)[:n] > 0, [0]])))
                    spans = [{"first": int(lo), "last": int(hi) - 1} for lo, hi in zip(border[::2], border[1::2], strict=True)]
                    edges = [0, *border.tolist(), n]
                    words = [w for lo, hi in zip(edges[::2], edges[1::2], strict=True) for w in words[lo:hi]]
                for o, v in zip(out, (doc.as_py(), n, spans, b" ".join(words)), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(span)),
                 pa.array(out[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])
    return cut


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, spans, kept) of every document.

    spans are the removed runs of words (first and last position, from 0);
    kept is the remaining words, joined by one space.
    """
    d = numbered(docs)
    places = repeated_windows(d, length)
    lists = places.groupBy("doc").agg(F.collect_list(F.when(~F.col("anchor"), F.col("at"))).alias("windows"),
                                      F.collect_list(F.when(F.col("anchor"), F.col("at"))).alias("anchors"))
    return (d.join(lists, "doc", "left").select("doc", "row", "text", "windows", "anchors")
            .mapInArrow(_cut(length), "doc_id long, n_words long, spans array<struct<first: long, last: long>>, kept string"))


# The same windows by plain grouping, one row a word; a window's key doubles up: 50 = 32 + 16 + 2.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
h1 AS (SELECT *, md5(word) AS k FROM p),
h2 AS (SELECT r, doc_id, word, i, md5(k || lead(k, 1) OVER o) AS k2 FROM h1 WINDOW o AS (PARTITION BY r ORDER BY i)),
h4 AS (SELECT *, md5(k2 || lead(k2, 2) OVER o) AS k FROM h2 WINDOW o AS (PARTITION BY r ORDER BY i)),
h8 AS (SELECT r, doc_id, word, i, k2, md5(k || lead(k, 4) OVER o) AS k FROM h4 WINDOW o AS (PARTITION BY r ORDER BY i)),
h16 AS (SELECT r, doc_id, word, i, k2, md5(k || lead(k, 8) OVER o) AS k16 FROM h8 WINDOW o AS (PARTITION BY r ORDER BY i)),
h32 AS (SELECT *, md5(k16 || lead(k16, 16) OVER o) AS k32 FROM h16 WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, doc_id, word, i, k32 || lead(k16, 32) OVER o || lead(k2, 48) OVER o AS win FROM h32 WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT win, min(doc_id) AS first FROM g WHERE win IS NOT NULL GROUP BY win),
b AS (SELECT g.r, g.i, g.word, CAST(coalesce(f.first < g.doc_id, false) AS INT) AS late FROM g LEFT JOIN f ON g.win = f.win),
c AS (SELECT r, i, word, max(late) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM b),
k AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


@register("op11_substring_dedup", SQL)
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat 50-word windows of smaller documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
