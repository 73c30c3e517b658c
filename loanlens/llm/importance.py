"""Importance resampling towards a target distribution of hashed word runs.

Features of a text are its runs of 1 to ``runs`` consecutive words; a
feature's bucket is its UTF-8 bytes' crc32 modulo ``buckets``. A bucket's
gain is the logarithm of its smoothed share in the target texts over its
share in the documents, a document's weight the mean gain of its features.
Weight plus Gumbel noise from the id gives a score, and taking the highest
scores draws documents without replacement in proportion to exp(weight).

CRCs. Distinct features of a block of texts are grouped by their number of
bytes, each group is a two-dimensional uint8 array, and the CRCs of all its
rows are updated column by column with one table look-up each; the results
are scattered back to the features' places.

Passes. One reads all documents and counts (bucket, n) a task, one all target
texts; the ``buckets`` gains, whose number is a parameter, go to every task of
the second pass over the documents, which writes one narrow row a document.
The draw works on those rows: scores are whole numbers within about 100,000
of zero (a gain is a logarithm of counts, times 1000), so a histogram of them
is small whatever the input; its running sums give the lowest score drawn and
the rank at which each score begins, and only documents of one score are
ordered among themselves.

Defined results: a null or empty text has no features and weight 0; a null id
has the noise of an empty id and comes after all ids in ties; rows with equal
ids have equal noise and are ranked one by one; an empty table gives an empty
result, empty target texts give all features the same gain or less; extra
columns are ignored, whatever their names. Long texts are worked on in pieces
that overlap by the words a run can span.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import staged, table
from loanlens.llm.registry import register
from loanlens.llm.rolling import columns, text_bytes

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text whose features are held at once.
PIECE = 1 << 20

#: 0-9, a-z and all bytes from 0x80 stay, A-Z become a-z, others separate words.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))


def _crc_table() -> np.ndarray:
    """CRC of every byte for the reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), np.uint32(0xEDB88320) ^ c >> np.uint32(1), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


def crc32s(features: list[bytes]) -> np.ndarray:
    """crc32 of every feature, by one matrix of bytes for each length."""
    out = np.zeros(len(features), np.uint32)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    flat = np.frombuffer(b"".join([features[i] for i in order.tolist()]), np.uint8)
    sizes = sizes[order]
    edges = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1))
    at = 0
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        width = int(sizes[lo])
        matrix = flat[at:at + width * (hi - lo)].reshape(hi - lo, width)
        at += matrix.size
        crc = np.full(hi - lo, 0xFFFFFFFF, np.uint32)
        for column in matrix.T:
            crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
        out[order[lo:hi]] = ~crc
    return out


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece, cut between words."""
    lo = 0
    while lo < len(raw):
        hi = lo + PIECE
        while hi < len(raw) and _FOLD[raw[hi]] != 0x20:
            hi += 1
        yield raw[lo:hi].translate(_FOLD).split()
        lo = hi


def features(raw: bytes, runs: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, runs of 1 to ``runs`` words, repeats included) of a text, piece by piece."""
    before: list[bytes] = []
    for words in _pieces(raw):
        out = list(words)
        joined = before + words
        for n in range(2, runs + 1):
            first = max(0, len(before) - n + 1)
            out += [b" ".join(joined[i:i + n]) for i in range(first, len(joined) - n + 1)]
        before = joined[len(joined) - runs + 1:] if runs > 1 else []
        yield len(words), out


def _count_rows(runs: int, buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        seen: Counter = Counter()

        def add():
            np.add.at(total, crc32s(list(seen)) % buckets, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()
        for b in batches:
            for (text,) in columns(b, "text"):
                for _, part in features(text_bytes(text), runs):
                    seen.update(part)
                    if len(seen) > PIECE // 8:
                        add()
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])
    return rows


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all texts; one row a used bucket."""
    part = texts.select("text").mapInArrow(_count_rows(runs, buckets), "bucket long, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Whole-number gain of every bucket from two (bucket, n) tables of at most ``buckets`` rows."""
    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in df.collect():  # at most ``buckets`` rows, a parameter
            out[r["bucket"]] = r["n"]
        return out
    s, t = counts(source), counts(target)
    s_all, t_all = float(s.sum() + buckets), float(t.sum() + buckets)
    share = [(float(b + 1) * s_all) / (float(a + 1) * t_all) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in share], np.int64)


def _weight_rows(gain: np.ndarray, runs: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def learn(parts: list[list[bytes]]) -> None:
            distinct = set().union(*parts)
            new = distinct - known.keys()
            if len(known) + len(new) > PIECE // 8:
                known.clear()
                new = distinct
            new = list(new)
            known.update(zip(new, gain[crc32s(new) % len(gain)].tolist(), strict=True))
        for b in batches:
            ids, sums = [], []          # sums: [words, features, gains] of each row
            held: list[tuple[list, list[bytes]]] = []
            size = 0

            def flush():
                learn([part for _, part in held])
                for row, part in held:
                    row[1] += len(part)
                    row[2] += sum(map(known.__getitem__, part))
                held.clear()
            for doc, text in columns(b, "doc_id", "text"):
                ids.append(doc.as_py())
                sums.append([0, 0, 0])
                for n_words, part in features(text_bytes(text), runs):
                    sums[-1][0] += n_words
                    held.append((sums[-1], part))
                    size += len(part)
                    if size > PIECE // 8:
                        flush()
                        size = 0
            flush()
            n_words, n_features, total = (list(x) for x in zip(*sums, strict=True)) if sums else ([], [], [])
            weight = [t // n if n else 0 for t, n in zip(total, n_features, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n_words, n_features, weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return rows


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of an id, from the first 32 bits of sha256('seed:id')."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document against the target texts."""
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets), buckets)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(_weight_rows(gain, runs), "doc_id long, n_words long, n_features long, weight long"))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add ``rank`` (null where not drawn) to rows (doc_id, n_words, score, ...).

    floor(percent * N / 100) of the N rows with ``min_words`` words or more
    are drawn, highest scores first, ties by the smaller id. ``scored`` is
    read three times: pass a written table.
    """
    able = F.col("n_words") >= min_words
    hist = scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # one row a score: whole numbers in a range that the logarithm bounds
    above = Window.partitionBy().orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    hist = (hist.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
            .withColumn("wanted", F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100))
            .filter("above < wanted").select("score", "above", "wanted"))
    marked = scored.join(F.broadcast(hist), "score", "left")
    named = [F.col(c) for c in scored.columns]
    at = able & F.col("above").isNotNull()
    rest = marked.filter(~at).select(*named, F.lit(None).cast("long").alias("rank"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = marked.filter(at).withColumn("rank", F.col("above") + F.row_number().over(order))
    return ranked.select(*named, F.when(F.col("rank") <= F.col("wanted"), F.col("rank")).cast("long").alias("rank")).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, buckets: int = BUCKETS, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document."""
    scored = weights(docs, target, runs, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(staged(scored, "importance-scored"), percent, min_words)


@register("op12_importance")
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the distribution of ``benchmark``."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
