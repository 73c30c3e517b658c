"""Exact repeats of ``length`` bytes by enhanced suffix arrays over a partitioned corpus.

A document's bytes that are covered by a ``length``-byte string which also
starts in a document with a smaller id are removed.

Partitioning. Every window of ``length`` bytes has an anchor: the leftmost
of its ``GRAM``-byte grams with the smallest hash. It depends on the window's
bytes alone, so equal windows have equal anchors, and suffixes that share
``length`` bytes share an anchor gram. A run of windows with one anchor is a
phrase (``length`` to ``2 length - GRAM`` bytes). The corpus is shuffled once
as (anchor, phrase hash, document, position); phrases whose anchor stays in
one document go at once, and a phrase that a smaller document holds whole is
marked whole. What is left is the first document of each phrase whose anchor
also has other phrases: their windows can still repeat in part.

Enhanced suffix array. The texts of these phrases are shuffled by anchor, and
each anchor's suffixes are sorted, neighbours' common prefixes computed and
the common-prefix intervals found by a stack scan. An interval of ``length``
or more whose suffixes are preceded by different bytes (or begin a phrase) is
a maximal repeat; it is output as a group with all its occurrences, and the
occurrences behind its smallest document are marked.

Matches use 64-bit hashes of anchor and phrase together (128 bits), the
suffix array uses the bytes themselves. Common passages: a task compares its
own documents before the shuffle and sends on one row a phrase, so the
inside of a passage arrives once a task. The anchors at a passage's two ends
make another phrase in nearly every document; their rows (40 bytes) still go
to the anchor's task, where they are sorted with spill and streamed. Only
first documents of distinct phrases meet in memory, in groups of at most
``GROUP`` phrases; beyond, the anchor's windows are grouped by a partial
aggregation instead.

Defined results: a null or empty text has no bytes; rows with a null id stay
whole and are nobody's smaller document; equal ids are one document to each
other (nothing is removed between them); texts shorter than ``length`` stay
whole; an empty table gives an empty result; extra columns are ignored. Long
texts are worked on in pieces that overlap by ``length`` - 1 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import release, staged, table
from loanlens.llm.registry import register

LENGTH = 50
GRAM = 20
PIECE = 1 << 20
GROUP = 20_000
# a position packs: row | first byte of the phrase | two flags | windows of the phrase
_N_BITS = 6
_MORE = 1 << 6       # the phrase occurs again in its document
_SURE = 1 << 7       # a smaller document read by the same task holds the phrase
_LO = 8
_ROW = _LO + 31

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0][0]) < n:
        up, down = np.full(n, _BASE), np.full(n, _UNBASE)
        up[0] = down[0] = 1
        _POWERS[0] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[0][0][:n], _POWERS[0][1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hash of the ``gram`` bytes at every position, from hashes of 1, 2, 4, ... bytes."""
    power = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
    h, step, out, done = _BYTE[b], 1, None, 0
    while True:
        if gram & step:
            out = h if out is None else out[:len(h) - done] * power(step) + h[done:]
            done += step
        if 2 * step > gram:
            return _mix(out)
        h = h[:-step] * power(step) + h[step:]
        step *= 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (width - step)], x[width - step:]) if width > step else x


def phrases(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text index, first byte, windows, anchor hash, phrase hash) of the phrases of short ``texts``."""
    joined = b"".join(texts)
    none = np.zeros(0, np.int64)
    if len(joined) < length:
        return none, none, none, none, none
    b = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    g = _gram_hashes(b, gram)
    low = np.uint64((1 << 24) - 1)
    key = g & ~low | np.arange(len(g), dtype=np.uint64)
    anchor = (_sliding_min(key, length - gram + 1) & low).astype(np.int64)
    at = np.arange(len(anchor))
    owner = np.repeat(np.arange(len(texts)), ends - starts)[:len(anchor)]
    inside = at + length <= ends[owner]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])])
    n = np.diff(np.append(first, len(anchor)))
    first, n = first[inside[first]], n[inside[first]]
    up, down = _powers(len(b))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up, dtype=np.uint64)])
    ph = _mix((run[first + n + length - 1] - run[first]) * down[first])
    return owner[first], first - starts[owner[first]], n, g[anchor[first]].view(np.int64), ph.view(np.int64)


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of pieces whose windows make up the windows of ``text``."""
    for lo in range(0, max(1, len(text) - length + 1), PIECE):
        yield lo, text[lo:lo + PIECE + length - 1]


def _phrase_rows(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf: list[tuple[int, int, int, bytes]] = []
        held = 0

        def flush():
            doc, row, off, texts = zip(*buf, strict=True)
            owner, first, n, ah, ph = phrases(list(texts), length, gram)
            lo = first + np.array(off, np.int64)[owner]
            doc, row = np.array(doc, np.int64)[owner], np.array(row, np.int64)[owner]
            order = np.lexsort((lo, row, doc, ph, ah))
            doc, row, lo, n, ah, ph = (x[order] for x in (doc, row, lo, n, ah, ph))
            new = np.r_[True, (ah[1:] != ah[:-1]) | (ph[1:] != ph[:-1])] if len(ah) else np.zeros(0, bool)
            own = new | np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])] if len(ah) else new
            at = np.flatnonzero(own)        # one row for each phrase and document
            more = np.diff(np.append(at, len(own))) > 1
            least = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            sure = doc[at] > doc[least[at]]
            pos = row[at] << _ROW | lo[at] << _LO | np.where(sure, _SURE, 0) | np.where(more, _MORE, 0) | n[at]
            # sure rows need no comparison: they are spread over the tasks
            key = np.where(sure, _mix((doc[at] ^ pos << 20).view(np.uint64)).view(np.int64), ah[at])
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ph[at]), pa.array(doc[at]), pa.array(pos)],
                                              names=["ah", "ph", "doc", "pos"])
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc", "row", "text")]
            for doc, row, text in zip(*cols, strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for off, piece in _pieces(raw, length):
                    if len(piece) >= length:
                        buf.append((doc.as_py(), row.as_py(), off, piece))
                        held += len(piece)
                    if held >= PIECE:
                        yield flush()
                        buf, held = [], 0
        if buf:
            yield flush()
    return rows


# ---- enhanced suffix array -------------------------------------------------------

class Suffixes:
    """Suffixes that start at the first ``windows[i]`` bytes of each text, as big-endian 8-byte words."""

    def __init__(self, texts: list[bytes], group: np.ndarray, windows: np.ndarray, length: int):
        longest = max(map(len, texts))
        self.n_words = -(-longest // 8)
        width = longest + 8 * self.n_words      # zeros behind every text, so words need no mask
        flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8)
        wide = np.zeros(len(flat), np.uint64)
        for i in range(8):
            wide[:len(flat) - i] |= flat[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
        self.flat, self.wide, self.length = flat, wide, length
        self.text = np.repeat(np.arange(len(texts)), windows)
        self.offset = np.arange(len(self.text)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = self.text * width + self.offset
        self.left = np.array([len(t) for t in texts])[self.text] - self.offset
        self.group = group[self.text]

    def keep(self, which: np.ndarray) -> None:
        for name in ("text", "offset", "at", "left", "group"):
            setattr(self, name, getattr(self, name)[which])

    def word(self, k: int) -> np.ndarray:
        return self.wide[self.at + 8 * k]

    def drop_single(self) -> None:
        """Leave out suffixes whose first ``length`` bytes no other suffix of the group can share."""
        key = self.group.astype(np.uint64)
        for k in range(self.length // 8):
            key = (key ^ self.word(k)) * _BASE
            key ^= key >> np.uint64(31)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        self.keep(twice)

    def sort(self) -> np.ndarray:
        """Put the suffixes in order of (group, bytes); lcp[k] = common prefix with suffix k - 1, 0 across groups."""
        words = [self.word(k) for k in range(self.n_words)]
        order = np.lexsort((self.left, *words[::-1], self.group))
        self.keep(order)
        lcp = np.zeros(len(order), np.int64)
        equal = self.group[1:] == self.group[:-1]
        for w in words:
            x = w[order[1:]] ^ w[order[:-1]]
            lead = np.select([x == 0] + [x < np.uint64(1 << 8 * i) for i in range(1, 8)], [8] + [8 - i for i in range(1, 8)], 0)
            lcp[1:] += np.where(equal, lead, 0)
            equal &= lead == 8
        lcp[1:] = np.minimum(lcp[1:], np.minimum(self.left[1:], self.left[:-1]))
        return lcp

    def before(self) -> np.ndarray:
        """Byte in front of every suffix, -1 where it begins its text."""
        return np.where(self.offset > 0, self.flat[self.at - 1].astype(np.int64), -1)


def maximal_repeats(texts: list[bytes], group: np.ndarray, windows: np.ndarray, length: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(repeat length, occurrences (text, offset)) of the maximal repeats of ``length`` bytes or more.

    Common-prefix intervals come from one stack scan of the suffix array.
    An interval is maximal to the right by construction, and to the left if
    its suffixes follow different bytes, or one of them begins its text.
    """
    s = Suffixes(texts, group, windows, length)
    s.drop_single()
    if not len(s.text):
        return
    lcp = s.sort()
    # runs of suffixes that share ``length`` bytes; an interval never leaves its run
    breaks = np.flatnonzero(lcp < length)
    ends = np.append(breaks[1:], len(lcp))
    long = ends - breaks > 1
    text, offset, before, lcp = s.text.tolist(), s.offset.tolist(), s.before().tolist(), lcp.tolist()
    for lo, hi in zip(breaks[long].tolist(), ends[long].tolist(), strict=True):
        stack: list[tuple[int, int]] = []
        for k in range(lo + 1, hi + 1):
            value = lcp[k] if k < hi else 0
            left = k - 1
            while stack and stack[-1][0] > value:
                depth, left = stack.pop()
                ways = set(before[left:k])
                if len(ways) > 1 or -1 in ways:
                    yield depth, list(zip(text[left:k], offset[left:k], strict=True))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))


def _mark_group(length: int):
    """Rows (ah, doc, pos, text) sorted by ah -> (doc, pos, mask): windows that start in a smaller document."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def solve(rows):
            texts = [r[3] for r in rows]
            docs = [r[1] for r in rows]
            group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)[1]
            windows = np.array([r[2] & (1 << _N_BITS) - 1 for r in rows])
            masks = [0] * len(rows)
            for depth, found in maximal_repeats(texts, group, windows, length):
                first = min(docs[t] for t, _ in found)
                for t, o in found:
                    if docs[t] > first:
                        masks[t] |= ((1 << depth - length + 1) - 1) << o
            at = [i for i, m in enumerate(masks) if m]
            return pa.RecordBatch.from_arrays(
                [pa.array([docs[i] for i in at], pa.int64()), pa.array([rows[i][2] for i in at], pa.int64()),
                 pa.array([masks[i] & (1 << int(windows[i])) - 1 for i in at], pa.int64())], names=["doc", "pos", "mask"])
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("ah", "doc", "pos")]
            text = b.column(b.schema.get_field_index("text"))
            for i, (ah, doc, pos) in enumerate(zip(*[c.to_pylist() for c in cols], strict=True)):
                if size >= 20_000 and ah != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append((ah, doc, pos, text[i].as_buffer().to_pybytes()))
                size += 1
        if held:
            yield solve(held)
    return mark


def _cut(length: int):
    """(doc, row, text, open: [(ah, pos)]) -> (ah, doc, pos, text of the phrase)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc", "row", "text", "open")]
            for doc, row, text, phrase_list in zip(*cols, strict=True):
                raw, doc, row = text.as_buffer().to_pybytes(), doc.as_py(), row.as_py()
                for x in phrase_list.as_py():
                    lo, n = x["pos"] >> _LO & (1 << _ROW - _LO) - 1, x["pos"] & (1 << _N_BITS) - 1
                    if x["pos"] >> _ROW == row:
                        for o, v in zip(out, (x["ah"], doc, x["pos"], raw[lo:lo + n + length - 1]), strict=True):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                              pa.array(out[3], pa.binary())], names=["ah", "doc", "pos", "text"])
    return cut


def _by_window(phrase_rows: DataFrame, length: int) -> DataFrame:
    """(doc, pos, mask) like :func:`_mark_group`, by one row a window, for anchors with very many phrases."""
    n = F.col("pos").bitwiseAND((1 << _N_BITS) - 1).cast("int")
    w = phrase_rows.select("doc", "pos", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    w = w.select("doc", "pos", "i", F.expr(f"substring(text, i + 1, {length})").alias("window"))
    least = w.groupBy("window").agg(F.min("doc").alias("first"))
    late = w.join(least.hint("merge"), "window").filter("first < doc")
    return late.groupBy("doc", "pos").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, row, text): row tells different texts of one id apart (0 where ids are unique)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    twice = d.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc IS NOT NULL")
    if twice.isEmpty():
        return d.withColumn("row", F.lit(0).cast("long")).select("doc", "row", "text")
    order = Window.partitionBy("doc").orderBy(F.xxhash64("text"))
    return d.withColumn("row", (F.dense_rank().over(order) - 1).cast("long")).select("doc", "row", "text")


def gram_for(length: int) -> int:
    """Bytes of an anchor for repeats of ``length`` bytes: a phrase has 31 windows at most, as its mark holds them in one long."""
    if length < 1:
        raise ValueError("length must be positive")
    return min(length, max(GRAM, length - LENGTH + GRAM))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, pos, mask) of phrases with windows that also start in a smaller document.

    ``docs`` is (doc, row, text). Bit i of mask stands for the window that
    starts at byte lo + i, where pos packs (row, lo, windows).
    """
    spark = docs.sparkSession
    rows = docs.filter("doc IS NOT NULL").mapInArrow(_phrase_rows(length, gram_for(length)), "ah long, ph long, doc long, pos long")
    rows = rows.repartition("ah")
    group = Window.partitionBy("ah")
    same = Window.partitionBy("ah", "ph")
    rows = (rows.withColumn("d0", F.min("doc").over(group)).withColumn("d1", F.max("doc").over(group))
            .withColumn("sure", F.col("pos").bitwiseAND(_SURE) != 0).filter("sure OR d0 < d1")
            .withColumn("p0", F.min("ph").over(group)).withColumn("p1", F.max("ph").over(group))
            .withColumn("first", F.min("doc").over(same)))
    whole = F.col("sure") | (F.col("first") < F.col("doc"))
    found = staged(rows.filter(whole | (F.col("p0") != F.col("p1")))
                   .select("doc", "pos", F.when(~whole, F.col("ah")).alias("ah")), "phrases")
    release(spark)
    # first documents of phrases that share their anchor with other phrases
    lists = found.filter("ah IS NOT NULL").groupBy("doc").agg(F.collect_list(F.struct("ah", "pos")).alias("open"))
    texts = docs.filter("text IS NOT NULL").join(lists, "doc").select("doc", "row", "text", "open")
    cut = texts.mapInArrow(_cut(length), "ah long, doc long, pos long, text binary")
    big = staged(found.filter("ah IS NOT NULL").groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).drop("n"),
                 "big-anchors")
    some_big = not big.isEmpty()
    small = cut.join(big, "ah", "left_anti") if some_big else cut
    part = small.repartition("ah").sortWithinPartitions("ah").mapInArrow(_mark_group(length), "doc long, pos long, mask long")
    if some_big:
        part = part.unionByName(_by_window(cut.join(big, "ah", "left_semi"), length))
    part = staged(part, "marks")
    release(spark)
    every = F.expr(f"shiftleft(1L, cast(pos & {(1 << _N_BITS) - 1} AS int)) - 1L")
    return found.filter("ah IS NULL").select("doc", "pos", every.alias("mask")).unionByName(part)


def _digest(length: int):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            marks = b.column(b.schema.get_field_index("marks"))
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc", "row", "text")]
            for i, (doc, row, text) in enumerate(zip(*cols, strict=True)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone = covered(raw, row.as_py(), marks[i], length)
                runs = np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if runs else raw
                for o, v in zip(out, (doc.as_py(), len(raw), int(np.count_nonzero(gone)), int(runs),
                                      hashlib.sha256(kept).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 4 + [pa.string()], strict=True)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return digest


def covered(raw: bytes, row: int, marks: pa.ListScalar, length: int) -> np.ndarray:
    """Whether each byte lies in a marked window of this row."""
    if not marks.is_valid:
        return np.zeros(len(raw), bool)
    pos, mask = (marks.values.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "mask"))
    own = pos >> _ROW == row
    pos, mask = pos[own], mask[own].view(np.uint64)
    lo = pos >> _LO & (1 << _ROW - _LO) - 1
    again = np.flatnonzero(pos & _MORE)
    if len(again):
        extra = [(at, mask[k]) for k in again.tolist()
                 for at in other_places(raw, int(lo[k]), int(pos[k] & (1 << _N_BITS) - 1) + length - 1)]
        lo = np.concatenate([lo, np.array([x for x, _ in extra], np.int64)])
        mask = np.concatenate([mask, np.array([m for _, m in extra], np.uint64)])
    which, bit = np.nonzero(np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    start = lo[which] + bit
    edge = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + length, minlength=len(raw) + 1)
    return np.cumsum(edge)[:-1] > 0


def other_places(raw: bytes, lo: int, size: int) -> Iterator[int]:
    """Other places of the ``size`` bytes at ``lo``."""
    part = raw[lo:lo + size]
    at = raw.find(part)
    while at >= 0:
        if at != lo:
            yield at
        at = raw.find(part, at + 1)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; ids are whole numbers."""
    d = numbered(docs)
    marks = repeats(d, length).groupBy("doc").agg(F.collect_list(F.struct("pos", "mask")).alias("marks"))
    return (d.join(marks, "doc", "left").select("doc", "row", "text", "marks")
            .mapInArrow(_digest(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


@register("op3_suffix_repeats")
def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50-byte strings of smaller documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))
