"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick ``1`` positions out of a window of words; words at ``0``
positions may differ. The seeds of every benchmark item are hashed, training
documents are hashed the same way, and equal seeds are hits. A hit fixes an
alignment of item and document, whose words are compared. It is verified if
any stretch of it has at least ``MIN_MATCH`` equal words (for items of under
15 words, ``MIN_SHARE`` of the item's words) and at least ``MIN_SHARE`` of
its words equal; of such stretches the one with the most equal words is
given. Every such stretch leaves a seed of ``MASKS`` (items of under 15
words: of ``SHORT_MASKS``) untouched, wherever its substitutions are
(tested), so the look-up loses none.

The benchmark side is read in blocks of at most ``BLOCK_SEEDS`` seeds, so
what is broadcast with a pass over the documents is bounded whatever the
benchmark's size; there is one pass a block. Documents are not shuffled, so
no passage, however common, meets in one task.

Words are runs of letters and digits of the lower-cased text (every other
ASCII character separates); in scripts written without spaces each character
is a word. Every further copy of an item that does not overlap a better one
is a span of its own. Defined results: null or empty texts and items
match nothing; items of fewer than ``MIN_ITEM`` words are everyday phrases
inside a text, so they match only where they are a whole line of it; repeated
documents each get their rows; ties go to the earliest stretch; very long
texts are looked up whole; an empty table on either side gives no rows. Item
ids are integers. Other columns are kept by :func:`remove_leaks` and ignored
by :func:`find_leaks`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm.common import table
from loanlens.llm.registry import register

#: Fixed seed masks of 6 words: to spoil every seed of n >= 13 words takes more than n / 5 substitutions.
MASKS = ["1111011", "100111011", "11010110001", "11001000111"]
#: For items too short for ``MASKS``: 4 words, enough for one change in 5 to 9 words and two in 10 to 14.
SHORT_MASKS = ["1111", "10111", "11011", "11101"]
MIN_ITEM = 5
MIN_MATCH = 12
MIN_SHARE = 0.8
BLOCK_SEEDS = 1_000_000

_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han; their punctuation separates.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                       "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_STOPS = re.compile("[\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff61-\uff65]")
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)
_FILTER_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if not low.isascii() and _UNSPACED.search(low):
        low = _UNSPACED.sub(r" \g<0> ", _STOPS.sub(" ", low))
    return low.encode("utf-8", "replace").translate(_WORDS).split()


def line_bounds(text: str) -> set[tuple[int, int]]:
    """(first word, word after the last) of every line with words."""
    at = np.cumsum([0, *(len(words_of(line)) for line in text.split("\n"))]).tolist()
    return {(a, b) for a, b in zip(at, at[1:]) if a < b}


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words."""
    import xxhash
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def seeds(tok: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window of ``tok`` under ``mask``."""
    m = len(tok) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(m, len(mask), np.uint64)
    mixed = tok ^ tok >> np.uint64(29)
    for k, bit in enumerate(mask):
        if bit == "1":
            key += mixed[k:k + m] * _ODD[k]
    return (key ^ key >> np.uint64(32)) * _ODD[1]


def need_of(n: int) -> int:
    """Equal words asked of an item of ``n`` words."""
    return min(MIN_MATCH, math.ceil(Fraction(MIN_SHARE).limit_denominator(1000) * n))


def masks_for(n: int, masks=MASKS) -> list[str]:
    """The masks of an item of ``n`` words; all its words below ``MIN_ITEM``."""
    if n * MIN_SHARE >= MIN_MATCH:
        return masks
    return SHORT_MASKS if n >= MIN_ITEM else ["1" * n] if n else []


class Block:
    """Seeds of some benchmark items, ready for look-up."""

    def __init__(self, items: list[tuple[int, str]], masks=MASKS):
        self.ids = [i for i, _ in items]
        self.tokens = [tokens(t) for _, t in items]
        by_mask: dict[str, list] = {}
        for k, tok in enumerate(self.tokens):
            for mask in masks_for(len(tok), masks):
                key = seeds(tok, mask)
                by_mask.setdefault(mask, []).append((key, np.full(len(key), k), np.arange(len(key))))
        self.tables = {}
        for mask, parts in by_mask.items():
            key, item, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[key >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables[mask] = (key[order], item[order].astype(np.int32), pos[order].astype(np.int32), np.packbits(seen))

    def hits(self, tok: np.ndarray) -> np.ndarray:
        """Distinct (item, document position of the item's start) of all seed hits."""
        out = []
        for mask, (key, item, pos, packed) in self.tables.items():
            s = seeds(tok, mask)
            top = (s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
            at = np.flatnonzero(packed[top >> 3] >> (7 - (top & 7)).astype(np.uint8) & 1)
            if not len(at):
                continue
            lo, hi = np.searchsorted(key, s[at], "left"), np.searchsorted(key, s[at], "right")
            n = hi - lo
            if not n.any():
                continue
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out.append(np.stack([item[where].astype(np.int64), np.repeat(at, n) - pos[where]], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, equal words, words of the stretch, first word in the document) of every span.

        Spans of one item do not overlap; where they would, the one with more equal words stays.
        """
        tok = tokens(text)
        found: dict[int, set[tuple[int, int, int]]] = {}
        lines = None
        for k, start in self.hits(tok):
            item = self.tokens[k]
            lo, hi = max(0, start), min(len(tok), start + len(item))
            same = tok[lo:hi] == item[lo - start:hi - start]
            need = need_of(len(item))
            if np.count_nonzero(same) < need:
                continue
            if len(item) < MIN_ITEM:
                lines = line_bounds(text) if lines is None else lines
                if (lo, hi) not in lines:
                    continue
            matched, first, length = best_stretch(same)
            if matched >= need:
                found.setdefault(int(k), set()).add((matched, length, int(lo + first)))
        return [(self.ids[k], *span) for k in sorted(found) for span in apart(found[k])]


def apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (equal words, length, start) those that overlap no better one, by start; ties go to the earlier."""
    kept: list[tuple[int, int, int]] = []      # (start, end, equal words)
    for matched, length, start in sorted(spans, key=lambda s: (-s[0], s[2])):
        at = bisect_left(kept, (start, 0, 0))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or start + length <= kept[at][0]):
            kept.insert(at, (start, start + length, matched))
    return [(matched, end - start, start) for start, end, matched in kept]


def best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(equal words, start, length) of the stretch with the most equal words among all with a share of ``MIN_SHARE``.

    Of ties the shortest, then the earliest; it begins and ends with an equal word.
    """
    share = Fraction(MIN_SHARE).limit_denominator(1000)
    p, q = share.numerator, share.denominator
    count = np.concatenate([[0], np.cumsum(same)])
    # a stretch i:j has the share if over[i] <= over[j]; the earliest such i of each j has the most equal words
    over = q * count - p * np.arange(len(count))
    begin = np.searchsorted(-np.minimum.accumulate(over), -over, "left")
    matched = count - count[begin]
    most = int(matched.max())
    if not most:
        return 0, 0, 0
    at = np.flatnonzero(same)
    first = at[count[begin[matched == most]]]
    last = at[count[begin[matched == most]] + most - 1]
    k = int(np.argmin(last - first))
    return most, int(first[k]), int(last[k] - first[k]) + 1


def blocks(benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> Iterator[Block]:
    """The benchmark (item_id, text) in blocks of about ``block_seeds`` seeds, one at a time on the driver."""
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has two bytes at least (its separator or a character of several), and a seed for each mask
    n = max(1, -(-total * max(len(MASKS), len(SHORT_MASKS)) // (2 * block_seeds)))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield Block(rows)


def overlap_udf(block: Block):
    @F.pandas_udf("array<struct<item_id:long,matched:int,length:int,start:int>>")
    def overlaps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "matched", "length", "start"), x, strict=True)) for x in block.overlaps(t)]
                             for t in texts])
    return overlaps


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, item_id, matched, length, start): the verified overlaps of every document."""
    out = None
    for block in blocks(benchmark, block_seeds):
        found = docs.select("doc_id", F.explode(overlap_udf(block)("text")).alias("x")).select("doc_id", "x.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.filter(F.lit(False)).selectExpr("doc_id", "0L AS item_id", "0 AS matched", "0 AS length", "0 AS start")
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """``docs`` without the documents that hold a verified overlap."""
    for block in blocks(benchmark, block_seeds):
        docs = docs.filter(F.size(overlap_udf(block)("text")) == 0)
    return docs


@register("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark overlaps of all documents, one row for each span."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
