"""Polynomial hashes of runs of bytes or words, for whole arrays at a time.

A run's hash is the sum of its values times rising powers of an odd number,
modulo 2^64, taken from prefix sums, so a run of any length costs one
subtraction. Values are random 64-bit numbers (bytes) or mixed hashes (words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
#: Space and U+0009-U+000D, the bytes between words (as ``bytes.split`` has them).
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class Runs:
    """Hashes of runs [lo, hi) of an array of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up = np.full(n, np.uint64(_BASE))
        down = np.full(n + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[:1] = down[:1] = 1
        self._down = np.cumprod(down)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(values * np.cumprod(up), out=self._sum[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self._sum[hi] - self._sum[lo]) * self._down[lo])


def _piece_words(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    gap = _GAP[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    return Runs(_BYTE[b])(edge[::2], edge[1::2])


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash a word of a text, in order; worked on in pieces cut between words."""
    out, lo = [], 0
    while lo < len(raw):
        hi = lo + PIECE
        while hi < len(raw) and not _GAP[raw[hi]]:
            hi += 1
        out.append(_piece_words(raw[lo:hi]))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_bytes(value: pa.Scalar) -> bytes:
    """UTF-8 bytes of a text cell (null: none)."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(batch.schema.get_field_index(n)) for n in names], strict=True)
