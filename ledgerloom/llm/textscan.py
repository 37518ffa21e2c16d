"""Vectorised word scanning over Arrow text columns.

A batch of texts is one UTF-8 buffer with offsets. Words are found with a byte table, and each
gets a 64-bit hash by a polynomial over its bytes (prefix sums modulo 2**64, so that the cost per
byte is a few machine operations). Word classes used here treat every byte above 0x7F as a word
byte or decide by ASCII bytes alone, so working on bytes equals working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text whose hashes are worked out at once; bounds the working memory.
PIECE = 1 << 20

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15 | 1)
_RINV = _U(pow(int(_R), -1, 1 << 64))
_Q = _U(0xD6E8FEB86659FD93)
_LUT64 = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        size = max(n, PIECE + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 4 * PIECE:  # a giant word's table is not kept
            _POW[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


SPACED = word_table(SPACE_BYTES)
ALNUM = word_table(bytes(b for b in range(0x80) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: Bytes of text that are scanned at once; a longer text is scanned by itself.
SLICE = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches' rows again, in batches of about SLICE bytes of text, so that working memory is bounded."""
    for batch in batches:
        if batch.num_rows < 2 or batch.nbytes <= SLICE:
            yield batch
            continue
        ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a batch: byte spans, and for each text the range of its words."""

    data: np.ndarray  # the batch's bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # texts + 1 entries; text i has words first[i] .. first[i + 1] - 1

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            lo = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, lo + PIECE, "right")))
            hi = int(self.end[j - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_LUT64[self.data[lo:hi]] * _powers(_R, hi - lo), out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * _powers(_RINV, hi - lo)[s] + (e - s).astype(np.uint64) * _Q
            i = j
        return mix(out)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def scan(column: pa.Array, table: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Find the words of every text of the column."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    inside = table[data]
    n = len(inside)
    edges = offsets[offsets < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words (over the flat batch; texts' ends are not looked at)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _Q + h[j : j + n]
    return mix(out)


def inside_texts(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For window starts 0 .. n - 1: does the window of k words end within its text?"""
    ok = np.zeros(n, bool)
    length = np.diff(first)
    has = length >= k
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, first[:-1][has], 1)
    np.add.at(delta, first[1:][has] - k + 1, -1)
    ok[:] = np.cumsum(delta[:n]) > 0
    return ok


def whole(h: np.ndarray) -> np.uint64:
    """Hash of one whole word sequence, its length included."""
    q = _powers(_Q, len(h))
    return mix(np.sum(h * q, dtype=np.uint64, keepdims=True) + np.full(1, len(h), np.uint64) * _R)[0]


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: item i holds the next counts[i] values of flat."""
    width = flat.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * width, out=offsets[1:])
    flat = np.ascontiguousarray(flat)
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(
            pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)]
        )
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
