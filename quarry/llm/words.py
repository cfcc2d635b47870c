"""Vectorised word scanning over Arrow string columns.

A *word* is a maximal run of bytes outside ``{0x20, 0x09..0x0D}``, i.e. the
pattern ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 text (all separators are ASCII, so
working on bytes and on code points is the same thing).  Everything here is
numpy over whole batches: no per-word Python objects are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_P = np.uint64(0xD6E8FEB86659FD93)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Low ``8 * n`` bits set, for n bytes of an 8-byte load.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers (wraps silently)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64 = _STEP) -> np.ndarray:
    """64-bit hashes of ``buf[starts[i]:ends[i]]``; spans may be empty or very long.

    ``buf`` must have at least 8 spare bytes after the last span.  A span of up
    to 8 bytes is hashed injectively (for a given length).
    """
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64)
    loads = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    length = (ends - starts).astype(np.int64)
    first = mix64((loads[starts] & _KEEP[np.minimum(length, 8)]) + seed)
    longer = np.flatnonzero(length > 8)
    if len(longer):
        extra = (length[longer] - 1) // 8
        begin = np.cumsum(extra) - extra
        k = np.arange(int(extra.sum()), dtype=np.int64) - np.repeat(begin, extra) + 1
        at = np.repeat(starts[longer], extra) + 8 * k
        left = np.repeat(ends[longer], extra) - at
        part = mix64((loads[at] & _KEEP[np.minimum(left, 8)]) + seed) * powers(_CHUNK_P, int(k.max()) + 1)[k]
        first[longer] += np.add.reduceat(part, begin)
    return mix64(first ^ (length.astype(np.uint64) * seed))


@dataclass
class Words:
    """The words of the texts of one slice of rows."""

    buf: np.ndarray  # bytes of all texts, padded
    offsets: np.ndarray  # text i is buf[offsets[i]:offsets[i+1]]
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word, and the total

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return hash_spans(_LOWER[self.buf] if lower else self.buf, self.starts, self.ends)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes padded by 16, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(16, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.zeros(hi - lo + 16, np.uint8)
    if hi > lo:
        buf[: hi - lo] = np.frombuffer(data, dtype=np.uint8)[lo:hi]
    return buf, offsets - lo


def scan(column: pa.Array | pa.ChunkedArray) -> Words:
    return scan_bytes(*raw(column))


def scan_bytes(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of texts given as `raw` gives them."""
    total = int(offsets[-1])
    solid = ~_SPACE[buf[:total]]
    edge = np.zeros(total + 1, dtype=bool)
    edge[offsets] = True
    before = edge[:total].copy()
    before[1:] |= ~solid[:-1]
    after = edge[1 : total + 1].copy()
    after[:-1] |= ~solid[1:]
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(buf, offsets, starts, ends, np.diff(first), first)


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set bytes of ``mask`` in each text."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sequence_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive entries of ``h`` (length n-width+1), by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0xA0761D6478BD642F)
    out: np.ndarray | None = None
    done, block, size, factor = 0, h * _M2 + _STEP, 1, base
    while True:
        if width & size:
            piece = block[done : done + n]
            out = piece.copy() if out is None else out * factor + piece
            done += size
        if done == width:
            return mix64(out ^ np.uint64(width))
        block = block[:-size] * factor + block[size:]
        size, factor = size * 2, np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)


def windows(words: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, first word's position in the text) of each window of ``width`` words inside one text."""
    count = np.maximum(words.counts - width + 1, 0)
    begin = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(count)), count)
    pos = np.arange(int(count.sum())) - np.repeat(begin, count)
    rolled = sequence_hashes(h, width)
    return (rolled[words.first[:-1][doc] + pos] if len(doc) else np.zeros(0, np.uint64)), doc, pos


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices whose texts hold about ``limit`` bytes (one longer text alone makes a slice)."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = _lengths(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def _lengths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, np.concatenate([[0], np.cumsum(size)])
