"""Encoding whole texts through their distinct chunks.

Texts are cut in places where byte-level pre-splits always cut too, so a text's ids are its chunks' ids in a row.  Equal chunks of a slice of rows are found by 128-bit hashes, new ones
are handed to an encoder, and the ids of all texts are put together by array gathers; no Python object is made for a
chunk that has been seen before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from quarry.llm.words import hash_spans, raw

#: (ids of all chunks in a row, number of ids of each) of a list of chunks.
Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: Next bytes before which a space may be cut: visible ASCII, and the leads of multi-byte characters other than those
#: that begin a Unicode space (not cutting is always right, it only makes a longer chunk).
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE1] = True
_VISIBLE[0xE4:0xF5] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[0x41:0x5B] = _ALPHA[0x61:0x7B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[0x30:0x3A] = _PUNCT[0x41:0x5B] = _PUNCT[0x61:0x7B] = False
#: Second bytes of the Latin-1 letters, whose first byte is C3 (all but the signs for times and divided by).
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Seed of the second of the two hashes.
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[begin[i] : begin[i] + size[i]]`` for every i, in a row."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begin - (ends - size), size) + np.arange(total)]


def cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, chunks of each text).

    Cuts: before a space that a visible character follows; between a Latin letter and ASCII punctuation; before a line
    feed that follows a visible character, and behind it if a visible character follows.  No match of the pattern
    reaches across any of these, and none depends on what comes after.
    """
    total = int(offsets[-1])
    body, space = buf[:total], 0x20
    letter = _ALPHA[body]
    letter[1:] |= _LATIN[body[1:]] & (body[:-1] == 0xC3)
    solid = letter | _VISIBLE[body] & (body < 0x7F)
    feed = body == 0x0A
    edge = np.zeros(total + 1, bool)
    edge[:total] = (body == space) & _VISIBLE[buf[1 : total + 1]]
    edge[1:total] |= _PUNCT[body[1:]] & letter[:-1]
    edge[1:total] |= feed[1:] & solid[:-1]
    edge[2:total] |= feed[1:-1] & solid[:-2] & _VISIBLE[body[2:]]
    ends_with_space = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    edge[ends_with_space[body[ends_with_space] == space]] = False  # nothing visible of the same text behind it
    edge[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    edge[total] = False
    starts = np.flatnonzero(edge)
    counts = np.diff(np.searchsorted(starts, offsets))
    ends = np.concatenate([starts[1:], [total]]) if len(starts) else starts
    return starts, ends, counts


class ChunkCoder:
    """Remembers up to ``cap`` chunks between slices; the least recently used half goes when it is full."""

    def __init__(self, encode: Encoder, cap: int = 500_000):
        self.encode_new, self.cap, self.clock = encode, cap, 0
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets): text i has ``ids[offsets[i] : offsets[i + 1]]``; null counts as empty."""
        buf, offsets = raw(column)
        starts, ends, counts = cut(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h = hash_spans(buf, starts, ends)
        second = hash_spans(buf, starts, ends, seed=_SECOND)
        keys, first, where = np.unique(h, return_index=True, return_inverse=True)
        checks = second[first]
        slot = self._slots(buf, keys, checks, starts[first], ends[first])
        at = slot[where]
        begin, size = self.begin[at], self.size[at]
        odd = np.flatnonzero(checks[where] != second)  # equal first hashes of different chunks
        flat = self.flat
        if len(odd):
            extra, sizes = self.encode_new([buf[a:b].tobytes().decode() for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)])
            begin[odd], size[odd] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, extra])
        ids = ragged(flat, begin, size)
        total = np.concatenate([[0], np.cumsum(size)])
        self._forget()
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]

    def _slots(self, buf: np.ndarray, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the sorted different ``keys`` among the remembered chunks, after learning the new ones."""
        self.clock += 1
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        known = (self.keys[near] == keys) & (self.checks[near] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        clash = (self.keys[near] == keys) & ~known if len(self.keys) else known
        if clash.any():  # a remembered chunk with the same first hash: forget it
            self._keep(~np.isin(self.keys, keys[clash]))
            return self._slots(buf, keys, checks, starts, ends)
        new = np.flatnonzero(~known)
        if len(new):
            blob = buf.tobytes()
            flat, size = self.encode_new([blob[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            begin = len(self.flat) + np.cumsum(size) - size
            into = np.searchsorted(self.keys, keys[new])
            self.begin, self.size = np.insert(self.begin, into, begin), np.insert(self.size, into, size)
            self.checks, self.used = np.insert(self.checks, into, checks[new]), np.insert(self.used, into, 0)
            self.keys = np.insert(self.keys, into, keys[new])
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.keys, keys)
        self.used[at] = self.clock
        return at

    def _keep(self, which: np.ndarray) -> None:
        self.flat = ragged(self.flat, self.begin[which], self.size[which])
        self.keys, self.checks, self.size, self.used = self.keys[which], self.checks[which], self.size[which], self.used[which]
        self.begin = np.cumsum(self.size) - self.size

    def _forget(self) -> None:
        if len(self.keys) > self.cap:
            self._keep(self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2])
