"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Pieces (matches of the pre-split pattern) that are no tokens themselves are encoded together: pieces of similar
length share a matrix of token ids, padded on the right.  In every round each row merges its leftmost pair of minimum
rank; pair ranks come from an open-addressing hash table probed for whole arrays, and rows without a mergeable
pair leave the matrix (compaction).  The result of a piece is what one-at-a-time merging gives.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.chunks import ChunkCoder, ragged
from quarry.llm.common import prepare
from quarry.llm.words import slices

NO_RANK = np.int64(1 << 40)
#: Pieces over this many bytes are merged with a heap, as a matrix row would need one round for each merge.
LONG_PIECE = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Open-addressing hash table (left id, right id) -> merged id, with vectorised linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NO_RANK, np.int64)
        self.mask = np.int64(size - 1)
        todo, value = np.array(keys, np.int64), np.array(values, np.int64)
        slot = self._slot(todo)
        while len(todo):  # each round the first claimant of every free slot gets it
            free = self.keys[slot] == -1
            at, who = np.unique(slot[free], return_index=True)
            who = np.flatnonzero(free)[who]
            self.keys[at], self.values[at] = todo[who], value[who]
            left = self.keys[slot] != todo
            todo, value, slot = todo[left], value[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `NO_RANK` where it does not merge or either id is padding (negative)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(key.shape, NO_RANK, np.int64)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        key = key.ravel()[live]
        slot = self._slot(key)
        flat = out.ravel()
        while len(live):
            found = self.keys[slot]
            hit = found == key
            flat[live[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            live, key, slot = live[go], key[go], (slot[go] + 1) & self.mask
        return flat.reshape(out.shape)


class Bpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank = ranks
        self.find = regex.compile(pattern).findall
        self.table = PairTable(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.bytes = np.frombuffer(b"".join(ranks), np.uint8)
        size = np.array([len(t) for t in ranks], np.int64)
        self.byte_at, self.byte_n = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, np.int64)
        at = np.array(list(ranks.values()))
        self.byte_at[at], self.byte_n[at] = np.cumsum(size) - size, size
        self.coder = ChunkCoder(self.encode_chunks)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each)."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which pieces, their ids, numbers of ids
        whole, buckets = [], {}
        for i, piece in enumerate(pieces):
            if piece in self.rank:
                whole.append(i)
            elif len(piece) > LONG_PIECE:
                ids = np.array(self._merge_long(piece), np.uint32)
                parts.append((np.array([i]), ids, np.array([len(ids)])))
            elif piece:
                n = len(piece)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        if whole:
            parts.append((np.array(whole), np.array([self.rank[pieces[i]] for i in whole], np.uint32), np.ones(len(whole), np.int64)))
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)  # bounds a matrix to about a million cells
            for at in range(0, len(members), step):
                part = np.array(members[at : at + step])
                parts += [(part[rows], ids, sizes) for rows, ids, sizes in self._merge_matrix([pieces[i] for i in part.tolist()], width)]
        size, begin, base = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), 0
        for which, ids, sizes in parts:
            size[which], begin[which] = sizes, base + np.cumsum(sizes) - sizes
            base += len(ids)
        flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint32)
        return ragged(flat, begin, size), size

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their ids in a row, numbers of ids) of the rows that became ready together."""
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte[raw], -1)
        rank = self.table.ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        done = []

        def leave(which: np.ndarray) -> None:
            ready = ids[which]
            real = ready >= 0
            done.append((rows[which], ready[real].astype(np.uint32), real.sum(axis=1)))

        while len(rows):
            if ids.shape[1] < 2:
                leave(np.arange(len(rows)))
                break
            at = rank.argmin(axis=1)  # the leftmost of the smallest
            every = np.arange(len(rows))
            best = rank[every, at]
            stuck = best == NO_RANK
            if stuck.any():  # compaction
                leave(np.flatnonzero(stuck))
                rows, ids, rank, at, best = rows[~stuck], ids[~stuck], rank[~stuck], at[~stuck], best[~stuck]
                if not len(rows):
                    break
                every = np.arange(len(rows))
            n = ids.shape[1]
            ids[every, at] = best
            ids = np.take_along_axis(ids, np.arange(n - 1) + (np.arange(n - 1) > at[:, None]), axis=1)
            if n == 2:
                rank = np.zeros((len(rows), 0), np.int64)
                continue
            rank = np.take_along_axis(rank, np.arange(n - 2) + (np.arange(n - 2) >= at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.table.ranks(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < n - 2)
            rank[right, at[right]] = self.table.ranks(ids[right, at[right]], ids[right, at[right] + 1])
        return done

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges in the same order for one very long piece, in O(n log n)."""
        token: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        before, after = list(range(-1, len(piece) - 1)), [*range(1, len(piece)), -1]
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                both = token[i] + token[after[i]]
                if (rank := self.rank.get(both)) is not None:
                    heapq.heappush(heap, (rank, i, both))

        for i in range(len(piece)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if token[i] is None or after[i] < 0 or token[i] + token[after[i]] != both:
                continue  # one of its halves has been merged meanwhile
            gone = after[i]
            token[i], token[gone], after[i] = both, None, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.rank[t] for t in token if t is not None]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each chunk); all the chunks' different pieces share the matrices."""
        split = [self.find(c) for c in chunks]
        number: dict[str, int] = {}
        order = np.array([number.setdefault(p, len(number)) for s in split for p in s], np.int64)
        flat, size = self.encode_pieces([p.encode() for p in number])
        begin = np.cumsum(size) - size
        pieces = np.array([len(s) for s in split], np.int64)
        total = np.concatenate([[0], np.cumsum(size[order])])
        to = np.cumsum(pieces)
        return ragged(flat, begin[order], size[order]), total[to] - total[to - pieces]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; each different chunk is encoded once."""
        ids, offsets = self.coder.encode(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.bytes, self.byte_at[ids], self.byte_n[ids]).tobytes()


_LOADED: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    """The encoder, built once in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(load_ranks(path), pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``docs`` without the text, plus n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    ids are what merging by the ranks in ``path`` gives on every match of ``pattern``, without special tokens;
    decoded_sha256 is of the bytes the ids decode to, which are the text's own.  Null counts as the empty text (no
    ids, digests of no bytes).  A map without a shuffle: repeated rows give repeated results, ties cannot arise,
    an empty table gives an empty table, whole texts of any length are encoded.  Extra columns pass through;
    those called like an output are replaced.
    """
    prepare(docs.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    others = [c for c in docs.columns if c != text_col and c not in made]
    schema = docs.select(*others).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch, batch.schema.names[-1], 4 << 20):
                ids, offsets = bpe.coder.encode(part.column(part.num_columns - 1))
                spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                plain = memoryview(bpe.decode(ids))
                at = np.concatenate([[0], np.cumsum(bpe.byte_n[ids])])[offsets].tolist()
                raw = memoryview(ids.astype("<u4").tobytes())
                columns = [*(part.column(i) for i in range(part.num_columns - 1))]
                columns.append(pa.array(np.diff(offsets), pa.int64()))
                columns.append(pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()))
                columns.append(pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()))
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*others, F.col(text_col)).mapInArrow(run, schema)


def op4_byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encode_decode(docs.select("doc_id", "text"), path, pattern)
