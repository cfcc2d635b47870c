"""Token ids in binary files: bit- or byte-plane shuffled blocks, each plane compressed by zstandard.

File layout (little-endian): the magic ``QBP1``; the blocks; the footer; its offset (u64); the magic again.  A block
holds a fixed number of ids (the last one may hold fewer), transposed so that the k-th byte (or bit) of
all its ids lie together; a plane of zeros takes no space.  The footer has the chunk index - offset, first id and
number of ids of every block - and the documents' ids and lengths, so any document or block can be
read alone.
"""

from __future__ import annotations

import codecs
import io
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.chunks import ChunkCoder
from quarry.llm.common import fresh_path, prepare, stage
from quarry.llm.words import slices

MAGIC = b"QBP1"
BLOCK_IDS = 1 << 16
#: Bytes of text that one shard file is made from, about.
SHARD_BYTES = 16 << 20
_ONE_PIECE = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_INDEX = np.dtype([("offset", "<u8"), ("first", "<u8"), ("count", "<u4"), ("crc", "<u4")])


def pack_block(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """One block: count, plane kind, plane sizes, compressed planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits:
        spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        planes = [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]
    else:
        planes = [np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(4)]
    press = zstandard.ZstdCompressor(level=level)
    packed = [press.compress(p) if p.count(0) < len(p) else b"" for p in planes]
    return struct.pack(f"<IB{len(packed)}I", len(ids), len(packed), *map(len, packed)) + b"".join(packed)


def unpack_block(data: bytes) -> np.ndarray:
    count, n = struct.unpack_from("<IB", data)
    sizes = struct.unpack_from(f"<{n}I", data, 5)
    at, open_ = 5 + 4 * n, zstandard.ZstdDecompressor()
    width = count if n == 4 else -(-count // 8)
    out = np.zeros((count, 32 if n == 32 else 4), np.uint8)
    for k, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(open_.decompress(data[at : at + size], max_output_size=width), np.uint8)
            out[:, k] = plane if n == 4 else np.unpackbits(plane, bitorder="little")[:count]
            at += size
    if n == 32:
        out = np.packbits(out, axis=1, bitorder="little")
    return out.reshape(count, 4).view("<u4").ravel()


class Writer:
    """Streams ids into one file; holds one block and the index only."""

    def __init__(self, sink: io.RawIOBase, bits: bool = False, block_ids: int = BLOCK_IDS):
        self.sink, self.bits, self.block_ids = sink, bits, block_ids
        self.at, self.total = len(MAGIC), 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.index: list[tuple] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        sink.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            whole = np.concatenate(self.pending)
            cut = len(whole) - len(whole) % self.block_ids
            for i in range(0, cut, self.block_ids):
                self._block(whole[i : i + self.block_ids])
            self.pending, self.held = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        data = pack_block(ids, self.bits)
        self.index.append((self.at, self.total, len(ids), zlib.crc32(data)))
        self.sink.write(data)
        self.at += len(data)
        self.total += len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        press = zstandard.ZstdCompressor(level=3)
        null = np.array([d is None for d in self.docs], np.uint8)
        parts = [np.array(self.index, _INDEX).tobytes(), np.array([d or 0 for d in self.docs], "<i8").tobytes(), np.array(self.lengths, "<i8").tobytes(), null.tobytes()]
        packed = [press.compress(p) for p in parts]
        self.sink.write(struct.pack(f"<{len(parts)}Q", *map(len, packed)) + b"".join(packed))
        self.sink.write(struct.pack("<Q", self.at) + MAGIC)


class Reader:
    """Random access by the chunk index."""

    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        tail = self._at(size - 12, 12)
        if tail[8:] != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a token file")
        (self.end,) = struct.unpack("<Q", tail[:8])
        footer = self._at(self.end, size - 12 - self.end)
        sizes, at, parts = struct.unpack_from("<4Q", footer), 32, []
        for n in sizes:
            parts.append(zstandard.ZstdDecompressor().decompressobj().decompress(footer[at : at + n]))
            at += n
        self.index = np.frombuffer(parts[0], _INDEX)
        null = np.frombuffer(parts[3], np.uint8)
        self.docs = [None if z else d for d, z in zip(np.frombuffer(parts[1], "<i8").tolist(), null.tolist(), strict=True)]
        self.lengths = np.frombuffer(parts[2], "<i8")

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, k: int) -> np.ndarray:
        offset = int(self.index["offset"][k])
        to = int(self.index["offset"][k + 1]) if k + 1 < len(self.index) else self.end
        data = self._at(offset, to - offset)
        if zlib.crc32(data) != int(self.index["crc"][k]):
            raise ValueError(f"block {k} is damaged")
        return unpack_block(data)

    def documents(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """(doc id, first id's position, its ids in pieces) in file order, one block in memory at a time."""
        at, k, block = 0, -1, np.zeros(0, np.uint32)
        base = 0
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            pieces, need, begin = [], n, at
            while need:
                if at - base >= len(block):
                    k += 1
                    block, base = self.block(k), int(self.index["first"][k])
                part = block[at - base : at - base + need]
                pieces.append(part)
                need -= len(part)
                at += len(part)
            yield doc, begin, pieces


class LibraryEncoder:
    """The tokenizers library over the different chunks of a batch; equal chunks are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = Tokenizer.from_file(path)  # as the file sets it: strings of added tokens become their ids
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.coder = ChunkCoder(self._learn)
        shown = sorted(b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = "".join(chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))  # the byte-level alphabet

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of ids of each chunk).

        Chunks of letters with at most one space in front are one piece for the pre-split, so they go straight to the
        library's model, in the alphabet of its byte-level step; all others take the whole way.
        """
        single = _ONE_PIECE.fullmatch
        merge, letters = self.tokenizer.model.tokenize, self.letters
        out: list[list[int] | None] = [[t.id for t in merge(codecs.charmap_decode(c.encode(), "strict", letters)[0])] if single(c) else None for c in chunks]
        others = [i for i, ids in enumerate(out) if ids is None]
        if others:
            for i, e in zip(others, self.tokenizer.encode_batch_fast([chunks[i] for i in others], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return np.array(list(itertools.chain.from_iterable(out)), np.uint32), np.array(list(map(len, out)), np.int64)

    def encode(self, texts: pa.Array | list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text with the end id.  Texts that hold an added token's string go whole through the library."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        holds = np.zeros(len(texts), bool)
        for content in self.added:
            holds |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if holds.any():
            special = [np.array([*self.whole.encode(x, add_special_tokens=False).ids, end_id], np.uint32) for x in texts.filter(pa.array(holds)).to_pylist()]
            plain = self.encode(texts.filter(pa.array(~holds)), end_id) if not holds.all() else []
            by_kind = {True: iter(special), False: iter(plain)}
            return [next(by_kind[h]) for h in holds.tolist()]
        ids, offsets = self.coder.encode(texts)
        n = len(offsets) - 1
        out = np.full(len(ids) + n, end_id, np.uint32)
        own = np.ones(len(out), bool)
        last = offsets[1:] + np.arange(n)
        own[last] = False
        out[own] = ids
        first = offsets[:-1] + np.arange(n)
        return [out[a : b + 1] for a, b in zip(first.tolist(), last.tolist(), strict=True)]


_ENCODERS: dict[str, LibraryEncoder] = {}


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, bits: bool = False, shards: int | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode every text and write the ids, in ascending id order, to shard files; returns the shards' manifest.

    Manifest rows: shard, path, n_docs, n_ids, n_bytes.  Null counts as the empty text (which still gets its end id);
    rows with a null id come first; rows that repeat an id are ordered by text.  An empty table writes no file.
    A shard is written under a name of the attempt and then renamed, so a lost or doubled attempt leaves no
    half file behind and every attempt writes the same bytes.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or fresh_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = LibraryEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        system, root = _place(folder)
        final, temp = f"{root}/shard-{shard:07d}.qbp", f"{root}/_attempt-{shard:07d}-{attempt}"
        writer = sink = None
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(temp)
                    writer = Writer(sink, bits)
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1), end_id), strict=True):
                    writer.add(doc, ids)
        if writer is not None:
            writer.close()
            sink.close()
            system.move(temp, final)
            n_bytes = system.get_file_info(final).size
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/shard-{shard:07d}.qbp", "n_docs": len(writer.docs), "n_ids": sum(writer.lengths), "n_bytes": n_bytes}])

    dealt = rows.repartitionByRange(shards, "doc").sortWithinPartitions("doc", "text")
    return stage(dealt.mapInArrow(run, "shard long, path string, n_docs long, n_ids long, n_bytes long"), "token-manifest")


def read_tokens(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    prepare(manifest.sparkSession)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).select("path", "base")
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _place(row["path"])
                with system.open_input_file(path) as f:
                    out: list[dict] = []
                    held = 0
                    for doc, begin, pieces in Reader(f).documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.tobytes(), crc)
                        count = sum(map(len, pieces))
                        out.append({"doc_id": doc, "start": row["base"] + begin, "n_tokens": count, "ids_crc32": crc} | ({"ids": np.concatenate(pieces).astype("<i4")} if keep_ids else {}))
                        held += count * keep_ids + 8
                        if held >= 1 << 19:
                            yield _rows(out, keep_ids)
                            out, held = [], 0
                    yield _rows(out, keep_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return placed.repartition(n).mapInArrow(run, schema)


def _rows(rows: list[dict], keep_ids: bool) -> pa.RecordBatch:
    columns = [pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if keep_ids:
        columns.append(pa.array([r["ids"] for r in rows], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def op2_bitplane_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return read_tokens(write_tokens(docs.select("doc_id", "text"), tokenizer_path))
