"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window (25 of 50 words); the blocks are the index.  Any
window of 50 words holds a whole block of each document it occurs in, so probing the index with every rolling
25-word window of every document finds an anchor in every repeat.  Around the anchors hits are extended: all
50-word windows that hold one are compared by 96-bit fingerprints, the smallest document of each is found, and runs of
windows that a smaller document has too are the maximal exact repeats, whose words go.

Nothing is paired up: owners of key ranges get each different key once from each group of documents (sorted,
delta-coded and compressed), and answer with the keys that are shared or with one bit for each window.  A passage
that a third of all documents share therefore costs one entry for each group, not one for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.common import prepare, stage

WINDOW = 50
#: Text that one group of documents holds, about; an owner's share of the keys follows from it.
GROUP_BYTES = 8 << 20
_OTHER = np.uint64(0x6A09E667F3BCC909)


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit keys as byte planes of their differences, compressed."""
    gaps = np.diff(keys.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(4 * n, 1)), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data), kind)


def flags(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def unflag(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(expand(data, np.uint8), count=n).astype(bool)


class Scanned:
    """Word hashes and rolling block keys of the texts that are long enough for a window."""

    def __init__(self, column: pa.Array, window: int, bits: int):
        self.words = w = W.scan(column)
        self.h = w.hashes()
        self.block = window // 2
        value, doc, pos = W.windows(w, self.h, self.block)
        long = w.counts[doc] >= window
        self.doc, self.pos = doc[long], pos[long]
        self.key = value[long] >> np.uint64(32 - bits)  # the owner's bits, then 32 more


def _runs(rows: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows with equal ``column`` of a sorted stream."""
    held: list[dict] = []
    for batch in rows:
        for row in batch.to_pylist():
            if held and row[column] != held[0][column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _anchors(window: int, bits: int) -> Callable:
    """Per group slice and owner: the different block keys, which of them are index blocks, which occur in two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for part in W.slices(batch.slice(a, b - a), "text", GROUP_BYTES):
                    s = Scanned(part.column(2), window, bits)
                    if not len(s.key):
                        continue
                    ids = part.column(1).to_numpy(zero_copy_only=False)[s.doc]
                    order = np.argsort(s.key, kind="stable")
                    key = s.key[order]
                    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    block = np.logical_or.reduceat(s.pos[order] % s.block == 0, begin)
                    multi = np.minimum.reduceat(ids[order], begin) != np.maximum.reduceat(ids[order], begin)
                    key = key[begin]
                    owner = (key >> np.uint64(32)).astype(np.int64)
                    at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    ends = [*at[1:].tolist(), len(key)]
                    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    spans = list(zip(at.tolist(), ends, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(owner[at].astype(np.int32)), pa.array(np.full(len(at), grp[a], np.int64)), pa.array([y - x for x, y in spans], pa.int32()),
                            pa.array([pack(low[x:y]) for x, y in spans], pa.binary()), pa.array([flags(block[x:y]) for x, y in spans], pa.binary()), pa.array([flags(multi[x:y]) for x, y in spans], pa.binary()),
                        ],
                        names=["owner", "grp", "n", "keys", "block", "multi"],
                    )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner: the keys that are an index block somewhere and occur in two texts at least, back to each group that sent them."""
    for rows in _runs(batches, "owner"):
        keys = [unpack(r["keys"], r["n"]) for r in rows]
        every = np.concatenate(keys)
        block = np.concatenate([unflag(r["block"], r["n"]) for r in rows])
        multi = np.concatenate([unflag(r["multi"], r["n"]) for r in rows])
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.concatenate([begin, [len(ordered)]]))
        good = np.logical_or.reduceat(block[order], begin) & ((count > 1) | np.logical_or.reduceat(multi[order], begin))
        hit = np.zeros(len(every), bool)
        hit[order] = np.repeat(good, count)
        at, out = 0, []
        for r, k in zip(rows, keys, strict=True):
            found = k[hit[at : at + len(k)]]
            at += len(k)
            if len(found):
                out.append({"grp": r["grp"], "owner": r["owner"], "n": len(found), "keys": pack(found)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("grp", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("keys", pa.binary())]))


_STEP2 = pa.schema(
    [
        ("kind", pa.int32()), ("grp", pa.int64()), ("doc", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.string()),
        ("occ", pa.binary()), ("local", pa.binary()), ("owner", pa.int32()), ("part", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("blob", pa.binary()),
    ]
)


def _joined_sha(w: W.Words, i: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the (kept) words of text i, joined by single spaces."""
    a, b = int(w.first[i]), int(w.first[i + 1])
    starts, ends = w.starts[a:b], w.ends[a:b]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    raw = w.buf
    size = ends - starts
    if not len(size):
        return hashlib.sha256(b"").hexdigest()
    # gather words and the byte behind each, then make that byte a space
    to = np.cumsum(size + 1)
    at = np.repeat(starts - (to - size - 1), size + 1) + np.arange(int(to[-1]))
    out = raw[at]
    out[to - 1] = 0x20
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def _candidates(window: int, bits: int) -> Callable:
    """Extend hits: fingerprints of all windows that hold an anchor, the smallest document of each in this group."""

    def run(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return _STEP2.empty_table()
        answers = right.to_pylist()
        known = np.sort(np.concatenate([(np.uint64(r["owner"]) << np.uint64(32)) | unpack(r["keys"], r["n"]).astype(np.uint64) for r in answers])) if answers else np.zeros(0, np.uint64)
        known = np.unique(known)
        out: list[dict] = []
        grp = left["grp"][0].as_py()
        blank = dict.fromkeys(_STEP2.names)
        cand: list[tuple] = []  # (row number in docs, position, fingerprint a, b, doc id) of every candidate window
        docs: list[tuple] = []  # (doc id, n_words, text) of the documents that have one
        for batch in left.combine_chunks().to_batches():
            for part in W.slices(batch, "text", GROUP_BYTES):
                s = Scanned(part.column(2), window, bits)
                w = s.words
                ids, texts = part.column(1), part.column(2)
                marked = np.zeros(part.num_rows, bool)
                if len(known) and len(s.key):
                    near = np.searchsorted(known, s.key)
                    near[near == len(known)] = 0
                    hit = known[near] == s.key
                    # window p of a text holds an anchor if one of its block positions p .. p + window - block is hit
                    total = np.concatenate([[0], np.cumsum(hit)])
                    lead = np.flatnonzero(s.pos + window <= w.counts[s.doc])  # s rows of one text are consecutive
                    some = total[lead + window - s.block + 1] - total[lead] > 0
                    lead = lead[some]
                    if len(lead):
                        ok = ~np.array(part.column(1).is_null().to_numpy(zero_copy_only=False))[s.doc[lead]]
                        lead = lead[ok]
                    if len(lead):
                        doc, pos = s.doc[lead], s.pos[lead]
                        at = w.first[doc] + pos
                        a = W.sequence_hashes(s.h, window)[at]
                        b = (W.sequence_hashes(W.mix64(s.h ^ _OTHER), window)[at] >> np.uint64(32)).astype(np.uint32)
                        marked[doc] = True
                        number = np.cumsum(marked) - 1 + len(docs)
                        own = ids.to_numpy(zero_copy_only=False)
                        cand.append((number[doc], pos, a, b, own[doc].astype(np.int64)))
                        rows = np.flatnonzero(marked)
                        docs += [(int(own[i]), int(w.counts[i]), texts[int(i)].as_py()) for i in rows]
                for i in np.flatnonzero(~marked).tolist():
                    out.append(blank | {"kind": 0, "grp": grp, "doc": ids[i].as_py(), "n_words": int(w.counts[i]), "sha": _joined_sha(w, i)})
        if cand:
            number, pos, a, b, doc = (np.concatenate(c) for c in zip(*cand, strict=True))
            order = np.lexsort((doc, b, a))
            number, pos, a, b, doc = number[order], pos[order], a[order], b[order], doc[order]
            begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            count = np.diff(np.concatenate([begin, [len(a)]]))
            entry = np.repeat(np.arange(len(begin)), count)
            local = doc > np.repeat(doc[begin], count)  # a smaller document of this very group has the window
            a1, b1, d1 = a[begin], b[begin], doc[begin]
            owner = (a1 >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a1), np.int64)
            at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for x, y in zip(at.tolist(), [*at[1:].tolist(), len(a1)], strict=True):
                blob = squeeze(np.concatenate([a1[x:y].view(np.uint8), b1[x:y].view(np.uint8), d1[x:y].view(np.uint8)]))
                out.append(blank | {"kind": 2, "grp": grp, "owner": int(owner[x]), "part": grp, "first": x, "n": y - x, "blob": blob})
            by_doc = np.argsort(number, kind="stable")
            number, pos, entry, local = number[by_doc], pos[by_doc], entry[by_doc], local[by_doc]
            cut = np.searchsorted(number, np.arange(len(docs) + 1)).tolist()
            for k, (d, n, text) in enumerate(docs):
                x, y = cut[k], cut[k + 1]
                here = local[x:y]
                occ = np.stack([pos[x:y][~here], entry[x:y][~here]]).astype("<u4")
                out.append(blank | {"kind": 1, "grp": grp, "doc": d, "n_words": n, "text": text, "occ": squeeze(occ), "local": squeeze(pos[x:y][here].astype("<u4"))})
        return pa.Table.from_pylist(out, schema=_STEP2)

    return run


def _smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner: for each window of each group, whether a smaller document of another group has it."""
    for rows in _runs(batches, "owner"):
        a, b, d = [], [], []
        for r in rows:
            raw, n = expand(r["blob"], np.uint8), r["n"]
            a.append(raw[: 8 * n].view("<u8"))
            b.append(raw[8 * n : 12 * n].copy().view("<u4"))
            d.append(raw[12 * n :].copy().view("<i8"))
        a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        order = np.lexsort((d, b, a))
        sa, sb = a[order], b[order]
        begin = np.flatnonzero(np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])]))
        least = np.repeat(d[order][begin], np.diff(np.concatenate([begin, [len(a)]])))
        gone = np.zeros(len(a), bool)
        gone[order] = d[order] > least
        at, out = 0, []
        for r in rows:
            out.append({"grp": r["grp"], "first": r["first"], "n": r["n"], "gone": flags(gone[at : at + r["n"]])})
            at += r["n"]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("grp", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("gone", pa.binary())]))


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _cut(window: int, keep_text: bool) -> Callable:
    """Remove the words of the windows that a smaller document has."""
    schema = _RESULT.append(pa.field("kept_text", pa.string())) if keep_text else _RESULT

    def run(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return schema.empty_table()
        answers = right.to_pylist()
        gone = np.zeros(max((r["first"] + r["n"] for r in answers), default=0), bool)
        for r in answers:
            gone[r["first"] : r["first"] + r["n"]] = unflag(r["gone"], r["n"])
        out = []
        for row in left.to_pylist():
            w = W.scan(pa.array([row["text"]], pa.large_string()))
            occ = expand(row["occ"], "<u4").reshape(2, -1)
            starts = np.concatenate([expand(row["local"], "<u4"), occ[0][gone[occ[1]]]]).astype(np.int64)
            cover = np.zeros(row["n_words"] + 1, np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, np.minimum(starts + window, row["n_words"]), -1)
            keep = np.cumsum(cover)[:-1] == 0
            made = {"doc_id": row["doc"], "n_words": row["n_words"], "n_removed": int((~keep).sum()), "kept_sha256": _joined_sha(w, 0, keep)}
            if keep_text:
                made["kept_text"] = b" ".join(w.buf[x:y].tobytes() for x, y in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)).decode()
            out.append(made)
        return pa.Table.from_pylist(out, schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of ``docs``.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also starts in a document with
    a smaller id; windows are judged on the input.  Null and empty texts have no words and keep none (the digest is of
    no bytes).  Rows that repeat an id are not smaller than each other, so they don't remove from one another; rows with
    a null id are no smaller than any and lose nothing.  An empty table gives an empty table.  With
    ``keep_text`` the kept words (joined by one space) come along for documents that lost some, null for the others.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    bits = min(20, max(0, (groups - 1).bit_length()))  # owners: the power of two at or above the groups
    rows = rows.select(F.pmod(F.xxhash64("doc", F.lit(9)), F.lit(groups)).alias("grp"), "doc", "text")

    dealt = rows.repartition(groups, "grp").sortWithinPartitions("grp")
    sent = dealt.where("doc IS NOT NULL").mapInArrow(_anchors(window, bits), "owner int, grp long, n int, keys binary, block binary, multi binary")
    owned = sent.repartition(1 << bits, "owner").sortWithinPartitions("owner")
    answers = stage(owned.mapInArrow(_shared, "grp long, owner int, n int, keys binary"), "sub-shared")

    ddl = "kind int, grp long, doc long, n_words long, sha string, text string, occ binary, local binary, owner int, part long, first long, n int, blob binary"
    step = rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_candidates(window, bits), ddl)
    step = stage(step, "sub-candidates")

    windows = step.where("kind = 2").select("owner", "grp", "first", "n", "blob").repartition(1 << bits, "owner").sortWithinPartitions("owner")
    verdicts = stage(windows.mapInArrow(_smaller, "grp long, first long, n int, gone binary"), "sub-verdicts")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else "")
    some = step.where("kind = 1").select("grp", "doc", "n_words", "text", "occ", "local").groupBy("grp").cogroup(verdicts.groupBy("grp")).applyInArrow(_cut(window, keep_text), schema)
    none = step.where("kind = 0").select(F.col("doc").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), *([F.lit(None).cast("string").alias("kept_text")] if keep_text else []))
    return some.unionByName(none)


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least_id FROM g) WHERE least_id < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT t.doc_id, len(t.w) AS n_words, len(t.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id
"""
