"""Exact dedup by an extendible-hash index kept on shared files.

Texts are hashed to 64-bit keys.  A *directory* of ``2**depth`` slots maps a key's leading bits to a bucket;
a bucket that holds more bytes than its page may splits on its next bit, and the directory doubles whenever a
bucket gets deeper than the directory (Fagin et al. 1979).  Documents become entries, one for each different text of
a task, and probe the index with their key: the owner task of a bucket gets its entries in key order, chains entries
with the same key, compares them byte for byte and answers each with its class.  Two documents are therefore copies only
if their bytes are equal.  Directory and pages stay in the shared folder, where `probe` looks up other documents.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import attach, fresh_path, prepare, stage, unused

#: Bits of a key that directory splits may use; the directory never has more slots than this allows.
MAX_DEPTH = 16
#: Uncompressed bytes of a page before its bucket splits.
PAGE_BYTES = 16 << 20
#: Bytes of different texts that a task remembers while it looks for copies of them.
REMEMBERED = 16 << 20

_ENTRY = pa.schema([("entry", pa.int64()), ("key", pa.int64()), ("text", pa.binary()), ("copies", pa.int64()), ("last_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
_ANSWER = pa.schema([("kind", pa.string()), ("entry", pa.int64()), ("key", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text", pa.binary())])
_PAGE = "key long, chain int, text_sha256 string, keep_id long, group_size long, text binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the rows (key, text, id) of a task.

    Copies of a text that is still remembered join its entry, so a text that a third of all rows have costs an entry a
    task; an entry leaves when `REMEMBERED` bytes of texts have been used since it was.
    """
    seen: OrderedDict[bytes, list] = OrderedDict()  # text -> key, ids; least recently used first
    held, number = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

    def out(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal number
        made = []
        for text, (key, ids) in rows:
            made.append({"entry": number, "key": key, "text": text, "copies": len(ids), "last_id": max((i for i in ids if i is not None), default=None), "ids": ids})
            number += 1
        return pa.RecordBatch.from_pylist(made, schema=_ENTRY)

    for batch in batches:
        for key, text, doc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (entry := seen.get(text)) is not None:
                entry[1].append(doc)
                seen.move_to_end(text)
            else:
                seen[text] = [key, [doc]]
                held += len(text)
        gone = []
        while held > REMEMBERED and len(seen) > 1:
            gone.append(seen.popitem(last=False))
            held -= len(gone[-1][0])
        if gone:
            yield out(gone)
    while seen:
        yield out([seen.popitem(last=False) for _ in range(min(512, len(seen)))])


def directory(sizes: dict[int, int], depth: int, page_bytes: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(global depth, slots) of the directory for the byte counts of ``2**depth`` key prefixes.

    ``slots[prefix]`` is the bucket's first prefix at full depth.  Starts with one bucket at depth 0 and splits every
    bucket that holds more than ``page_bytes``, doubling the directory when a split needs one more bit.
    """
    top, local = 0, {0: 0}  # bucket prefix at its local depth -> local depth, as (prefix << (depth - local))
    todo = [(0, 0)]
    while todo:
        at, d = todo.pop()
        width = 1 << (depth - d)
        if d >= min(depth, max_depth) or sum(sizes.get(p, 0) for p in range(at, at + width)) <= page_bytes:
            continue
        top = max(top, d + 1)
        local[at], local[at + width // 2] = d + 1, d + 1
        todo += [(at, d + 1), (at + width // 2, d + 1)]
    slots, last = [], 0
    for p in range(0, 1 << depth, 1 << (depth - top)):
        last = p if p in local else last
        slots.append(last)
    return top, slots


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner task: entries (key, text, copies, last_id, entry) arrive in key order; equal keys are chained and their bytes
    compared.  A class makes a row of the page and, once all its entries are known, an answer for each of them."""
    key, chain = None, []

    def done() -> list[dict]:
        rows = []
        for i, (text, copies, last, entries) in enumerate(chain):
            row = {"key": key, "chain": i, "text_sha256": hashlib.sha256(text).hexdigest(), "keep_id": last, "group_size": copies}
            rows.append({"kind": "page", "entry": None, "text": text, **row})
            rows += [{"kind": "answer", "entry": e, "text": None, **row} for e in entries]
        return rows

    for batch in batches:
        rows: list[dict] = []
        for k, text, copies, last, entry in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if k != key:
                rows += done()
                key, chain = k, []
            for c in chain:
                if c[0] == text:  # the byte comparison
                    c[1] += copies
                    c[3].append(entry)
                    if last is not None and (c[2] is None or last > c[2]):
                        c[2] = last
                    break
            else:
                chain.append([text, copies, last, [entry]])
        yield pa.RecordBatch.from_pylist(rows, schema=_ANSWER)
    yield pa.RecordBatch.from_pylist(done(), schema=_ANSWER)


def _prefix(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def _bucket(key: Column, slots: list[int]) -> Column:
    """The bucket that the directory gives a key."""
    if len(slots) == 1:
        return F.lit(slots[0])
    shift = MAX_DEPTH - (len(slots).bit_length() - 1)
    return F.element_at(F.array(*[F.lit(s) for s in slots]), (F.shiftrightunsigned(_prefix(key), shift) + 1).cast("int"))


def _slots(sizes: DataFrame, page_bytes: int) -> list[int]:
    """The directory for texts of (key, size), of which equal ones count once."""
    found = sizes.groupBy("key").agg(F.max("size").alias("n")).groupBy(_prefix(F.col("key")).alias("p")).agg(F.sum("n").alias("bytes"))
    return directory({r["p"]: r["bytes"] for r in found.collect()}, MAX_DEPTH, page_bytes)[1]  # at most 2**MAX_DEPTH rows


def _winners(in_key_order: bool) -> Callable:
    """Of rows (key, body, place, ...) with equal bodies the one with the largest place, nulls last, else the first.

    In key order all rows of a key are together, so what comes out is final; otherwise it is a task's pre-aggregation, which
    forgets a text when `REMEMBERED` bytes of others have been read since it came last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, tuple] = OrderedDict()
        held, schema, key = 0, None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema, gone = batch.schema, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if in_key_order and row[0] != key:
                    gone += seen.values()
                    seen.clear()
                    key = row[0]
                before = seen.get(row[1])
                if before is None:
                    held += len(row[1])
                if before is None or row[2] is not None and (before[2] is None or row[2] > before[2]):
                    seen[row[1]] = row
                if not in_key_order:
                    seen.move_to_end(row[1])
            while not in_key_order and held > REMEMBERED and len(seen) > 1:
                gone.append(seen.popitem(last=False)[1])
                held -= len(gone[-1][1])
            if gone:
                yield out(gone)
        while seen:
            yield out([seen.popitem(last=False)[1] for _ in range(min(512, len(seen)))])

    return run


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("key"), F.encode(text, "UTF-8").alias("text"), F.col(id_col).cast("long").alias("id"))
    return rows.mapInArrow(_entries, "entry long, key long, text binary, copies long, last_id long, ids array<long>")


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", page_bytes: int = PAGE_BYTES) -> tuple[DataFrame, str]:
    """(entries, folder): the documents' entries (entry, ids), and the folder of the index in the shared folder.

    The folder holds ``directory`` (slot, bucket), ``kind=page`` (one row for each different text, in key order within its
    bucket) and ``kind=answer`` (the class of each entry).
    """
    spark = prepare(docs.sparkSession)
    entries = stage(_keyed(docs, text_col, id_col).withColumn("size", F.length("text")), "exact-entries")
    slots = _slots(entries.select("key", "size"), page_bytes)
    folder = fresh_path(spark, "exact-index")
    dealt = entries.withColumn("bucket", _bucket(F.col("key"), slots)).repartition(len(set(slots)), "bucket").sortWithinPartitions("bucket", "key")
    answered = dealt.select("key", "text", "copies", "last_id", "entry").mapInArrow(_chain, "kind string, entry long, key long, chain int, text_sha256 string, keep_id long, group_size long, text binary")
    answered.write.option("compression", "zstd").partitionBy("kind").parquet(folder)
    spark.createDataFrame(list(enumerate(slots)), "slot int, bucket int").coalesce(1).write.parquet(f"{folder}/directory")
    return entries.select("entry", "ids"), folder


def pages(docs: DataFrame, folder: str) -> DataFrame:
    """The classes of a stored index: key, chain, text_sha256, keep_id, group_size, text."""
    return docs.sparkSession.read.schema(T.StructType.fromDDL(_PAGE)).parquet(f"{folder}/kind=page")


def probe(docs: DataFrame, folder: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, keep_id, group_size) of each row of ``docs``: the class of a stored index whose bytes equal its text, nulls if none does.

    Null texts count as empty; rows may repeat and have null ids; an empty table gives an empty table.  Different texts of a
    task are looked up once, so a hot text is compared once a task.
    """
    prepare(docs.sparkSession)
    entries = stage(_keyed(docs, text_col, id_col), "exact-probes")
    classes = pages(docs, folder).select("key", F.col("text").alias("same"), "keep_id", "group_size")
    found = entries.join(classes, (entries["key"] == classes["key"]) & (F.col("text") == F.col("same")), "left")
    return found.select(F.explode("ids").alias("id"), "keep_id", "group_size")


def verdicts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``, as `exact_dedup` says."""
    entries, folder = build_index(docs, text_col, id_col, page_bytes)
    schema = "entry long, text_sha256 string, keep_id long, group_size long"
    if docs.sparkSession.read.parquet(f"{folder}/directory").isEmpty() or entries.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    answers = docs.sparkSession.read.schema(T.StructType.fromDDL(schema)).parquet(f"{folder}/kind=answer")
    rows = entries.join(answers, "entry").select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "text_sha256")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal if identical; null counts as the empty text (empty texts form one group).  Of equal texts the
    row with the largest id stays; a null id never wins over an id, and rows that repeat the winning id with the same
    text all stay marked as kept (they are the same document twice) - `drop_copies` then keeps one of them.
    An empty table gives an empty result.  Extra columns pass through untouched; columns of ``docs`` that are
    called like an output are replaced.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    own = docs.drop(*[c for c in made if c in docs.columns and c not in (text_col, id_col)])
    doc, sha, weight = (unused(x, docs.columns) for x in ("_doc", "_sha", "_weight"))
    found = verdicts(docs, text_col, id_col, page_bytes).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias(doc), F.col("text_sha256").alias(sha))
    found = stage(found.agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.first("kept").alias("kept"), F.count("*").alias(weight)), "exact-verdicts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = own.withColumns({doc: F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), sha: F.sha2(F.encode(text, "UTF-8"), 256)})
    return attach(rows, found, [doc, sha], weight).withColumnRenamed(sha, "text_sha256").select(*own.columns, *made)


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id, with the columns of ``docs``.

    Rows go to the owners of their buckets whole, after copies within a task have met, and the owners compare bytes; so no
    table is joined and nothing but the shuffle is stored.  Of rows that repeat id and text both one stays.  A null text
    counts as the empty one, a null id stays only where its text has no id at all, an empty table gives an empty table.
    Extra columns, whatever they are called, pass through.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slots = _slots(docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).alias("size")), page_bytes)
    others = [c for c in docs.columns if c != text_col]
    rest = [F.col(c).alias(f"c{i}") for i, c in enumerate(others)]
    rows = docs.select(F.xxhash64(text).alias("key"), F.encode(text, "UTF-8").alias("body"), F.col(id_col).cast("long").alias("place"), F.col(text_col).isNull().alias("null_text"), *rest)
    first = rows.mapInArrow(_winners(False), rows.schema).withColumn("bucket", _bucket(F.col("key"), slots))
    dealt = first.repartition(len(set(slots)), "bucket").sortWithinPartitions("bucket", "key").drop("bucket")
    kept = dealt.mapInArrow(_winners(True), rows.schema)
    back = {text_col: F.when(~F.col("null_text"), F.decode("body", "UTF-8")), **{c: F.col(f"c{i}") for i, c in enumerate(others)}}
    return kept.select(*[back[c].alias(c) for c in docs.columns])


def op8_exact_dedup(docs: DataFrame) -> DataFrame:
    return verdicts(docs)


ORACLE_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size, sha256(coalesce(text, '')) AS text_sha256
      FROM documents)
"""
