"""Near-duplicate documents by min-max hashing.

Each hash evaluation of a document's shingles serves twice: its minimum and its maximum are both signature components
(Ji, Li, Yan, Tian & Zhang, ICDM 2013), so 64 evaluations give a signature of 128 unbiased components.  Four
components make a band; documents that agree in a band meet in a bucket.  At the similarity limit of 0.8 a pair of
documents agrees in none of the 32 bands with probability (1 - 0.8**4)**32 < 5e-8.

Buckets are never expanded into all pairs.  Equal shingle sets are one class from the start.  In the first round every
member is compared with one pivot of its bucket, the member that shares the most buckets with others (the centre
of a family of copies).  Then only members that are still outside their bucket's main component are compared, in blocks,
with every member of another component; a fine signature, made for those documents only (one bit of the minimum and
one of the maximum of 1024 hash evaluations), rules out the partners that cannot reach 0.8.  A pair counts only after its
full shingle sets have been compared, and no partner is dropped by a cap, so the components are those of the full
graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.common import attach, components, lookup, mark, prepare, release, sieve, stage, unused

HASHES, BAND = 64, 4
BANDS = 2 * HASHES // BAND
#: Hash evaluations of the fine signature, two bits each.
FINE = 1024
#: Standard deviations below the expected number of equal bits at the similarity limit that still count as possible.
DEVIATIONS = 4.5
#: Rows of one side of a compared block: as few while a side has up to `CUTS` blocks, as many beyond, so that neither a
#: task nor the number of copies of a row grows much with a bucket.
OUTER_BLOCK, INNER_BLOCK = (256, 8192), (1024, 16384)
CUTS = 16
#: Rows that one copy of a pivot's shingle set serves.
PIVOT_ROWS = 256

_SEEDS = W.mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FINE_SEEDS = (W.mix64(np.arange(1, FINE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SET1, _SET2 = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, sorted within each text and distinct; number of each text's shingles).

    Words are lower-cased over A-Z; a text of fewer than ``width`` words has its whole word sequence as one shingle.
    """
    w = W.scan(column)
    h = w.hashes(lower=True)
    value, doc, _ = W.windows(w, h, width)
    for n in range(1, width):  # texts of n words: the sequence of all their words
        rows = np.flatnonzero(w.counts == n)
        if len(rows):
            at = w.first[rows][:, None] + np.arange(n)
            value = np.concatenate([value, np.array([W.sequence_hashes(x, n)[0] for x in h[at]], np.uint64)])
            doc = np.concatenate([doc, rows])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.bincount(doc[keep], minlength=len(w.counts))


def signatures(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bands (texts, BANDS) of four 16-bit components each, and two 64-bit hashes of each set)."""
    n = len(count)
    some = np.flatnonzero(count)
    begin = (np.cumsum(count) - count)[some]
    out = np.zeros((n, 2 * HASHES), np.uint16)
    if len(some):
        for k in range(HASHES):
            p = value * _SEEDS[k]
            p ^= p >> np.uint64(32)
            p *= _SEEDS[HASHES - 1 - k]
            out[some, k] = W.mix64(np.minimum.reduceat(p, begin)).astype(np.uint16)
            out[some, HASHES + k] = W.mix64(np.maximum.reduceat(p, begin)).astype(np.uint16)
    return out.view("<i8").reshape(n, BANDS), *_set_hashes(value, count)


def _sketch(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                value, count = shingles(part.column(1), width)
                bands, one, two = signatures(value, count)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int64)), pa.array(one), pa.array(two), lists], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def _set_hashes(value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set of shingles."""
    one, two = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        begin = (np.cumsum(count) - count)[some]
        one[some] = np.add.reduceat(W.mix64(value ^ _SET1), begin)
        two[some] = np.add.reduceat(W.mix64(value ^ _SET2), begin)
    return one.view(np.int64), two.view(np.int64)


def _sets(width: int) -> Callable:
    """(id, shingles, roles) of rows (id, s1, s2, text, roles); a text that isn't of the class it was taken for (its id is repeated) gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                value, count = shingles(part.column(3), width)
                one, two = _set_hashes(value, count)
                own = np.flatnonzero((one == part.column(1).to_numpy()) & (two == part.column(2).to_numpy()))
                ends = np.cumsum(count)
                raw = value.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip((ends - count)[own].tolist(), ends[own].tolist(), strict=True)]
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), pa.array(sets, pa.binary()), part.column(4).take(own)], names=["id", "shingles", "roles"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def _verify(percent: int) -> Callable:
    """(a, b) of rows (hub, salt, member, id, shingles) in this order: the members whose full sets have 100 * intersection >=
    percent * union with that of their hub, which comes first."""

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = _common(a, b)
        return 100 * both >= percent * (len(a) + len(b) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub_set = None, None
        for batch in batches:
            hub, salt, member, ids = (c.to_pylist() for c in batch.columns[:4])
            pairs = []
            for k, x in enumerate(batch.column(4)):
                own = np.frombuffer(x.as_buffer(), "<u8")
                if not member[k]:
                    held, hub_set = (hub[k], salt[k]), own.copy()
                elif held == (hub[k], salt[k]) and similar(own, hub_set):
                    pairs.append((ids[k], hub[k]))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _roles(pairs: DataFrame) -> DataFrame:
    """(id, hub, salt, member): where the sets go that the pairs (id, hub) need, members to one copy of their hub's set and
    hubs to all of theirs.  A hub's set is copied once for every `PIVOT_ROWS` of its pairs, so a hub of a third of all
    rows is spread over as many tasks as the others.  Repeated pairs count once, pairs with a null are dropped."""
    pairs = stage(pairs.distinct(), "near-pairs")
    hubs = stage(pairs.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.count("*") / PIVOT_ROWS).cast("int").alias("parts")), "near-hubs")
    members = attach(pairs, hubs, ["hub"], "n").select("id", "hub", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("salt"), F.lit(True).alias("member"))
    copies = hubs.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(False).alias("member"))
    return members.unionByName(copies)


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members and hubs whose full sets are similar, of rows (id, hub, salt, member, shingles) as `_roles` places
    them.  Pairs with an id that has no set are dropped, no rows give an empty table."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.select("hub", "salt", "member", "id", "shingles").repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return dealt.mapInArrow(_verify(percent), "a long, b long")


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, 2 * FINE bits) of sets: equal bits of two sets are a share (1 + similarity) / 2 of all."""
    for batch in batches:
        raw = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
        step, at = 1 << 19, 0  # shingles at a time
        while at < len(raw):
            to, held = at, 0
            while to < len(raw) and (to == at or held + len(raw[to]) <= step):
                held += len(raw[to])
                to += 1
            value = (np.concatenate(raw[at:to]) >> np.uint64(32)).astype(np.uint32)
            begin = np.cumsum([0] + [len(x) for x in raw[at : to - 1]])
            bits = np.zeros((to - at, 2 * FINE), bool)
            for k in range(FINE):
                p = value * _FINE_SEEDS[k]
                p ^= p >> np.uint32(15)
                p *= _FINE_SEEDS[FINE - 1 - k]
                for j, least in enumerate((np.minimum.reduceat(p, begin), np.maximum.reduceat(p, begin))):
                    least = (least ^ (least >> np.uint32(16))) * np.uint32(0x7FEB352D)
                    bits[:, 2 * k + j] = (least >> np.uint32(31)).astype(bool)
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "fine"])
            at = to


def _blocks(percent: int) -> Callable:
    """Candidate pairs of block rows (key, band, x, y, outer, id, comp, bands, fine), sorted by block.

    outer rows are compared with all inner rows of another component; a pair comes out of the first band only that
    its signatures share.
    """
    same = (1 + percent / 100) / 2
    least = 2 * FINE * same - DEVIATIONS * (2 * FINE * same * (1 - same)) ** 0.5

    def compare(o_id, o_comp, o_sig, o_fine, i_id, i_comp, i_sig, i_fine, band) -> list[tuple]:  # noqa: ANN001
        found = []
        for k in range(len(o_id)):
            equal = 2 * FINE - np.bitwise_count(i_fine ^ o_fine[k]).sum(axis=1, dtype=np.int64)
            at = np.flatnonzero((equal >= least) & (i_comp != o_comp[k]))
            at = at[(i_sig[at] == o_sig[k]).argmax(axis=1) == band] if len(at) else at
            found += [(int(o_id[k]), int(x)) for x in i_id[at]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        block = None

        def done() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            outer = t["outer"].to_numpy()
            ids, comp = t["id"].to_numpy(), t["comp"].to_numpy()
            sig = np.ascontiguousarray(t["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS))
            o, i = np.flatnonzero(outer), np.flatnonzero(~outer)
            fine = np.stack([np.frombuffer(x.as_buffer(), "<u8") for x in t["fine"]])
            pairs = compare(ids[o], comp[o], sig[o], fine[o], ids[i], comp[i], sig[i], fine[i], int(t["band"][0].as_py()))
            return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["id", "hub"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            key, x, y = (t[c].to_numpy() for c in ("key", "x", "y"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if b == a:
                    continue
                here = (key[a], x[a], y[a])
                if block is not None and here != block:
                    yield done()
                    held = []
                block = here
                held.append(t.slice(a, b - a))
        if held:
            yield done()

    return run


def _cuts(rows: str, block: tuple[int, int]) -> Column:
    """How many blocks a side of so many rows is cut into."""
    few, many = (F.ceil(F.col(rows) / b).cast("int") for b in block)
    return F.greatest(F.least(few, F.lit(CUTS)), many)


def _outsiders(members: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of members outside the main component of their bucket with members of other components."""
    now = members.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    now = stage(now, "near-members")
    state = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max_by("comp", F.struct("score", -F.col("id"))).alias("main"), F.count("*").alias("n")).where("low <> high").select("key", "main", "n")
    rows = stage(attach(now, stage(state.withColumn("size", F.col("n")), "near-state"), ["key"], "n"), "near-open")
    outside = rows.where("comp <> main").groupBy("key").agg(F.count("*").alias("u"), F.first("size").alias("n"))
    rows = attach(rows, stage(outside, "near-outside"), ["key"], "n")
    rows = stage(rows, "near-rows")
    fine = stage(sieve(sets.select("id", "shingles"), rows, "id").mapInArrow(_fine, "id long, fine binary"), "near-fine")
    rows = rows.join(fine.join(reps.select("id", "bands"), "id"), "id").withColumns({"ny": _cuts("u", OUTER_BLOCK), "nx": _cuts("size", INNER_BLOCK), "h": F.xxhash64("id")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "band", "x", "y", "outer", "id", "comp", "bands", "fine"]
    inner = rows.withColumn("y", every("ny")).withColumn("x", F.pmod("h", "nx").cast("int")).withColumn("outer", F.lit(False)).select(*columns)
    outer = rows.where("comp <> main").withColumn("x", every("nx")).withColumn("y", F.pmod("h", "ny").cast("int")).withColumn("outer", F.lit(True)).select(*columns)
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = inner.unionByName(outer).repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(_blocks(percent), "id long, hub long")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Texts are linked if 100 * intersection >= percent * union of their sets of distinct shingles of ``width`` words (a
    shorter text's whole word sequence is its one shingle); component_id is the smallest id reachable and kept says
    that it is the row's own.  Null texts and texts without a word have no shingle and are linked with nothing.  Rows
    that repeat an id are one document whatever their texts are: it is linked to all that one of them is linked to, and
    they are all kept or all not (n_shingles is each row's own).  Rows with a null id take no part: component_id is null,
    kept true.  An empty table gives an empty table.
    """
    spark, begin = prepare(docs.sparkSession), mark()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = stage(rows.mapInArrow(_sketch(width), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "near-sketch")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one class; its number is its own, also where rows of several classes repeat an id
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.max("bands").alias("bands"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "near-classes")
    repeats = not full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    # members of buckets that hold two classes at least
    banded = classes.select("id", F.posexplode("bands").alias("band", "value")).select("id", "band", F.xxhash64("band", "value").alias("key"))
    buckets = stage(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "near-buckets")
    met = stage(attach(sieve(banded, buckets, "key"), buckets, ["key"], "n"), "near-met")
    members = stage(met.join(met.groupBy("id").agg(F.sum("size").alias("score")), "id"), "near-scored")
    reps = classes.select("id", "bands")

    # round one: every member against its bucket's pivot; each set is made with a list of where it goes, and only of texts that go anywhere
    pivots = members.groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"), F.count("*").alias("n"))
    star = attach(members, stage(pivots, "near-pivots"), ["key"], "n").where("id <> hub").select("id", "hub")
    uses = _roles(star).groupBy("id").agg(F.collect_list(F.struct("hub", "salt", "member")).alias("roles"))
    needed = stage(classes.join(uses, "id").select(F.col("least").alias("doc_id"), "id", "s1", "s2", "roles"), "near-needed")
    sets = sieve(rows, needed, "doc_id").join(needed, "doc_id").select("id", "s1", "s2", "text", "roles")
    sets = sets.mapInArrow(_sets(width), "id long, shingles binary, roles array<struct<hub: long, salt: int, member: boolean>>")
    sets = stage(sets.groupBy("id").agg(F.first("shingles").alias("shingles"), F.first("roles").alias("roles")) if repeats else sets, "near-sets")
    labels = components(linked(sets.select("id", "shingles", F.inline("roles")), percent), "near-cc")

    # round two: members that are still outside
    pairs = _outsiders(members.select("key", "band", "id", "score"), reps, sets, labels, percent)
    seen = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))
    uses = stage(_roles(pairs), "near-roles")
    between = linked(sieve(sets.select("id", "shingles"), uses, "id").join(uses, "id"), percent).join(seen("a"), "a", "left").join(seen("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    merged = components(between, "near-cc")
    moved = merged.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    known = lookup(labels, moved, "comp").select("id", F.coalesce("to", "comp").alias("comp"))
    labels = known.unionByName(merged.join(labels.select("id"), "id", "left_anti"))

    placed = stage(classes.join(labels, "id", "left").select("s1", "s2", "least", "size", F.coalesce("comp", "id").alias("comp")), "near-placed")
    if repeats:
        placed = _one_document(full, placed)
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    final = stage(lookup(placed, smallest, "comp").select("s1", "s2", "component_id", "size"), "near-final")
    release(spark, begin, sketch, final)
    placed = attach(full.select("doc_id", "n_shingles", "s1", "s2"), final, ["s1", "s2"], "size").select("doc_id", "n_shingles", "component_id")
    rest = sketch.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if repeats:  # a document without a word in one row may have some in another
        of_id = placed.groupBy("doc_id").agg(F.min("component_id").alias("own"))
        rest = rest.join(of_id, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    return placed.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _one_document(full: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` with the components merged that hold rows of one id."""
    own = attach(full.select("doc_id", "s1", "s2"), placed.select("s1", "s2", "comp", "size"), ["s1", "s2"], "size").select("doc_id", "comp").distinct()
    own = stage(own, "near-own")
    low = own.groupBy("doc_id").agg(F.min("comp").alias("low"), F.count("*").alias("n")).where("n > 1").select("doc_id", "low")
    merged = components(own.join(low, "doc_id").select(F.col("comp").alias("a"), F.col("low").alias("b")), "near-cc")
    moved = merged.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return stage(lookup(placed, moved, "comp").withColumn("comp", F.coalesce("to", "comp")).drop("to"), "near-placed")


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id isn't the smallest of its component; all columns, whatever they are called, stay as they are.

    Nulls, repeated rows and empty tables are treated as `near_components` does: rows with a null id stay.
    """
    begin = mark()
    gone_id = unused("_gone", docs.columns)
    gone = stage(near_components(docs, width, percent, text_col, id_col).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct(), "near-gone")
    release(docs.sparkSession, begin, gone)
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")


def op3_minmax_neardup(docs: DataFrame) -> DataFrame:
    return near_components(docs.select("doc_id", "text"), width=2, percent=80)
