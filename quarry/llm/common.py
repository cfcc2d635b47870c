"""What the training-data operators share: shared-folder staging, skew-proof joins, prefix sums, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.shipping import ship

#: At most this many keys are ever called hot, which bounds what `attach` broadcasts.
MAX_HOT = 1000
#: A staged table of fewer bytes isn't searched for frequent keys.
SMALL_BYTES = 1 << 14
#: A key with fewer rows than this is never worth special treatment.
MIN_HOT = 2000
#: Bits of a sieve for each row it is made of, its most bits (with more rows it lets more through) and those of one row.
SIEVE_BITS, SIEVE_MOST, SIEVE_ROW = 16, 1 << 26, 1 << 15
#: Lets Spark delete the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches handed to Python and ship this package to the executors once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Where neither is set, a session whose executors are threads of the driver (tests) gets a folder of our own; a
    cluster gets an error, since a folder of one machine would be no shared one.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quarry-checkpoints-')}"
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path.rstrip("/")


#: Folders that this driver has staged, in order; None where one has been deleted.
_STAGED: list[str | None] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _STAGED.append(f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}")
    return _STAGED[-1]


def unused(name: str, *taken: Sequence[str]) -> str:
    """``name``, lengthened until no column of ``taken`` is called so (Spark's names ignore case)."""
    known = {c.lower() for columns in taken for c in columns}
    while name.lower() in known:
        name += "_"
    return name


def mark() -> int:
    """A point in time for `release`."""
    return len(_STAGED)


def release(spark: SparkSession, since: int, *keep: DataFrame, until: int | None = None) -> None:
    """Delete the folders staged since a mark (up to another), but for those of the staged tables in ``keep``."""
    kept = {getattr(df, "_staged", None) for df in keep}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for i in range(since, len(_STAGED) if until is None else until):
        path = _STAGED[i]
        if path is not None and path not in kept:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            _STAGED[i] = None


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    This cuts lineage the durable way: a lost executor costs a re-read, never a recomputation.  The shuffle files of
    the write go as soon as it ends; the session's own setting holds again then.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _bytes(df: DataFrame) -> int:
    """Size of a staged table's files, or a very large number for any other DataFrame."""
    path = getattr(df, "_staged", None)
    if path is None:
        return 1 << 62
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row for each key) that no hot key can unbalance.

    ``weight`` is a column of ``small`` that says how many rows of ``big`` a key has.  Keys with a
    thousandth of all rows or more are hot; by that definition there are at most `MAX_HOT` of them, so
    they are broadcast whatever the size of the tables, and only the others are shuffled.
    ``weight`` is dropped from the result.
    """
    total, most = small.agg(F.sum(weight), F.max(weight)).first()
    least = max(MIN_HOT, -(-(total or 0) // MAX_HOT))
    if (most or 0) < least:
        return big.join(small.drop(weight), list(on))
    hot = small.where(F.col(weight) >= least)
    keys = F.broadcast(hot.select(*on))
    return big.join(F.broadcast(hot.drop(weight)), list(on)).unionByName(
        big.join(keys, list(on), "left_anti").join(small.where(F.col(weight) < least).drop(weight), list(on))
    )


def lookup(big: DataFrame, small: DataFrame, on: str, rows_of: DataFrame | None = None) -> DataFrame:
    """Left join of ``big`` with ``small`` (at most one row for each key), whatever share of ``big`` one key holds.

    The `MAX_HOT` most frequent keys of `MIN_HOT` rows or more are counted out first; their rows of ``small``, one for
    each, are broadcast and only the others are shuffled.  Null keys find nothing.  A staged table of a few
    kilobytes (``rows_of``, if ``big`` has its rows but isn't staged) is joined as it is: one task can hold all of it.
    """
    if _bytes(rows_of or big) < SMALL_BYTES:
        return big.join(small, on, "left")
    counted = big.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= MIN_HOT)
    hot = [r[0] for r in counted.orderBy(F.col("_rows").desc(), on).limit(MAX_HOT).collect()]
    if not hot:
        return big.join(small, on, "left")
    of_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return big.where(of_hot).join(F.broadcast(small.where(of_hot)), on, "left").unionByName(big.where(~of_hot).join(small, on, "left"))


def sieve(big: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """``big`` without most of the rows whose key isn't in ``small`` (a staged table), ahead of a join on that key.

    Every row with a key of ``small`` (of the same type) stays, and of the others about one in `SIEVE_BITS`, more where
    `SIEVE_MOST` bounds the bits, 8 MB, that are broadcast: a key's hash is one bit.  Rows with a null key go.
    """
    bits = min(SIEVE_MOST, SIEVE_ROW * -(-max(1, small.count() * SIEVE_BITS) // SIEVE_ROW))
    at, row, bit, held = (unused(c, big.columns) for c in ("_at", "_row", "_bit", "_bits"))
    place = F.pmod(F.xxhash64(on), F.lit(bits))
    rows = small.where(F.col(on).isNotNull()).select(place.alias(at)).select(F.expr(f"{at} div {SIEVE_ROW}").alias(row), (F.col(at) % SIEVE_ROW).alias(bit))
    rows = rows.groupBy(row).agg(F.bitmap_construct_agg(bit).alias(held))
    found = big.where(F.col(on).isNotNull()).withColumn(at, place).withColumn(row, F.expr(f"{at} div {SIEVE_ROW}")).join(F.broadcast(rows), row)
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast({at} % {SIEVE_ROW} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return found.where(F.getbit(byte, (F.col(at) % 8).cast("int")) == 1).select(*big.columns)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, str], name: str) -> DataFrame:
    """Exclusive running sums over a total order, without ever sorting one key's rows in one task.

    Rows are dealt by ranges of (keys, order) - so a hot key spans many tasks - and staged, which fixes the
    ranges.  Each (range, key) is summed locally; the sums of the earlier ranges of the same key (one row for
    each range and key) are then added.  ``values`` maps output columns to the summed integer columns; nulls in
    them add nothing, null keys are a key of their own, rows that tie in ``order`` get sums in some order of theirs, and
    an empty table gives an empty table.
    """
    dealt = df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *order)
    dealt = stage(dealt.sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys], *order).withColumn("_part", F.spark_partition_id()), name)
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).cast("long").alias(f"_in_{o}") for o, c in values.items()])
    sums = dealt.groupBy("_part", *keys).agg(*[F.sum(c).cast("long").alias(f"_sum_{o}") for o, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).cast("long").alias(f"_base_{o}") for o in values]) if keys else sums.select("_part", *[F.coalesce(F.sum(f"_sum_{o}").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias(f"_base_{o}") for o in values])
    same = F.col("_part") == F.col("_part2")
    base = base.withColumnRenamed("_part", "_part2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(base, same)
    return joined.select(*[c for c in df.columns], *[(F.col(f"_in_{o}") + F.col(f"_base_{o}")).alias(o) for o in values])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, comp) for every id in ``edges`` (a, b): comp is the smallest id reachable.

    Hook-and-contract: every node takes its smallest neighbour as parent, parent chains are halved until they
    are flat, and the edges are contracted to the parents; a round at least halves each component, so the
    number of rounds is logarithmic.  Every table is staged, nothing of their size is collected, and a root that a third of
    all nodes point to is looked up without being a join key (`lookup`).  Loops (a = b) and rows with a null are no
    edges, repeated edges count once, and a table without an edge gives an empty table.
    """
    begin = mark()
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    labels = stage(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), name)
    while not edges.isEmpty():
        hooks = edges.groupBy("a").agg(F.min("b").alias("parent"))
        hooks = stage(hooks.withColumnRenamed("a", "node"), name)
        while True:
            up = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = stage(lookup(hooks, up, "parent").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), name)
            hooks = jumped.select("node", "parent")
            hooks._staged = jumped._staged
            if jumped.where("moved").isEmpty():
                break
        labels = stage(lookup(labels, hooks.withColumnRenamed("node", "comp"), "comp").select("id", F.coalesce("parent", "comp").alias("comp")), name)
        root = lambda c: hooks.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        edges = lookup(lookup(edges, root("a"), "a"), root("b"), "b", edges).select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y")).where("x <> y")
        edges = stage(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), name)
        release(edges.sparkSession, begin, edges, labels)
    release(labels.sparkSession, begin, labels)
    return labels
