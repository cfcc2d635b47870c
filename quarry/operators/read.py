"""Read calls over an index: sources, passages with neighbours, whole documents in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the argument clamps.
LIMITS = {"limit": (1, 50), "context": (0, 5), "max_chars": (1000, 200000)}
SAMPLE_TITLES = 12


def clamp(name: str, value: int) -> int:
    low, high = LIMITS[name]
    return max(low, min(high, value))


def list_sources(sources: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """source, files, chunks, indexed_at: every source, also those without a file.

    Chunks are counted per file first, so that the join with files has one row for each file.
    """
    per_file = chunks.groupBy("source", "file_id").agg(F.count("*").alias("n"))
    counted = files.join(per_file, ["source", "file_id"], "left").groupBy("source").agg(F.countDistinct("file_id").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"), F.max("indexed_at").alias("last_file"))
    return sources.join(counted, "source", "left").select("source", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("last_success_at", "last_file").alias("indexed_at"))


def sample_titles(files: DataFrame, count: int = SAMPLE_TITLES) -> DataFrame:
    """source, titles: titles of the files with the shortest paths (then by path), at most ``count``; files without one don't count."""
    order = Window.partitionBy("source").orderBy(F.length("path"), "path")
    top = files.where(F.col("title").isNotNull()).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= count)
    return top.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]).alias("titles"))


def fetch_chunk(chunks: DataFrame, source: str, chunk_id: int, context: int = 1) -> DataFrame:
    """The passage and up to ``context`` (0 to 5) neighbours on either side in its document, in order.

    The passage is a point lookup whose single row is broadcast; the neighbours are a range of ord.
    """
    context = clamp("context", context)
    hit = F.broadcast(chunks.where((F.col("source") == source) & (F.col("chunk_id") == chunk_id)).select("source", "file_id", F.col("ord").alias("at")).limit(1))
    near = chunks.join(hit, ["source", "file_id"]).where(F.col("ord").between(F.col("at") - context, F.col("at") + context))
    return near.select("source", "file_id", "chunk_id", "ord", "text", (F.col("ord") == F.col("at")).alias("is_hit")).orderBy("ord")


def document_text(chunks: DataFrame) -> DataFrame:
    """source, file_id, text: each document's passages in order, joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return chunks.groupBy("source", "file_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def page_of(text: Column, offset: int, max_chars: int) -> dict[str, Column]:
    """Columns of one page of a text: text, offset, total_chars, next_offset (null on the last page)."""
    offset, size = max(0, offset), clamp("max_chars", max_chars)
    total = F.length(text)
    return {
        "text": F.substring(text, offset + 1, size),
        "offset": F.lit(offset).cast("long"),
        "total_chars": total.cast("long"),
        "next_offset": F.when(total > offset + size, F.lit(offset + size).cast("long")),
    }


def fetch_doc(chunks: DataFrame, source: str, file_id: int, offset: int = 0, max_chars: int = 40000) -> DataFrame:
    one = document_text(chunks.where((F.col("source") == source) & (F.col("file_id") == file_id)))
    return one.select("source", "file_id", *[c.alias(n) for n, c in page_of(F.col("text"), offset, max_chars).items()])
