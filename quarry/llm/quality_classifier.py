"""Quality classifier: ordinal cumulative-link regression on graded ratings of hashed text.

A document's features are hashed byte 4-grams (shares of the text), hashed buckets of a few shape figures and a bias.
One weight vector is shared by all grades; ordered thresholds t_1 < t_2 < ... turn its score into
P(grade >= k) = sigmoid(score - t_k).  Expected grade is the sum of these tail probabilities; selection uses one tail.
The fit reads a bounded sample of the rated rows; scoring is a map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.common import mark, prepare, release, stage

#: Hash buckets of the 4-grams; shape buckets come after them.
TEXT_DIMS = 1 << 13
SHAPES, SHAPE_STEPS = 7, 24
DIMS = TEXT_DIMS + SHAPES * SHAPE_STEPS + 1
#: At most so many rated rows are fitted, those with the smallest hashes of their ids ...
SAMPLE_ROWS = 5000
#: ... and of those no more than have so many bytes of features together, six for each nonzero.  This bounds the driver.
SAMPLE_BYTES = 32 << 20
#: Nonzeros that a round of the fit works on at a time.
CELLS = 1 << 18
#: Documents are kept whose probability of at least `KEEP_GRADE` is at least this.
KEEP_GRADE = 1
KEEP_PROBABILITY = 0.25

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def _step(x: np.ndarray, top: float) -> np.ndarray:
    return np.clip(x / top * (SHAPE_STEPS - 1), 0, SHAPE_STEPS - 1).astype(np.int64)


#: Bytes of a text from which it is read in pieces.
LONG = 4 << 20


def _grams(buf: np.ndarray, a: int, b: int) -> np.ndarray:
    """Buckets of the 4-grams that begin in ``buf[a:b]``."""
    loads = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))[a:b] & np.uint64(0xFFFFFFFF)
    return ((loads * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64)


@dataclass
class _Figures:
    """What the shape features of each text are made of."""

    words: np.ndarray
    distinct: np.ndarray
    repeats: np.ndarray  # words equal to the one before
    symbols: np.ndarray
    upper: np.ndarray
    letters: np.ndarray
    size: np.ndarray  # bytes


def _figures(words: W.Words) -> _Figures:
    n, offsets = len(words.counts), words.offsets
    body = words.buf[: int(offsets[-1])]
    h, doc = words.hashes(lower=True), words.doc
    order = np.lexsort((h, doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    symbols = W.per_text(~_LETTER[body] & ~W._SPACE[body], offsets)
    return _Figures(words.counts, np.bincount(doc[order][fresh], minlength=n), np.bincount(doc[same], minlength=n), symbols, W.per_text(_UPPER[body], offsets), W.per_text(_LETTER[body], offsets), np.diff(offsets))


def _long(buf: np.ndarray, size: int) -> tuple[np.ndarray, _Figures]:
    """(counts of the 4-gram buckets, figures) of one long text, read in pieces that end before a white space."""
    grams = np.zeros(TEXT_DIMS, np.int64)
    for a in range(0, size - 3, LONG):
        grams += np.bincount(_grams(buf, a, min(a + LONG, size - 3)), minlength=TEXT_DIMS)
    total, known, last, at = np.zeros(5, np.int64), np.zeros(0, np.uint64), None, 0
    while at < size:
        to = min(at + LONG, size)
        while to < size and not W._SPACE[buf[to]]:  # to the next white space, however far it is
            ahead = np.flatnonzero(W._SPACE[buf[to : min(to + LONG, size)]])
            to = to + int(ahead[0]) if len(ahead) else min(to + LONG, size)
        piece = np.concatenate([buf[at:to], np.zeros(16, np.uint8)])
        words = W.scan_bytes(piece, np.array([0, to - at]))
        f = _figures(words)
        h = words.hashes(lower=True)
        known = np.union1d(known, h)
        total += [f.words[0], f.repeats[0] + (len(h) > 0 and last is not None and h[0] == last), f.symbols[0], f.upper[0], f.letters[0]]
        last, at = (h[-1] if len(h) else last), to
    one = lambda x: np.array([x])
    return grams, _Figures(one(total[0]), one(len(known)), one(total[1]), one(total[2]), one(total[3]), one(total[4]), one(size))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, value) of the nonzero features of each text; null counts as empty.

    A text of `LONG` bytes or more, which `slices` hands over alone, is read in pieces; the features are the same.
    """
    buf, offsets = W.raw(column)
    size = np.diff(offsets)
    n, grams = len(size), np.maximum(size - 3, 0)
    if n == 1 and size[0] >= LONG:
        counts, f = _long(buf, int(size[0]))
        dim = np.flatnonzero(counts)
        row, count = np.zeros(len(dim), np.int64), counts[dim]
    else:
        text = np.repeat(np.arange(n), grams)  # 4-grams that lie inside one text
        at = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(offsets[:-1], grams)
        cell, count = np.unique(text * TEXT_DIMS + _grams(buf, 0, int(offsets[-1]))[at], return_counts=True)
        row, dim = cell // TEXT_DIMS, cell % TEXT_DIMS
        f = _figures(W.scan_bytes(buf, offsets))
    value = np.sqrt(count / np.maximum(grams[row], 1))
    many, long = np.maximum(f.words, 1), np.maximum(size, 1)
    # shape: length, distinct words, words equal to the one before, symbols, upper case, mean word, non-letters
    shapes = [
        _step(np.log1p(f.words), 12.0), _step(f.distinct / many, 1.0), _step(f.repeats / many, 0.5), _step(f.symbols / many, 4.0),
        _step(f.upper / np.maximum(f.letters, 1), 1.0), _step(np.where(f.words > 0, size / many, 0), 16.0), _step(f.letters / long, 1.0),
    ]
    each = np.arange(n)
    rows = [row, *[each] * (SHAPES + 1)]
    dims = [dim, *[TEXT_DIMS + k * SHAPE_STEPS + s for k, s in enumerate(shapes)], np.full(n, DIMS - 1)]
    values = [value, *[np.full(n, 0.3)] * SHAPES, np.ones(n)]
    return np.concatenate(rows), np.concatenate(dims), np.concatenate(values)


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; grades are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K, one row for each text."""
        row, dim, value = features(column)
        score = np.bincount(row, weights=self.weights[dim] * value, minlength=len(column))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(row: np.ndarray, dim: np.ndarray, value: np.ndarray, grade: np.ndarray, n_grades: int) -> OrdinalModel:
    """`fit_rows` on features in any order, as `features` gives them."""
    order = np.argsort(row, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(grade)))])
    return fit_rows(begin, dim[order], value[order], grade, n_grades)


def fit_rows(begin: np.ndarray, dim: np.ndarray, value: np.ndarray, grade: np.ndarray, n_grades: int, rounds: int = 150, decay: float = 1e-4, rate: float = 0.3) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model by full-batch Adam; thresholds stay ordered by construction
    (the first one, and the logarithms of the gaps).  With fewer than two grades in the sample the tails are flat.

    Row i has the nonzeros ``begin[i]`` to ``begin[i + 1]``, at least one.  They stay in the types they come in; a round
    passes over slices of about `CELLS` of them, so that a fit needs little memory besides the sample itself.
    """
    k = max(n_grades - 1, 1)
    if len(grade) == 0:
        return OrdinalModel(np.zeros(DIMS), np.full(k, -35.0))
    share = np.array([np.mean(grade >= j) for j in range(1, k + 1)])
    start = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    theta = np.concatenate([np.zeros(DIMS), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(grade)
    slices, at = [], 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + CELLS, side="right")) - 1)
        slices.append((at, min(to, n)))
        at = slices[-1][1]
    for t in range(1, rounds + 1):
        w, gaps = theta[:DIMS], np.exp(theta[DIMS + 1 :])
        cuts = np.concatenate([[-np.inf], theta[DIMS] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        g = np.zeros_like(theta)
        g_cut = np.zeros(k + 2)
        for a, b in slices:
            d, x, y = dim[begin[a] : begin[b]], value[begin[a] : begin[b]], grade[a:b]
            score = np.add.reduceat(w[d] * x, begin[a:b] - begin[a])
            high, low = cuts[y + 1] - score, cuts[y] - score  # P(grade) = S(high) - S(low)
            s_high, s_low = np.where(np.isinf(high), 1.0, _sigmoid(high)), np.where(np.isinf(low), 0.0, _sigmoid(low))
            p = np.maximum(s_high - s_low, 1e-9)
            d_high, d_low = s_high * (1 - s_high) / p / n, s_low * (1 - s_low) / p / n
            g_score = d_high - d_low  # d(-log p)/d(score)
            g[:DIMS] += np.bincount(d, weights=np.repeat(g_score, np.diff(begin[a : b + 1])) * x, minlength=DIMS)
            g_cut += np.bincount(y + 1, weights=-d_high, minlength=k + 2) + np.bincount(y, weights=d_low, minlength=k + 2)
        g[:DIMS] += decay * w
        g[DIMS] = g_cut[1 : k + 1].sum()
        for j in range(1, k):
            g[DIMS + j] = g_cut[1 + j : k + 1].sum() * gaps[j - 1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return OrdinalModel(theta[:DIMS], theta[DIMS] + np.concatenate([[0.0], np.cumsum(np.exp(theta[DIMS + 1 :]))]))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, grade, cells) of rated texts; cells are the dimensions (2 bytes each), then the values (4 bytes each)."""
    for batch in batches:
        for part in W.slices(batch, "_text", 1 << 20):
            row, dim, value = features(part.column(2))
            order = np.argsort(row, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).tolist()
            dim, value = dim[order].astype("<u2"), value[order].astype("<f4")
            cells = [dim[a:b].tobytes() + value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.binary())], names=["id", "grade", "cells"])


def train(docs: DataFrame, ratings: DataFrame, rating_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> OrdinalModel:
    """Fit on at most ``sample_rows`` rated documents (smallest id hashes first, so reruns agree) whose features have
    at most ``sample_bytes`` bytes together; what comes to the driver is cut to that before it comes.

    Null ratings and ratings without a document are ignored; of several ratings of one id the largest counts, of
    several documents of one id the one with the smallest features; null texts count as empty.  Without a rated document
    every text is as likely as any other to be of the upper grades.
    """
    spark, begin = prepare(docs.sparkSession), mark()
    rated = ratings.where(F.col(rating_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(rating_col).cast("long").alias("_grade"))
    grades = int((ratings.agg(F.max(rating_col)).first()[0] or 0) + 1)
    sample = F.broadcast(rated.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(sample, "_id").select("_id", "_grade", "_text")
    each = found.mapInArrow(_cells, "id long, grade long, cells binary").groupBy("id").agg(F.first("grade").alias("grade"), F.min("cells").alias("cells"))
    staged = stage(each.withColumn("place", F.xxhash64("id")), "rated")
    sizes = sorted((r["place"], r["id"], r["n"]) for r in staged.select("place", "id", F.octet_length("cells").alias("n")).collect())  # at most sample_rows
    total = np.cumsum([n for _, _, n in sizes]) if sizes else np.zeros(0)
    kept = int(np.searchsorted(total, sample_bytes, side="right"))
    number = {doc: i for i, (_, doc, _) in enumerate(sizes[:kept])}
    count = np.array([n // 6 for _, _, n in sizes[:kept]], np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    dim, value, grade = np.zeros(int(at[-1]), np.uint16), np.zeros(int(at[-1]), np.float32), np.zeros(kept, np.int64)
    last = sizes[kept - 1][:2] if kept else (0, 0)
    chosen = staged.where((F.col("place") < last[0]) | ((F.col("place") == last[0]) & (F.col("id") <= last[1])))
    for r in chosen.select("id", "grade", "cells").toLocalIterator() if kept else ():
        i = number[r["id"]]
        n = int(count[i])
        dim[at[i] : at[i + 1]] = np.frombuffer(r["cells"], "<u2", n)
        value[at[i] : at[i + 1]] = np.frombuffer(r["cells"], "<f4", n, 2 * n)
        grade[i] = r["grade"]
    release(spark, begin)
    return fit_rows(at, dim, value, grade, grades)


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """``docs`` plus expected_grade, tail_probability (of at least ``keep_grade``) and kept.

    Whole texts are read; null counts as empty and is scored like any other text.  A map without a shuffle: repeated
    rows score the same, ties at the limit are kept, an empty table gives an empty table.  Extra columns pass
    through; columns called like an output are replaced.
    """
    prepare(docs.sparkSession)
    made = ("expected_grade", "tail_probability", "kept")
    others = [c for c in docs.columns if c not in made]
    schema = docs.select(*others).schema.add("expected_grade", "double").add("tail_probability", "double").add("kept", "boolean")
    at = others.index(text_col)  # the model, some 70 KB, goes out with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, text_col, 1 << 20):
                tails = model.tails(part.column(at))
                tail = tails[:, min(keep_grade, tails.shape[1]) - 1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= keep_probability)], names=schema.names)

    return docs.select(*others).mapInArrow(run, schema)


def op7_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", "expected_grade", "tail_probability", "kept")
