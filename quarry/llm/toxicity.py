"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: the mean of its hashed character n-gram vectors (with word boundaries) plus its hashed word vector.
Two gated recurrent layers read a window forwards and backwards, attention pools their states, and a logistic
unit scores the window.  All windows of a text overlap by half; the text's score is its highest window score,
in training (where the highest window gets the gradient) and in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.common import mark, prepare, release, stage

WINDOW, STRIDE = 32, 16
CHAR_DIMS, WORD_DIMS = 1 << 13, 1 << 12
EMBED, HIDDEN = 12, 8
#: At most so many labelled rows are fitted, half of them toxic: the smallest id hashes of each class ...
SAMPLE_ROWS = 2400
#: ... and of each class no more than have so many bytes of text together.  This bounds the driver.
SAMPLE_BYTES = 8 << 20
#: Of a training text, windows are drawn anew in each epoch; texts of up to this many windows are used whole.
TRAIN_WINDOWS = 24
#: Windows that are worked on at a time.
STEP = 4096
THRESHOLD = 0.3

#: Character n-grams of a word, its boundary marks included: 3 to 5 bytes at the front, 3 anywhere.
_FRONT = (3, 4, 5)


def char_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram bucket) pairs: the first 3, 4 and 5 bytes of each word and every 3 bytes inside it."""
    length = ends - starts
    loads = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    words, ids = [], []
    for n in _FRONT:
        w = np.arange(len(starts))
        keep = W._KEEP[np.minimum(length, n)]
        value = (loads[starts] & keep) + np.uint64(n << 50) + np.uint64(1 << 60)
        words.append(w)
        ids.append(value)
    inner = np.maximum(length - 2, 0)
    w = np.repeat(np.arange(len(starts)), inner)
    at = np.repeat(starts - (np.cumsum(inner) - inner), inner) + np.arange(len(w))
    words.append(w)
    ids.append(loads[at] & W._KEEP[3])
    word, value = np.concatenate(words), np.concatenate(ids)
    return word, (W.mix64(value) >> np.uint64(64 - 13)).astype(np.int64)


class Lexicon:
    """Different words of a slice: their n-gram buckets in compressed rows and their word buckets."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        _, first, self.where = np.unique(hashes, return_index=True, return_inverse=True)
        word, ids = char_ids(buf, starts[first], ends[first])
        order = np.argsort(word, kind="stable")
        self.ids = ids[order]
        self.count = np.bincount(word, minlength=len(first))
        self.begin = np.cumsum(self.count) - self.count
        self.word = (hashes[first] >> np.uint64(64 - 12)).astype(np.int64)

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        if not len(self.word):
            return np.zeros((0, EMBED), np.float32)
        total = np.add.reduceat(p["char"][self.ids], self.begin, axis=0)
        return total / self.count[:, None].astype(np.float32) + p["word"][self.word]


def init(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {"char": rng.normal(0, 0.3, (CHAR_DIMS, EMBED)), "word": rng.normal(0, 0.05, (WORD_DIMS, EMBED))}
    for d in ("f", "b"):
        p[f"x{d}"] = rng.normal(0, 0.4, (EMBED, 3 * HIDDEN))
        p[f"u{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p[f"c{d}"] = np.zeros(3 * HIDDEN)
    p |= {"att": rng.normal(0, 0.3, 2 * HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.array([-1.0])}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(x: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over projected inputs x (T, B, 3H); padding leaves the state as it is."""
    steps, rows, _ = x.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    out = np.empty((steps, rows, HIDDEN), np.float32)
    saved = []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        a = x[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN]
        g = _sigmoid(a)
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        rh = r * h
        n = np.tanh(x[t, :, 2 * HIDDEN :] + rh @ u[:, 2 * HIDDEN :])
        new = h + mask[t][:, None] * (z * (n - h))
        if keep:
            saved.append((t, h, z, r, rh, n))
        h = out[t] = new
    return out, saved


def forward(p: dict[str, np.ndarray], v: np.ndarray, at: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
    """Window logits; ``v`` are word vectors, ``at`` (B, T) the words of each window, negative for padding."""
    mask = (at >= 0).T.astype(np.float32)
    where = np.where(at >= 0, at, 0).T
    states, saves = [], []
    for d in ("f", "b"):
        x = (v @ p[f"x{d}"] + p[f"c{d}"])[where]
        h, saved = _run(x, p[f"u{d}"], mask, d == "b", keep)
        states.append(h)
        saves.append(saved)
    both = np.concatenate(states, axis=2)
    e = both @ p["att"] + (mask - 1) * 1e9
    e = np.exp(e - e.max(axis=0))
    alpha = e * mask / np.maximum((e * mask).sum(axis=0), 1e-20)
    pooled = (alpha[:, :, None] * both).sum(axis=0)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (both, alpha, pooled, mask, where, saves) if keep else None


def backward(p: dict[str, np.ndarray], v: np.ndarray, kept: tuple, g: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters and of the word vectors for the logits' gradient ``g``."""
    both, alpha, pooled, mask, where, saves = kept
    d = {"out": pooled.T @ g, "bias": np.array([g.sum()], np.float32)}
    d_pooled = g[:, None] * p["out"]
    d_both = alpha[:, :, None] * d_pooled
    d_alpha = (both * d_pooled).sum(axis=2)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    d["att"] = np.einsum("tb,tbh->h", d_e, both)
    d_both += d_e[:, :, None] * p["att"]
    d_v = np.zeros_like(v)
    for k, name in enumerate(("f", "b")):
        u, h_in = p[f"u{name}"], d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        d_u = np.zeros_like(u)
        d_x = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
        carry = np.zeros_like(h_in[0])
        for t, h, z, r, rh, n in reversed(saves[k]):
            dh = carry + h_in[t]
            m = mask[t][:, None]
            dz, dn = dh * m * (n - h), dh * m * z
            da_n = dn * (1 - n * n)
            d_rh = da_n @ u[:, 2 * HIDDEN :].T
            da = np.concatenate([dz * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            d_u[:, 2 * HIDDEN :] += rh.T @ da_n
            d_u[:, : 2 * HIDDEN] += h.T @ da
            d_x[t, :, : 2 * HIDDEN], d_x[t, :, 2 * HIDDEN :] = da, da_n
            carry = dh * (1 - m * z) + d_rh * r + da @ u[:, : 2 * HIDDEN].T
        flat = d_x.reshape(-1, 3 * HIDDEN)
        words = where.ravel()
        by_word = np.zeros((len(v), 3 * HIDDEN), np.float32)
        order = np.argsort(words, kind="stable")
        some, first = np.unique(words[order], return_index=True)
        by_word[some] = np.add.reduceat(flat[order], first, axis=0)
        d[f"u{name}"], d[f"x{name}"], d[f"c{name}"] = d_u, v.T @ by_word, flat.sum(axis=0)
        d_v += by_word @ p[f"x{name}"].T
    return d, d_v


def _windows_of(counts: np.ndarray) -> np.ndarray:
    """Windows of each text: one at least, the last may be short."""
    return np.maximum(-(-np.maximum(counts - WINDOW, 0) // STRIDE), 0) + 1


def _places(counts: np.ndarray, first: np.ndarray, text: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Word positions (windows, WINDOW) of each text's k-th window, -1 beyond its end."""
    at = (k * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(at < counts[text][:, None], first[text][:, None] + at, -1)


def window_words(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word positions (windows, WINDOW), text of each window) of all windows."""
    per = _windows_of(counts)
    text = np.repeat(np.arange(len(counts)), per)
    return _places(counts, first, text, np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)), text


class Model:
    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def scores(self, column: pa.Array) -> np.ndarray:
        """Score of each whole text: the highest probability of its overlapping windows.

        Windows are made and scored `STEP` times 8 at a time, so that what a very long text needs besides its words' places
        doesn't grow with it.
        """
        w = W.scan(column)
        buf, first = W._LOWER[w.buf], w.first[:-1]
        per = _windows_of(w.counts)
        ends = np.cumsum(per)
        best = np.full(len(w.counts), -np.inf, np.float32)
        total = int(ends[-1]) if len(ends) else 0
        for lo in range(0, total, 8 * STEP):
            number = np.arange(lo, min(lo + 8 * STEP, total))
            text = np.searchsorted(ends, number, side="right")
            at = _places(w.counts, first, text, number - (ends - per)[text])
            some = at[at >= 0]
            base, top = (int(some.min()), int(some.max()) + 1) if len(some) else (0, 0)
            starts, stops = w.starts[base:top], w.ends[base:top]
            lexicon = Lexicon(buf, starts, stops, W.hash_spans(buf, starts, stops))
            v = lexicon.vectors(self.p)
            v = v if len(v) else np.zeros((1, EMBED), np.float32)
            where = lexicon.where if len(lexicon.where) else np.zeros(1, np.int64)
            for i in range(0, len(text), STEP):
                part = at[i : i + STEP]
                logit, _ = forward(self.p, v, np.where(part >= 0, where[np.maximum(part - base, 0)], -1))
                np.maximum.at(best, text[i : i + STEP], logit)
        return _sigmoid(best.astype(np.float64))


def train(texts: list[str], labels: np.ndarray, epochs: int = 14, steps: int = 500, seed: int = 7, rate: float = 0.01) -> Model:
    """Fit on texts with 0/1 labels by Adam, for ``epochs`` and at least ``steps`` batches; in each batch a text's highest-scoring window stands for it."""
    p = init(seed)
    if len(texts) == 0:
        return Model(p)
    rng = np.random.default_rng(seed)
    w = W.scan(pa.array(texts, pa.large_string()))
    buf = W._LOWER[w.buf]
    lexicon = Lexicon(buf, w.starts, w.ends, W.hash_spans(buf, w.starts, w.ends))
    at, text = window_words(w.counts, w.first[:-1])
    where = lexicon.where if len(lexicon.where) else np.zeros(1, np.int64)
    at = np.where(at >= 0, where[np.maximum(at, 0)], -1)
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    m = {k: np.zeros_like(x) for k, x in p.items()}
    s = {k: np.zeros_like(x) for k, x in p.items()}
    t, batch = 0, 64
    epochs = max(epochs, -(-steps * batch // len(texts)))  # few texts are read more often
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            picked = [np.arange(begin[r], begin[r + 1]) for r in rows]
            picked = [x if len(x) <= TRAIN_WINDOWS else rng.choice(x, TRAIN_WINDOWS, replace=False) for x in picked]
            which, owner = np.concatenate(picked), np.repeat(np.arange(len(rows)), [len(x) for x in picked])
            local, back = np.unique(at[which], return_inverse=True)
            back = back.reshape(at[which].shape)
            pad = local[0] < 0
            used = local[1:] if pad else local
            here = back - 1 if pad else back
            sub = _subset(lexicon, used if len(used) else np.zeros(1, np.int64))
            v = sub.vectors(p)
            logit = np.concatenate([forward(p, v, here[j : j + STEP])[0] for j in range(0, len(here), STEP)])
            best = np.full(len(rows), -np.inf)
            np.maximum.at(best, owner, logit)
            lead = np.flatnonzero(logit == best[owner])
            lead = lead[np.unique(owner[lead], return_index=True)[1]]  # the first of equals
            y = labels[rows].astype(np.float32)
            logit, kept = forward(p, v, here[lead], keep=True)
            g = ((_sigmoid(logit) - y) / len(rows)).astype(np.float32)
            d, d_v = backward(p, v, kept, g)
            d["char"], d["word"] = np.zeros_like(p["char"]), np.zeros_like(p["word"])
            np.add.at(d["word"], sub.word, d_v)
            spread = np.repeat(d_v / sub.count[:, None], sub.count, axis=0)
            np.add.at(d["char"], sub.ids, spread)
            t += 1
            lr = rate * min(1.0, 2.0 * (1 - epoch / epochs))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * d[k]
                s[k] = 0.99 * s[k] + 0.01 * d[k] ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return Model(p)


def _subset(lexicon: Lexicon, words: np.ndarray) -> Lexicon:
    out = object.__new__(Lexicon)
    out.count = lexicon.count[words]
    ends = np.cumsum(out.count)
    out.begin = ends - out.count
    out.ids = lexicon.ids[np.repeat(lexicon.begin[words] - out.begin, out.count) + np.arange(int(ends[-1]))]
    out.word = lexicon.word[words]
    return out


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample_rows`` labelled rows that aren't held out, half of each class, smallest id hashes first.

    Of each class at most ``sample_bytes`` bytes of whole texts come to the driver (the first texts that fit together, in
    that order).  Null labels are ignored; of several labels of one id the largest counts, of several texts of one id
    the smallest; null texts count as empty.  Without a labelled row the scores are those of an untrained network.
    """
    spark, since = prepare(docs.sparkSession), mark()
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    half = sample_rows // 2
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = marked.where("_label = 1").orderBy(*order).limit(half).unionAll(marked.where("_label = 0").orderBy(*order).limit(half))
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id")
    staged = stage(found.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).withColumn("_place", F.xxhash64("_id")), "toxic-sample")
    sizes = sorted((r["_label"], r["_place"], r["_id"], r["n"]) for r in staged.select("_label", "_place", "_id", F.octet_length("_text").alias("n")).collect())  # at most sample_rows
    wanted, held = [], {0: 0, 1: 0}
    for label, _, doc, n in sizes:
        held[label] += n
        if held[label] <= sample_bytes:
            wanted.append(doc)
    rows = sorted((r["_id"], r["_text"], r["_label"]) for r in staged.where(F.col("_id").isin(wanted)).toLocalIterator()) if wanted else []
    release(spark, since)
    return train([r[1] for r in rows], np.array([r[2] for r in rows]))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, plus score (0 to 1) and predicted.

    Null counts as the empty text, which is scored as one empty window; all windows of whole texts are read.  A map
    without a shuffle: repeated rows score the same, a score equal to the threshold is predicted 1, an empty table
    gives an empty table.  Extra columns pass through; those called like an output are replaced.
    """
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    schema = docs.select(*others).schema.add("score", "double").add("predicted", "integer")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, batch.schema.names[-1]):
                s = model.scores(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*others, F.col(text_col)).mapInArrow(run, schema)


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "text")
    return score(rows, model)
