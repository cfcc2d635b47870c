"""The training-data operators on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import bpe, exact_dedup, html_extract, minmax_dedup, mixing, quality_classifier, quality_rules, substring_dedup, token_files, toxicity
from quarry.llm import words as W

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "e", "zeta.", "漢字", "n'importe", "12", "#x"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = sentence(70)
    texts = [None, "", "   \n\t ", "one", "one", "two words", sentence(300), sentence(4000), shared, f"{sentence(30)} {shared} {sentence(5)}", f"{shared}\n{sentence(40)}", shared]
    texts += [shared.upper(), "a" * 3000, "line\nline\n line\nline", "x y z x y z " * 30, "\x0b\x0c \x1c\x85 b", "tail  \n\n  end ", "don't we'll x"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", 1, "k", "z") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[8], (None, shared, "en", "s1", 1, "k", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [
        mixing.op1_entropy_mix(empty), token_files.op2_bitplane_tokens(empty, P.path("byte_bpe_50k.json")), minmax_dedup.op3_minmax_neardup(empty),
        bpe.op4_byte_bpe(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), toxicity.op5_toxicity(empty, labels), quality_rules.op6_quality_rules(empty),
        quality_classifier.op7_quality_classifier(empty, labels), exact_dedup.op8_exact_dedup(empty), substring_dedup.op9_substring_dedup(empty), html_extract.op10_html_extract(pages),
    ]
    assert [r.count() for r in results] == [0] * 10


def test_mixing(docs):
    rows = mixing.op1_entropy_mix(docs).collect()
    again = mixing.op1_entropy_mix(docs.repartition(3)).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr) and len(rows) == docs.count()
    total, size = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        total[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    target = {r["source"]: r["target"] for r in rows}
    assert {r["source"]: r["source_size"] for r in rows} == dict(size)
    # targets by repeated resharing
    names = sorted([s for s in size if s is not None]) + [None]
    weight, capped = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        want = {s: 3.0 * size[s] if s in capped else weight[s] * left / share for s in names}
        over = {s for s in names if s not in capped and want[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    assert all(abs(want[s] - target[s]) < 1e-6 for s in names)


@pytest.mark.parametrize("bits", [False, True])
def test_token_file_round_trip(docs, bits):
    manifest = token_files.write_tokens(docs.select("doc_id", "text"), P.path("byte_bpe_50k.json"), bits=bits, shards=3)
    rows = sorted(token_files.read_tokens(manifest, keep_ids=True).collect(), key=lambda r: r["start"])
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    order = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for row, (doc, text, *_) in zip(rows, order, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (doc, at, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_bpe_equals_tiktoken(docs):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.op4_byte_bpe(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = Counter()
    for doc, text, *_ in odd_rows():
        raw = np.array(whole.encode_ordinary(text or ""), "<u4").tobytes()
        want[doc, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want


def test_bpe_random_unicode():
    coder = bpe.loaded(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.rank, special_tokens={})
    rng = random.Random(5)
    pool = "ab ,.\n\t'sdé×÷ß¿  あ\U0001f600\x1c\x85 12"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)] + ["z" * 2500]
    for text, ids in zip(texts, coder.encode_texts(texts), strict=True):
        assert ids.tolist() == whole.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def brute_components(rows, width):
    table = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").encode().translate(table).split()
        sets[doc] = frozenset([tuple(w)] if 0 < len(w) < width else zip(*(w[i:] for i in range(width)), strict=False))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d) if d is not None else None) for d, s in sets.items()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    for table, rows in ((docs, odd_rows()), (spark.read.parquet(f"{SF}/documents.parquet"), None)):
        rows = rows or [tuple(r) for r in table.select("doc_id", "text").collect()]
        want = brute_components(rows, width)
        got = minmax_dedup.near_components(table, width).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_near_duplicate_family(spark):
    """A family of copies around a centre, hundreds of members, more than one block."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(420):
        w = list(base)
        for _ in range(rng.choice([2, 5, 9, 14])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 2)
    got = minmax_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_exact_dedup(docs):
    got = exact_dedup.op8_exact_dedup(docs).collect()
    groups = defaultdict(list)
    for doc, text, *_ in odd_rows():
        groups[text or ""].append(doc)
    want = Counter()
    for text, ids in groups.items():
        keep = max(d for d in ids if d is not None)
        want.update((d, keep, len(ids), d == keep, hashlib.sha256(text.encode()).hexdigest()) for d in ids)
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.drop_copies(docs).columns == docs.columns and exact_dedup.drop_copies(docs).count() == len(groups)


def test_directory_doubles_and_splits():
    depth, slots = exact_dedup.directory({0: 10, 1: 10, 2: 1, 7: 100}, 3, 15)
    assert depth == 3 and slots == [0, 1, 2, 2, 4, 4, 6, 7]
    assert exact_dedup.directory({}, 3, 15) == (0, [0])
    chained = list(exact_dedup._chain(iter([pa.RecordBatch.from_pydict({"key": [5, 5, 5], "text": [b"a", b"b", b"a"], "copies": [1, 1, 2], "last_id": [3, 9, None], "entry": [70, 71, 72]})])))
    rows = [r for b in chained for r in b.to_pylist() if r["kind"] == "page"]
    assert {(r["entry"], r["chain"]) for b in chained for r in b.to_pylist() if r["kind"] == "answer"} == {(70, 0), (72, 0), (71, 1)}
    assert [(r["chain"], r["text"], r["group_size"], r["keep_id"]) for r in rows] == [(0, b"a", 3, 3), (1, b"b", 1, 9)]


def brute_repeats(rows, window):
    first = {}
    for doc, text, *_ in rows:
        w = split(text)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = Counter()
    for doc, text, *_ in rows:
        w, gone = split(text), [False] * len(split(text))
        for p in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[p : p + window])] < doc:
                gone[p : p + window] = [True] * window
        out[doc, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("window", "group"), [(50, 8 << 20), (50, 4000), (7, 4000), (2, 8 << 20)])
def test_substring_dedup(docs, monkeypatch, window, group):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, window).collect()) == brute_repeats(odd_rows(), window)


def test_quality_rules(docs):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect() if r["doc_id"] is not None}
    for doc, text, *_ in odd_rows():
        if doc is None:
            continue
        w = split(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if split(x)]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked))
        assert tuple(rows[doc][m] for m in quality_rules.METRICS) == want
        assert rows[doc]["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert rows[doc]["kept"] == (not rows[doc]["base_failed"] and not rows[doc]["host_rejected"])


def test_quality_classifier(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels))
    rows = scored.join(labels, "doc_id").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.9 * len(rows) and scored.count() == docs.count()


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 90)
    texts = [("BAD!! ", "so so ", "good ")[g] * 20 for g in grades]
    model = quality_classifier.fit(*quality_classifier.features(pa.array(texts)), grades, 3)
    tails = model.tails(pa.array([*texts[:30], None, ""]))
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails[:30] > 0.5).sum(axis=1) == grades[:30]).mean() > 0.9


def test_toxicity(spark):
    """Held-out accuracy on rated documents (measured: 0.968, from 329 toxic examples); every text has a score."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text").join(labels, "doc_id"), model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    toxic = [r for r in held if r["toxic"]]
    assert len(held) > 500 and sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert all(0 <= s <= 1 for s in model.scores(pa.array([None, "", "x", "long " * 5000])))


def test_toxicity_gradient():
    p = {k: v.astype(np.float64) for k, v in toxicity.init(3).items()}
    v, at = np.random.default_rng(0).normal(size=(9, toxicity.EMBED)), np.array([[0, 1, 2, 3], [4, 5, -1, -1], [6, 7, 8, -1]])
    loss = lambda: float((toxicity.forward(p, v, at)[0] * np.array([1.0, -2.0, 0.5])).sum())
    _, kept = toxicity.forward(p, v, at, keep=True)
    grads, _ = toxicity.backward(p, v, kept, np.array([1.0, -2.0, 0.5]))
    for name in ("uf", "ub", "xf", "att", "out"):
        x, i = p[name], tuple(n // 2 for n in p[name].shape)
        old = x[i]
        x[i] = old + 1e-2
        up = loss()
        x[i] = old - 1e-2
        down = loss()
        x[i] = old
        assert abs((up - down) / 2e-2 - grads[name][i]) < 2e-3 * max(1.0, abs(grads[name][i]))


def test_html_extraction():
    page = """<html><head><title>T</title><script>var x = "</p>";</script></head><body><nav><ul><li><a href=/a>Menu</a></ul></nav>
    <div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>First   part<br>more<p>Second &#233;</p><div class="comments"><p>reader</p></div></article>
    <aside>side</aside><form><p>sign up</p></form><footer>&copy; x</footer>"""
    assert html_extract.extract(page) == "Head & line\nFirst part more\nSecond é"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<nav>x</nav>") == ""
    assert html_extract.extract("<div><p>" + "Long text here. " * 20 + "</p></div><div><a href=x>link</a></div>") == ("Long text here. " * 20).strip()
    assert html_extract.extract("plain <") == "plain <"


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "x"), (2, "v", None, "y")], "page_id long, url string, html string, n_chars string")
    assert [tuple(r) for r in html_extract.op10_html_extract(pages).collect()] == [(1, "u", "a", 1), (2, "v", "", 0)]


def test_word_scan_and_hashes():
    rows = [r[1] for r in odd_rows()]
    w = W.scan(pa.array(rows, pa.string()))
    found = [w.buf[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    assert found == [x for t in rows for x in split(t)] and w.counts.tolist() == [len(split(t)) for t in rows]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(found))
    assert W.sequence_hashes(h, 3)[5] == W.sequence_hashes(h[5:8].copy(), 3)[0]
