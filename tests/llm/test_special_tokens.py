"""Texts with an added token's string have the ids of the plain library call."""

from __future__ import annotations

import public_tokenizers as P
from tokenizers import Tokenizer

from quarry.llm import token_files


def test_added_token_strings_become_their_ids(spark):
    texts = ["plain words here", "a <|endoftext|> b", "word<|endoftext|>", "<|endoftext|><|endoftext|>\n x", "", "half <|endof", "again plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(token_files.read_tokens(token_files.write_tokens(docs, P.path("byte_bpe_50k.json"), shards=1), keep_ids=True).collect(), key=lambda r: r["start"])
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert [r["ids"] for r in rows] == [[*whole.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert 50256 in rows[1]["ids"] and [r["doc_id"] for r in rows] == list(range(len(texts)))
