"""Byte-level BPE against the tiktoken library, and the way back."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from atalaya.llm import bpe

RULE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=RULE[1], mergeable_ranks=bpe.codec(*RULE).ranks, special_tokens={})


def odd_texts():
    random.seed(3)
    texts = ["", " ", "a" * 1500, "ab" * 400 + " x", "日本語 テキスト" * 20, "\U0001f600" * 200, " \n\t  x", "<|endoftext|>", "don't we'll"]
    ranges = [(1, 127), (160, 0x2FFF), (0x1F300, 0x1F600)]
    return texts + ["".join(chr(random.randrange(*random.choice(ranges))) for _ in range(random.randrange(300))) for _ in range(150)]


def test_pieces_equal_the_library(library):
    own = bpe.RankCodec(*RULE)
    texts = odd_texts()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_documents(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(odd_texts()[:40])] + [(90, None, 1), (91, "again", 1), (91, "again", 1), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = bpe.decode_documents(bpe.encode_documents(docs, *RULE), *RULE).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    expected = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows), key=key)
    got = sorted(((r["doc_id"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), bytes(r["decoded"])) for r in found), key=key)
    assert got == expected
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in found)
    assert bpe.encode_documents(docs.limit(0), *RULE).count() == 0
