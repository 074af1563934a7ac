"""Counts under a unigram vocabulary against the library's tokens."""

import random

import public_tokenizers
from tokenizers import Tokenizer, models

from atalaya.llm import unigram

FILE = public_tokenizers.path("piece_bpe_32k.model")


def library_counts(vocabulary, texts):
    made = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(p, float(s)) for p, s in vocabulary], unk_id=0, byte_fallback=False))
    out = []
    for text in texts:
        marked = unigram.MARK + text.replace(" ", unigram.MARK) if text else ""
        found = made.encode(marked)
        out.append(sum(len(marked[a:b].encode()) if i == 0 else 1 for i, (a, b) in zip(found.ids, found.offsets, strict=True)))
    return out


def odd_texts():
    random.seed(4)
    texts = ["", "a", "  ", " a  b   ", "   ", "a ", "\n", "🙂🙂 x", "aaaaaaaaaaaaaaaaaaaaa", "▁ ▁▁x"]
    return texts + ["".join(random.choice("abcde  tion\né") for _ in range(random.randrange(60))) for _ in range(300)]


def test_counts_equal_the_library():
    vocabulary = unigram.zipf_vocabulary(FILE)
    tool = unigram.UnigramCounter(vocabulary)
    assert tool.by_word
    texts = odd_texts()
    assert tool.count(texts)[1].tolist() == library_counts(vocabulary, texts)


def test_ties_and_words_that_cannot_be_cut():
    # Equal scores of different length: the piece that starts first wins; a piece across words forbids cuts.
    vocabulary = [("a", -1), ("b", -1), ("c", -2), ("ab", -2), ("bc", -3), ("abc", -4), ("▁", -1), ("a▁b", -1), ("aa", -2)]
    tool = unigram.UnigramCounter(vocabulary)
    assert not tool.by_word
    random.seed(5)
    texts = ["".join(random.choice("abc ") for _ in range(n % 14)) for n in range(200)]
    assert tool.count(texts)[1].tolist() == library_counts(vocabulary, texts)


def test_documents(spark):
    rows = [(1, "one two", 5), (1, "one two", 5), (2, None, 5), (3, "", 5), (None, "x " * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    found = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(docs, FILE).collect()}
    assert unigram.token_counts(docs, FILE).count() == 5
    assert found[2] == found[3] == 0
    assert [found[1], found[None]] == library_counts(unigram.zipf_vocabulary(FILE), ["one two", "x " * 5000])
    assert unigram.token_counts(docs.limit(0), FILE).count() == 0
