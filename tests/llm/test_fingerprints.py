"""Samples against the exact generalised Jaccard similarity, and the neighbours in id order."""

import hashlib
import random
from collections import Counter

import numpy as np

from atalaya.llm import fingerprints, shingles


def counted(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def texts_in_pairs(n):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdeiorst") for _ in range(random.randrange(1, 9)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(random.randrange(5, 300))]
        words += words[:5] * random.randrange(30)
        cut = random.randrange(len(words))
        out += [" ".join(words), " ".join(words[:cut] + [word() for _ in words[cut:]])]
    return out


def test_shingles_are_counted_as_words_say():
    texts = ["", "a", "a b c d e f", "  x\ty\n z  ", "A B C D E F", "é à ü ö ß É", "\n", "q " * 700, *texts_in_pairs(20)]
    hashes, n = shingles.shingle_hashes(texts)
    assert n.tolist() == [sum(counted(t).values()) for t in texts]
    parts = np.split(hashes, np.cumsum(n)[:-1])
    assert parts[2].tolist() == parts[4].tolist()
    names, words = {}, {}
    for part, text in zip(parts, texts, strict=True):
        own = text.lower().split()
        for h, i in zip(part.tolist(), range(len(part)), strict=True):
            term = tuple(own[i : i + 5])
            assert names.setdefault(h, term) == term and words.setdefault(term, h) == h


def test_agreement_estimates_generalised_jaccard():
    texts = texts_in_pairs(150)
    rows = fingerprints.fingerprint_rows(texts, 256)
    error = [(a == b).mean() - jaccard(counted(s), counted(t)) for a, b, s, t in zip(rows[::2], rows[1::2], texts[::2], texts[1::2], strict=True)]
    assert abs(np.mean(error)) < 0.01 and np.std(error) < 0.04


def test_parts_keep_the_similarity():
    text, term, count, source = shingles.in_parts(np.array([0, 0, 1]), np.array([5, 9, 5], np.uint64), np.array([5, 1, 2]), 2)
    assert count.tolist() == [2, 2, 1, 1, 2] and text.tolist() == [0, 0, 0, 0, 1] and source.tolist() == [0, 0, 0, 1, 2]
    assert term[0] == term[4] and len(set(term[:4].tolist())) == 4


def test_pairs_in_id_order(spark):
    texts = texts_in_pairs(40)
    rows = [(3 * i - 50, t, "k") for i, t in enumerate(texts)] + [(1000, "", "k"), (1001, None, "k"), (5, "same id", "k"), (5, "same id too", "k"), (None, "no id", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _part string")
    found = fingerprints.fingerprint_pairs(docs).collect()
    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t, _ in rows), key=lambda x: (-x[0], x[1]))
    expected, prints = Counter(), {t: f for t, f in zip([t for _, t in order], fingerprints.fingerprint_rows([t for _, t in order]), strict=True)}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        edited = fingerprints.edited_text(text, following)
        other = fingerprints.fingerprint_rows([edited])[0]
        expected[(
            None if i == -(1 << 63) else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[text].tobytes().hex(), other.tobytes().hex(),
            float((prints[text] == other).mean()), float((prints[text] == prints[following]).mean()),
        )] += 1
    assert Counter(tuple(r) for r in found) == expected


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "alone in here now or")], "doc_id long, text string")
    row = fingerprints.fingerprint_pairs(one).first()
    assert row["near_next"] == 1.0 and row["n_chars"] == 20
    assert fingerprints.fingerprint_pairs(one.limit(0)).count() == 0


def test_likeness_of_columns(spark):
    texts = texts_in_pairs(3)
    df = spark.createDataFrame([(texts[0], texts[1]), (None, "")], "a string, b string")
    first, second = df.select(fingerprints.likeness(fingerprints.fingerprint(df.a), fingerprints.fingerprint(df.b)).alias("x")).collect()
    rows = fingerprints.fingerprint_rows(texts[:2])
    assert first["x"] == (rows[0] == rows[1]).mean() and second["x"] == 1.0
