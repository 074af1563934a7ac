"""Removed bytes against a plain search over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from atalaya.llm import suffixes


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


def repeating_texts(seed, length):
    random.seed(seed)
    letters = "abcdé ñ日"
    text = lambda n: "".join(random.choice(letters) for _ in range(n))
    passages = [text(random.choice([length - 3, length, length + 1, 2 * length, 5 * length])) for _ in range(6)]
    out = []
    for _ in range(60):
        parts = [text(random.randrange(2 * length))]
        for _ in range(random.randrange(3)):
            whole = random.choice(passages)
            cut = random.randrange(len(whole) // 2)
            parts += [whole[cut:] if random.random() < 0.5 else whole, text(random.randrange(length))]
        out.append("".join(parts))
    out += out[:4] + ["", None, "x" * (3 * length), "xy" * length, "x" * length, "short", text(length - 1), passages[0], passages[0]]
    return out


@pytest.mark.parametrize(("seed", "length", "gram"), [(8, 200, 72), (9, 40, 15), (10, 7, 2)])
def test_spans_equal_plain_search(spark, seed, length, gram, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 5000)
    texts = repeating_texts(seed, length)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ref string, kept int").repartition(5)
    found = {r["doc_id"]: r for r in suffixes.span_report(docs, length=length, gram=gram).collect()}
    assert len(found) == len(texts)
    for i, (size, removed, spans, kept) in enumerate(plain(texts, length)):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("chunk", [300, 8_000_000])
def test_what_a_task_decides_alone_changes_nothing(spark, chunk, monkeypatch):
    texts = repeating_texts(11, 40)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", chunk)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["n_removed"] for r in suffixes.span_report(docs, length=40, gram=15).collect()}
    assert found == {i: row[1] for i, row in enumerate(plain(texts, 40))}


def test_rows_that_repeat_and_other_columns(spark):
    long_ = "".join(chr(97 + i * i % 23) for i in range(300)) + "é" * 5
    rows = [(1, long_, "a"), (1, long_, "a"), (None, long_[:150] + "é", None), (2, None, "b"), (3, "z" * 100 + long_[:250], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __kept string")
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns
    assert Counter((r[0], r[1]) for r in left.collect()) == Counter({(1, ""): 2, (None, long_[:150] + "é"): 1, (2, None): 1, (3, "z" * 100): 1})
    none = docs.limit(0)
    assert suffixes.span_report(none).count() == 0 and suffixes.without_repeats(none).count() == 0


@pytest.mark.parametrize("place_bits", [9, 12])
def test_anchors_in_texts_beyond_the_packed_places(place_bits, monkeypatch):
    random.seed(5)
    data = "".join(random.choice("abcdefgh") for _ in range(20_000)).encode()
    passage, length, gram = data[7_000:8_000], 200, 72
    texts = [data + passage + data[:300], b"short", passage]
    expected = suffixes.Chunk(texts).runs(length, gram)
    monkeypatch.setattr(suffixes, "_PLACE_BITS", place_bits)
    document, start, span, anchor = suffixes.Chunk(texts).runs(length, gram)
    assert ((anchor >= start) & (anchor + gram <= start + span + length)).all()
    # All three copies of the passage have the same anchors, and as with room for every place.
    inside = lambda at: set((anchor[(anchor >= at) & (anchor < at + 900)] - at).tolist())
    own = len(texts[0]) + len(texts[1])
    assert inside(own) <= inside(7_000) & inside(20_000) and len(inside(own)) > 5
    if place_bits == 12:
        assert all((a == b).all() for a, b in zip((document, start, span, anchor), expected, strict=True))

