"""Near-duplicate classes against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from atalaya.llm import minhash, shingles


def near_texts():
    """(id, text): groups of near copies of several sizes, exact copies, shared lines, odd ones."""
    random.seed(7)
    word = lambda: "".join(random.choice("abcdeiorstlmnu") for _ in range(random.randrange(2, 9)))
    line = " ".join(word() for _ in range(30))
    out = []
    for size in [1] * 40 + [2] * 12 + [5, 9, 60]:
        base = [word() for _ in range(random.randrange(40, 250))]
        for _ in range(size):
            words = list(base)
            for _ in range(random.randrange(3)):
                words[random.randrange(len(words))] = word()
            out.append(" ".join(words))
    out += [line + " " + " ".join(word() for _ in range(60)) for _ in range(40)]
    out += [(line + "\n") * 9 + " ".join(word() for _ in range(200)) for _ in range(10)]
    out += out[:3] * 4 + ["", "", None, " \n", "one", "one", "two words", "x " * 4000]
    random.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return near_texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", i % 3) for i, t in rows], "doc_id long, text string, band string, rep int")


def exact_classes(rows):
    """Components of weighted Jaccard >= 0.8 with exact document frequencies."""
    terms = []
    for _, text in rows:
        words = (text or "").lower().split()
        terms.append(Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter())
    n, df = len(rows), Counter(t for own in terms for t in own)
    weight = {t: 1 + min(1, np.log(n / k) / np.log(minhash.RARE)) for t, k in df.items()}
    weighted = [{t: (1 + np.log(k)) * weight[t] for t, k in own.items()} for own in terms]
    sums = [sum(w.values()) for w in weighted]
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            shared = sum(min(weighted[i][t], weighted[j][t]) for t in weighted[i].keys() & weighted[j].keys())
            union = sums[i] + sums[j] - shared
            alike = shared / union if union else 1.0
            if alike >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {rows[i][0]: rows[label[i]][0] for i in range(n)}


def test_classes_equal_brute_force(docs, rows):
    found = minhash.near_classes(docs).select("doc_id", "class_id", "kept").collect()
    expected = exact_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in found} == expected and len(found) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)


def test_one_row_of_each_class_stays(spark, docs, rows):
    twice = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, "no id at all in here", None, None)], docs.schema))
    kept = minhash.without_near_copies(twice)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(exact_classes(rows).values()))
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(docs):
    none = docs.limit(0)
    assert minhash.near_classes(none).count() == 0 and minhash.without_near_copies(none).count() == 0


def test_sketch_is_never_too_low_and_hardly_too_high(spark, docs, rows):
    own = docs.selectExpr("coalesce(text, '') as text")
    sketch = minhash.frequency_sketch(own)
    hashes, n = shingles.shingle_hashes([t or "" for _, t in rows])
    _, term, _ = shingles.weighted_terms(hashes, n)
    names, exact = np.unique(term, return_counts=True)
    rows_of_sketch = np.stack([sketch[d][minhash._cells(names, d)] for d in range(minhash.DEPTH)])
    assert (rows_of_sketch.min(axis=0) >= exact).all() and (rows_of_sketch.min(axis=0) - exact).max() <= 2


def shared_line_texts():
    """Short texts in pairs that share a line repeated 9 to 50 times and little else; similarity 0.80 to 0.95."""
    random.seed(31)
    word = lambda: "".join(random.choice("abcdeiorstlmnu") for _ in range(random.randrange(4, 9)))
    out = []
    for times in range(9, 51):
        line = " ".join(word() for _ in range(random.randrange(8, 40)))
        least = len(line.split()) * (1 + np.log(times))
        tail = int(least * random.uniform(0.05, 0.11))
        out += [(line + " ") * times + " ".join(word() for _ in range(tail)) for _ in range(2)]
    out += [" ".join(word() for _ in range(60)) for _ in range(60)]
    random.shuffle(out)
    return list(enumerate(out))


def test_repeated_lines_in_short_texts_equal_brute_force(spark):
    rows = shared_line_texts()
    expected = exact_classes(rows)
    assert len(set(expected.values())) < len(rows) - 35  # most pairs are alike
    found = minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == expected


@pytest.mark.parametrize("terms", [1, 3, 30, 300, 6000])
def test_samples_agree_as_often_as_weights_do(terms):
    rng = np.random.default_rng(terms)
    names = rng.integers(0, 1 << 48, terms).astype(np.uint64)
    weights = [rng.choice([1.0, 2.0, 3.3, 9.8], terms), rng.choice([1.0, 2.0, 3.3, 9.8], terms)]
    expected = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    text = np.repeat(np.arange(2), terms)
    agree = []
    for seed in range(20):
        both = shingles.dart_samples(text, np.tile(names, 2), np.concatenate(weights), 2, 384, seed)
        assert (both != 0).all()
        agree.append((both[0] == both[1]).mean())
    assert abs(np.mean(agree) - expected) < 4 * np.sqrt(expected * (1 - expected) / (384 * 20)) + 1e-9
