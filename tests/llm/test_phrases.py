"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from atalaya.llm import phrases

SCHEMA = "doc_id long, text string, lang string, score int, a string, id string"


def plain(rows, least, top):
    counts, words = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(found[i:i + k]) for i in range(len(found) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rated = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in candidates.items())
            if not inside:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, p, left, right) in enumerate(sorted(rated)[:top]):
            out.add((lang, i + 1, p.decode(), -a, left, right, words[lang], -score))
    return out


def made_up(seed):
    random.seed(seed)
    words = ["a", "B", "b", "çé", "İ", "new", "york", "city", "x-1"]
    weights = [9, 2, 5, 3, 1, 4, 4, 3, 1]

    def text():
        return "".join(w + random.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "! "]) for w in random.choices(words, weights, k=random.randrange(25)))

    rows = [(i, text(), random.choice(["en", "de", None]), 1, "x", "y") for i in range(60)]
    return [*rows, rows[0], (99, None, "en", 1, None, None), (99, "", "es", 1, None, None), (None, "one two " * 40, "en", 1, None, None)]


def test_all_cases_against_plain_counting(spark):
    for seed, block, top, sorted_rows in ((1, 7, 2000, 200_000), (2, 1000, 5, 3)):
        rows = made_up(seed)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        phrases.SORTED, before = sorted_rows, phrases.SORTED
        try:
            got = phrases.collocations(docs, least=4, top=top, block=block).collect()
        finally:
            phrases.SORTED = before
        assert {tuple(r) for r in got} == plain(rows, 4, top)
        assert len(got) == len({(r["lang"], r["rank"]) for r in got})


def test_an_empty_table_gives_an_empty_result(spark):
    got = phrases.collocations(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    count, left, right = 7 * 10**17, 9 * 10**17, 10**18 + 1
    row = spark.range(1).select(phrases.score(F.lit(count), F.lit(left), F.lit(right)).alias("s")).first()
    assert row["s"] == 2_000_000 * count // (left + right)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 5), max_size=40), st.sets(st.integers(0, 5)))
def test_semi_join_keeps_neighbours(places, frequent):
    frequent = np.array(sorted(frequent), np.int64)
    got = phrases.semi_join(np.array(places, np.int32), frequent)
    known = {int(v): i for i, v in enumerate(frequent)}
    mapped = [known.get(p, -1) for p in places]
    pairs = lambda x: [(a, b) for a, b in zip(x[:-1], x[1:]) if a >= 0 and b >= 0]  # noqa: E731, B905
    assert pairs(got.tolist()) == pairs(mapped)
    assert not any(a < 0 and b < 0 for a, b in zip(got[:-1], got[1:], strict=True))
    assert phrases.unpacked(phrases.packed(got)).tolist() == got.tolist()


def test_slices_of_a_long_text_hold_the_same_words():
    text = ("New york, city. " * 30 + "y" * 50 + "\r\nend").encode()
    whole = [w for part in phrases.word_slices(text) for w in part]
    assert [w for part in phrases.word_slices(text, 9) for w in part] == whole
    assert whole[:5] == [b"new", b"york", b".", b"city", b"."] and whole[-4:] == [b"y" * 50, b".", b".", b"end"]


def test_numbered_pairs_holds_little_beside_the_block(monkeypatch):
    """Pairs get the numbers that a plain search gives, in memory of a few numbers a place."""
    import tracemalloc

    monkeypatch.setattr(phrases, "CHUNK", 30_000)
    places = np.random.default_rng(3).integers(-1, 40, 400_000).astype(np.int32)
    pairs = sorted({(int(a), int(b)) for a, b in zip(places, places[1:]) if a >= 0 and b >= 0})
    codes = np.arange(0, len(pairs), 3)
    number = {pairs[c]: i for i, c in enumerate(codes)}
    expected = [number.get((int(a), int(b)), -1) for a, b in zip(places, places[1:])] + [-1]
    tracemalloc.start()
    got = phrases.numbered_pairs(places, codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == expected and got.dtype == np.int32
    assert peak < 12 * len(places)


def test_pair_counts_put_bytes_that_differ_side_by_side(spark):
    ids = np.array([5, (3 << 32) + 7], "<i8")
    relation = spark.createDataFrame(
        [(2, phrases.packed(np.array([0, 1, -1, 0, 1, -1, 1, 1])), ids.tobytes())], "block long, data binary, ids binary"
    )
    counts = phrases.pair_counts(relation)
    assert counts.columns == ["n", "a", "b", "key"]
    found = counts.withColumn("b", phrases.turned(counts.b)).collect()
    assert sorted(tuple(r) for r in found) == [(1, ids[1], ids[1], (2 << 32) + 1), (2, ids[0], ids[1], 2 << 32)]
    back = counts.select(phrases.turned(phrases.turned(counts.b)).alias("b"), counts.b.alias("c")).collect()
    assert all(r["b"] == r["c"] == int(np.int64(ids[1]).byteswap()) for r in back)
