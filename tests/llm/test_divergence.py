"""Source divergence against plain counting with Python's whole numbers."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from atalaya.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank int, term string"
ROWS = [
    (1, "Alpha beta, GAMMA alpha", "en", "a", 1, "x"), (2, "alpha Beta-gamma delta", "en", "b", 1, "x"), (2, "alpha Beta-gamma delta", "en", "b", 1, "x"),
    (3, "beta beta beta İstanbul ístan", "en", "c", 1, "x"), (4, "İstanbul", "en", "a", 1, "x"), (None, "İstanbul ístan alpha", "en", None, 1, None),
    (5, None, "en", "d", 1, "x"), (6, "", None, "a", 1, "x"), (7, "nur einmal", "de", "a", 1, "x"), (8, "auch nur", "de", "b", 1, "x"),
    (9, "wort wort", "fr", "a", 1, "x"), (10, "wort", "fr", "a", 1, "x"), (11, "wort\x00Wort\x7fwort", "fr", "a", 1, "x"),
]


def plain(rows, top):
    docs, groups, counts = Counter(), {}, Counter()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        groups.setdefault((lang, source), Counter()).update(terms)
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, t) for t in terms)
    found = set()
    for (lang, source), own in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 3]

        def share(count, of, kept=kept):
            return 1 + 10**9 * (count + 1) // (sum(of(t) for t in kept) + len(kept))

        def far(p, q):
            return (p - q) ** 2 // q

        pairs, telling = [], []
        for (x, other), theirs in groups.items():
            if x == lang and other != source:
                pairs.append((other, sum(far(share(own[t], own.__getitem__), share(theirs[t], theirs.__getitem__)) for t in kept)))
        whole = lambda t, lang=lang: counts[lang, t]
        for t in kept:
            p, q = share(own[t], own.__getitem__), share(whole(t), whole)
            if own[t] and p > q:
                telling.append((t, far(p, q)))
        for part, values, limit in (("pair", pairs, None), ("term", telling, top)):
            values = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:limit]
            found |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(values)}
    return found


def test_all_cases_against_plain_counting(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for block, top in ((1, 2), (1000, 200)):
        got = divergence.source_divergence(docs, block=block, top=top).collect()
        assert {tuple(r) for r in got} == plain(ROWS, top)
        assert len(got) == len({tuple(r) for r in got})


def test_an_empty_table_gives_an_empty_result(spark):
    got = divergence.source_divergence(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and got.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_accumulation_is_the_dense_sum(data):
    groups, terms = data.draw(st.integers(1, 6)), data.draw(st.integers(1, 12))
    cells = np.array(data.draw(st.lists(st.lists(st.integers(0, 3), min_size=terms, max_size=terms), min_size=groups, max_size=groups)))
    group, term = np.nonzero(cells)
    sizes = cells.sum(axis=1) + terms
    p = [[1 + 10**9 * (int(c) + 1) // int(n) for c in row] for row, n in zip(cells, sizes, strict=True)]
    expected = [[sum((x - y) ** 2 // y for x, y in zip(a, b, strict=True)) for b in p] for a in p]
    got = divergence.accumulate(group.astype(np.int64), term, cells[group, term].astype(np.int64), sizes.astype(np.int64), terms, True)
    assert [list(map(int, row)) for row in got] == expected


def test_shares_of_large_counts_do_not_overflow():
    counts, totals = np.array([4 * 10**15, 1, 5]), np.array([7 * 10**15, 9 * 10**15, 5])
    assert divergence.shares(counts, totals).tolist() == [1 + 10**9 * int(c) // int(n) for c, n in zip(counts, totals, strict=True)]


def test_slices_of_a_long_text_hold_the_same_terms():
    text = ("Alpha beta " * 50 + "x" * 40 + " é–ä").encode()
    whole = [t for part in divergence.term_slices(text) for t in part]
    assert [t for part in divergence.term_slices(text, 16) for t in part] == whole
    assert whole[-2:] == [b"x" * 40, "é–ä".encode()]
