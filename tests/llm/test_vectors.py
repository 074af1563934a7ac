"""Links and components of embeddings against all pairs."""

import numpy as np
import pytest

from atalaya.llm import vectors


def table():
    rng = np.random.default_rng(12)
    rows = [v for v in rng.standard_normal((300, 16))]
    for size, noise in ((2, 0.1), (40, 0.02), (30, 0.08), (700, 0.03), (6, 0.0)):
        base = rng.standard_normal(16)
        rows += [base + noise * rng.standard_normal(16) * np.linalg.norm(base) / 4 for _ in range(size)]
    rows = [v.tolist() for v in rows] + [rows[0] * 3, rows[1], rows[1]]
    rows = [None if v is None else [float(x) for x in v] for v in rows]
    rows += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [1.0, 0.0], [2.0, 0.1], [1e-200] * 16, [1e200] * 16]
    return list(enumerate(rows))


def plain(rows, cosine):
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = []
    usable = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit = np.array(v) / max(map(abs, v))
            usable[i] = unit / np.linalg.norm(unit)
    for size in {len(v) for v in usable.values()}:
        ids = [i for i in usable if len(usable[i]) == size]
        m = np.stack([usable[i] for i in ids])
        pairs += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1)), strict=True)]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (links[i], label[i], label[i] == i) for i, _ in rows}


@pytest.mark.parametrize("blocks", [(512, 2048), (8, 16)])
def test_equals_all_pairs(spark, blocks, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", blocks[0])
    monkeypatch.setattr(vectors, "CHUNK", blocks[1])
    rows = table()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label string, component int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert found == plain(rows, vectors.COSINE)


def test_rows_that_repeat_and_empty_tables(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [9.0, -1.0])], "vec_id long, embedding array<float>")
    found = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=str)
    assert found == sorted([(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 0, None, True)], key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_links_that_no_window_meets_are_found(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 200)
    monkeypatch.setattr(vectors, "STRIP", 64)
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vectors.near_vectors(df, passes=1, bits=1, window=1).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == plain(rows, vectors.COSINE)
