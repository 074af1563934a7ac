"""The classifier chain: held-out accuracy, out-of-fold training, odd inputs."""

import random

import numpy as np
import pytest

from atalaya.llm import toxicity


def corpus(n, seed=13):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdeiorst") for _ in range(random.randrange(2, 8)))
    common = [word() for _ in range(300)]
    bad = ["zabbix", "qoppa", "wuzzle", "kvetch", "gnarled"]
    docs, labels = [], []
    for i in range(n):
        words = [random.choice(common) for _ in range(random.randrange(20, 200))]
        toxic, junk = random.random() < 0.15, random.random() < 0.1
        if toxic:
            for _ in range(random.randrange(1, 8)):
                words.insert(random.randrange(len(words)), random.choice(bad) + random.choice(["", ".", "ly"]))
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else " ".join(words), "x", 0.5))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus(1500)
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic string, p double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels},
    )


def test_held_out_accuracy(frames):
    docs, labels, truth = frames
    model = toxicity.fit_model(docs, labels.where("doc_id < 1000"))
    rows = toxicity.toxicity_scores(docs.where("doc_id >= 1000"), model).collect()
    assert len(rows) == 500
    assert np.mean([r["rejected"] == (truth[r["doc_id"]] == 1) for r in rows]) > 0.99
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.where("doc_id >= 1000").collect()} == {r["doc_id"] for r in rows if not r["rejected"]}


def test_later_models_see_earlier_probabilities():
    # The second category is the first one's opposite, told by no feature of its own.
    random.seed(14)
    rows = [[0] if random.random() < 0.5 else [] for _ in range(400)]
    first = np.array([float(bool(r)) for r in rows])
    weights = toxicity.fit_chain(rows, np.column_stack([first, 1 - first]), np.arange(400) % toxicity.FOLDS, 1)
    assert [len(w) for w in weights] == [2, 3]
    assert weights[1][1] < -0.5  # the weight of the first category's probability
    model = toxicity.Model({"bad": 0}, weights)
    found = model.probabilities(["bad", "good"])
    assert found[0, 0] > 0.95 > 0.05 > found[1, 0] and found[0, 1] < 0.05 < 0.95 < found[1, 1]


def test_logistic_fit_reaches_the_optimum():
    rng = np.random.default_rng(15)
    x = rng.integers(0, 2, (300, 6))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0, -2] - 0.3)))).astype(float)
    rows = [np.flatnonzero(r).tolist() for r in x]
    weights = toxicity.fit_logistic(toxicity._Rows(rows, np.zeros((300, 0))), y, 6, rounds=3000, ridge=1e-3)
    full = np.column_stack([x, np.ones(300)])
    slope = full.T @ (1 / (1 + np.exp(-full @ weights)) - y) / 300 + 1e-3 * weights * [1] * 1 * np.array([1] * 6 + [0])
    assert np.abs(slope).max() < 1e-5


def test_odd_inputs(spark, frames):
    docs, labels, _ = frames
    model = toxicity.fit_model(docs, labels)
    odd = spark.createDataFrame([(1, None, None, None), (None, "", None, None), (2, "zabbix wuzzle " * 5000, "x", 1.0), (2, "zabbix wuzzle " * 5000, "x", 1.0)], docs.schema)
    found = [(r["doc_id"], r["rejected"]) for r in toxicity.toxicity_scores(odd, model).collect()]
    assert sorted(found, key=str) == sorted([(1, False), (None, False), (2, True), (2, True)], key=str)
    assert toxicity.without_toxic(odd, model).count() == 2 and toxicity.toxicity_scores(odd.limit(0), model).count() == 0
    bare = toxicity.fit_model(docs, labels.limit(0))
    assert not any(r["rejected"] for r in toxicity.toxicity_scores(docs.limit(50), bare).collect())
    noisy = labels.limit(30).selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic").unionByName(labels).unionByName(labels.limit(9))
    assert toxicity.fit_model(docs, noisy).features == model.features


def test_repeated_rows_do_not_swell_the_sample(spark, frames):
    docs, labels, _ = frames
    first = docs.where("doc_id = 3")
    many = docs.unionByName(first.crossJoin(spark.range(5000)).drop("id"))
    sample = toxicity.labelled_sample(many, labels, 100_000, 10)
    assert sample.count() == 1500 and toxicity.fit_model(many, labels).features == toxicity.fit_model(docs, labels).features


def test_features_equal_plain_counting(frames):
    docs, labels, truth = frames
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = {}
    for i, text in texts.items():
        for f in {f for w in toxicity.words_of(text) for f in toxicity.features_of_word(w)}:
            counts.setdefault(f, [0, 0])[truth[i]] += 1
    t = sum(truth.values())
    c = len(truth) - t
    plain = set()
    for f, (m, n) in counts.items():
        both = (m + n) / (t + c)
        sigma = (both * (1 - both) * (1 / t + 1 / c)) ** 0.5
        if n >= toxicity.LEAST_DOCUMENTS and sigma and abs(n / t - m / c) >= toxicity.LEAST_SIGMA * sigma:
            plain.add((f, n / t > m / c))
    sample = toxicity.labelled_sample(docs, labels, 100_000, 10)
    assert {tuple(r) for r in toxicity.telling_features(sample, t, c).collect()} == plain and plain
