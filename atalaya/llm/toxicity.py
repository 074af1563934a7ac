"""Toxicity by a classifier chain of linear models.

The categories are predicted in a fixed order. Each one's logistic model sees the text's features and
the probabilities of the categories before it; for training these come from out-of-fold predictions, so
a later model learns from probabilities as uncertain as those it meets in use.

Features are distinct words and word beginnings (of 4, 5 and 6 letters), kept when they tell toxic from clean
labelled documents apart beyond chance.

Categories, in order: `low_quality` (label quality = 0), `toxic` (label toxic = 1), and `severe`, a toxic
document with at least `SEVERE` different telling words.

The model is fitted on a bounded sample of the labelled documents (`SAMPLE` rows, drawn by a hash of the id);
every document is scored over its whole text.

Defined results: a null text is an empty one and has no features; labels that are null don't count, several
labels of one document count as their largest toxicity and least quality; of several texts of one labelled id the
smallest is learned from; without any toxic or any clean label
nothing is toxic; rows that repeat are scored each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from atalaya.llm.frames import documents, numbered, small_batches
from atalaya.runtime import discard, materialize

CATEGORIES = ("low_quality", "toxic", "severe")
#: Labelled documents that the model is fitted on, about.
SAMPLE = 12_000
#: Toxic documents a feature must occur in, and standard deviations between its two rates.
LEAST_DOCUMENTS, LEAST_SIGMA = 4, 5.0
SEVERE = 4
FOLDS = 3
REJECT_AT = 0.5
BEGINNINGS = (4, 5, 6)
#: Words whose features one Python worker remembers. Bounds memory only.
CACHE_WORDS = 500_000
_WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of_word(word: str) -> list[str]:
    """The word, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Model:
    """Feature numbers and, per category, weights: features, earlier categories, constant."""

    features: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    _known: dict = field(default_factory=dict, repr=False)

    def found(self, text: str) -> list[int]:
        """Numbers of the features of a text, in order."""
        known, out = self._known, set()
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in words_of(text):
            own = known.get(word)
            if own is None:
                own = known[word] = tuple(self.features[f] for f in features_of_word(word) if f in self.features)
            if own:
                out.update(own)
        return sorted(out)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """One row per text, one column per category."""
        rows = [self.found(t) for t in texts]
        out = np.zeros((len(texts), len(CATEGORIES)))
        for k, weights in enumerate(self.weights):
            out[:, k] = _sigmoid(_Rows(rows, out[:, :k]) @ weights)
        return out

    def __getstate__(self) -> dict:
        return {"features": self.features, "weights": self.weights, "_known": {}}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Rows:
    """Rows of present features, further dense columns, and a constant."""

    def __init__(self, rows: list[list[int]], dense: np.ndarray):
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.index = np.fromiter((i for r in rows for i in r), np.int64, int(self.sizes.sum()))
        self.row = np.repeat(np.arange(len(rows)), self.sizes)
        self.dense = np.column_stack([dense, np.ones(len(rows))])

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        cut = len(weights) - self.dense.shape[1]
        return np.bincount(self.row, weights[self.index], len(self.dense)) + self.dense @ weights[cut:]

    def transposed(self, values: np.ndarray, features: int) -> np.ndarray:
        return np.concatenate([np.bincount(self.index, values[self.row], features), values @ self.dense])


def fit_logistic(rows: _Rows, target: np.ndarray, features: int, *, rounds: int = 400, ridge: float = 1e-5) -> np.ndarray:
    """Weights by accelerated gradient descent; the ridge leaves the constant out."""
    n = len(target)
    weights = np.zeros(features + rows.dense.shape[1])
    # The largest eigenvalue of the curvature is below a quarter of the largest row's squared length.
    probe = np.ones(len(weights))
    for _ in range(10):
        probe = rows.transposed(rows @ probe, features) / n
        scale = np.linalg.norm(probe) or 1.0
        probe /= scale
    step = 1 / (0.3 * scale + ridge)
    ahead, momentum = weights.copy(), 1.0
    penalty = np.full(len(weights), ridge)
    penalty[-1] = 0
    for _ in range(rounds):
        slope = rows.transposed(_sigmoid(rows @ ahead) - target, features) / n + penalty * ahead
        fresh = ahead - step * slope
        faster = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = fresh + (momentum - 1) / faster * (fresh - weights)
        weights, momentum = fresh, faster
    return weights


def fit_chain(rows: list[list[int]], targets: np.ndarray, fold: np.ndarray, features: int) -> list[np.ndarray]:
    """One model per category, in order; `targets` has a column per category."""
    weights, earlier = [], np.zeros((len(rows), 0))
    for k in range(targets.shape[1]):
        out_of_fold = np.zeros(len(rows))
        for which in range(FOLDS):
            inside, outside = np.flatnonzero(fold != which), np.flatnonzero(fold == which)
            own = fit_logistic(_Rows([rows[i] for i in inside], earlier[inside]), targets[inside, k], features)
            out_of_fold[outside] = _sigmoid(_Rows([rows[i] for i in outside], earlier[outside]) @ own)
        weights.append(fit_logistic(_Rows(rows, earlier), targets[:, k], features))
        earlier = np.column_stack([earlier, out_of_fold])
    return weights


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """Text and labels of about `rows` labelled documents, the same ones at every run."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"), F.coalesce(F.min("quality"), F.lit(1)).cast("int").alias("quality")
    )
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    # The sample bounds this side: about `rows` rows of three numbers.
    texts = documents(docs).join(F.broadcast(drawn), "doc_id")
    # One text per id, combined before the shuffle, so repeated rows neither add to the sample nor crowd a task.
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("quality").alias("quality"))


def telling_features(sample: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Features whose shares among the `toxic` and the `clean` documents differ beyond chance, and which share is larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label].update({f for w in words_of(text) for f in features_of_word(w)})
        for label, own in enumerate(counts):
            numbers, none = pa.array(list(own.values()), pa.int64()), pa.array([0] * len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), *((none, numbers) if label else (numbers, none))], ["feature", "m", "n"])

    counted = sample.where("toxic in (0, 1)").select("text", "toxic").mapInArrow(run, "feature string, m long, n long")
    totals = counted.groupBy("feature").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    p, q, both = F.col("n") / toxic, F.col("m") / clean, (F.col("n") + F.col("m")) / (toxic + clean)
    sigma = F.sqrt(both * (1 - both) * (1 / toxic + 1 / clean))
    return totals.where((sigma > 0) & (F.abs(p - q) >= LEAST_SIGMA * sigma)).select("feature", (p > q).alias("more"))


def fit_model(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE, seed: int = 10) -> Model:
    """The chain, fitted on a bounded sample of labelled documents."""
    small_batches(docs.sparkSession)
    # Written once: it is read for the totals, the features and the rows of the fit.
    sample = materialize(labelled_sample(docs, labels, sample_rows, seed), "labelled")
    totals = sample.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.when(F.col("toxic") == 0, 1)).alias("c")).first()
    if not totals["t"] or not totals["c"]:
        discard(sample)
        return Model()
    kept = [(r["feature"], r["more"]) for r in telling_features(sample, totals["t"], totals["c"]).collect()]
    model = Model({feature: i for i, (feature, _) in enumerate(sorted(kept))})
    telling = {model.features[f] for f, more in kept if more and not f.endswith("*")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.found(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "quality", "found"])

    # Bounded by the sample; only feature numbers reach the driver.
    data = sample.mapInArrow(run, "doc_id long, toxic int, quality int, found array<int>").toPandas()
    discard(sample)
    data["found"] = [list(x) for x in data["found"]]
    data = data.sort_values("doc_id", kind="stable", ignore_index=True)
    severe = [t == 1 and len(telling.intersection(f)) >= SEVERE for t, f in zip(data["toxic"], data["found"], strict=True)]
    targets = np.column_stack([data["quality"] == 0, data["toxic"] == 1, severe]).astype(float)
    model.weights = fit_chain(data["found"].tolist(), targets, np.arange(len(data)) % FOLDS, len(model.features))
    return model


def chain_probabilities(text: Column, model: Model) -> Column:
    """Probabilities of the categories, in order, as an array."""
    own = model  # one object per worker batch stream; its word memory stays in the worker

    @pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(own.probabilities(texts.fillna("").tolist())))

    return run(text)


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, a probability per category, and whether the document is rejected."""
    small_batches(docs.sparkSession)
    scored = documents(docs).select("doc_id", chain_probabilities(F.col("text"), model).alias("p"))
    return scored.select(
        "doc_id", *[F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(CATEGORIES)],
        (F.col("p")[CATEGORIES.index("toxic")] >= REJECT_AT).alias("rejected"),
    )


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    small_batches(docs.sparkSession)
    own = numbered(docs)
    probability = chain_probabilities(F.col(own.columns[docs.columns.index(text_column)]), model)[CATEGORIES.index("toxic")]
    return own.where(probability < REJECT_AT).toDF(*docs.columns)
