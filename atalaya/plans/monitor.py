"""Monitoring of a saved model: drift of a batch against training data, and the decision."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.operators.contract import LABELS
from atalaya.operators.drift import (
    GROUP_DRIFT_FEATURES,
    PAIR_DRIFT_FEATURES,
    batch_labels,
    batch_recall,
    drift_report,
    retrain_decision,
)
from atalaya.operators.evaluation import group_id, union_train_batch
from atalaya.operators.favoritism import PAIR, fav_features
from atalaya.operators.models import score_groups, score_pairs
from atalaya.operators.preprocessing import apply_preprocessor
from atalaya.operators.splitting import GROUP, frac_features
from atalaya.plans.evaluate import MODEL_AMOUNT
from atalaya.plans.train import MANIFEST, train_candidate
from atalaya.runtime import materialize
from atalaya.sources.readers import load_medians
from atalaya.sources.sinks import read_json


def _with_label(rows: DataFrame, label: str | None) -> DataFrame:
    return rows if label else rows.withColumn("label", F.lit(None).cast("int"))


def monitor_batch(batch: DataFrame, model_folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Long drift report (lote, modelo, variable, psi) and the one-row decision for a batch.

    The training data are known by the baselines that were saved with the model; only the batch is read.
    """
    spark = batch.sparkSession
    manifest = read_json(spark, f"{model_folder}/{MANIFEST}")
    part = {k: f"{model_folder}/{v}" for k, v in manifest["artifacts"].items()}
    state = read_json(spark, part["preprocessor_json"])
    medians = load_medians(spark, part.get("preprocessor_medians"), state)
    new = apply_preprocessor(batch, state, medians)
    labelled = {c: c in batch.columns for c in LABELS}

    pair_label = "label_favoritismo" if labelled["label_favoritismo"] else None
    # Written once: scores and drift read the features.
    new_pairs = materialize(fav_features(new, label=pair_label, amount=MODEL_AMOUNT), "features")
    group_label = "label_fraccionamiento" if labelled["label_fraccionamiento"] else None
    clusters = KMeansModel.load(part["fraccionamiento_model"])
    scaler = StandardScalerModel.load(part["fraccionamiento_scaler"])
    new_groups = score_groups(materialize(frac_features(new, label=group_label), "features"), clusters, scaler)

    forest = RandomForestClassificationModel.load(part["favoritismo_model"])
    scored = [
        _with_label(score_pairs(new_pairs, forest), pair_label).select(
            group_id(PAIR).alias("id"), "label", F.col("score_riesgo_favoritismo").alias("score")),
        _with_label(new_groups, group_label).select(
            group_id(GROUP).alias("id"), "label", F.col("score_anomalia").alias("score")),
    ]
    # Written once: recall and labels are both read from the scores.
    scored = [materialize(rows, "scored") for rows in scored]

    report = (
        drift_report(spark.read.parquet(part["favoritismo_baseline"]), new_pairs, PAIR_DRIFT_FEATURES)
        .withColumn("modelo", F.lit("favoritismo"))
        .unionByName(
            drift_report(spark.read.parquet(part["fraccionamiento_baseline"]), new_groups, GROUP_DRIFT_FEATURES)
            .withColumn("modelo", F.lit("fraccionamiento"))
        )
        .withColumn("lote", F.lit(name))
    )
    recalls, labels = (
        reduce(DataFrame.unionByName, [measure(rows, name) for rows in scored]) for measure in (batch_recall, batch_labels)
    )
    decision = retrain_decision(report, recalls, labels)
    return report, decision


def retrain(training: DataFrame, batch: DataFrame, model_folder: str, folder: str) -> dict:
    """Candidate on training data plus the labelled batch, with the champion's settings."""
    spark = training.sparkSession
    champion = read_json(spark, f"{model_folder}/{MANIFEST}")
    models = champion["models"]
    return train_candidate(
        union_train_batch(training, batch),
        folder,
        inherited={
            **models["favoritismo"]["params"],
            **models["fraccionamiento"]["params"],
            "champion": champion["candidate_id"],
        },
    )
