"""Evaluation jobs: reserve a holdout, fit and tune on the rest, report on the holdout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.operators.evaluation import (
    group_id,
    holdout_metrics,
    holdout_split_family,
    holdout_split_pair,
    require_both_labels,
    split_assignment_join,
)
from atalaya.operators.favoritism import PAIR, PAIR_FEATURES, fav_features
from atalaya.operators.fingerprint import counted_fingerprint
from atalaya.operators.models import (
    K_VALUES,
    MAX_FOLDS,
    OPERATIONAL_GRID,
    VALIDATION_SEEDS,
    kmeans_train,
    kmeans_tune,
    label_counts,
    rf_importances,
    rf_tune,
    score_groups,
    score_pairs,
)
from atalaya.operators.preprocessing import apply_preprocessor, fit_preprocessor
from atalaya.operators.skew import hot_split_join, same_key
from atalaya.operators.splitting import GROUP, GROUP_FEATURES, family_after_fill, frac_features, with_family_of_texts
from atalaya.runtime import deal, discard, materialize, new_location

MODEL_AMOUNT = "monto_capped"


def _prepared(development: DataFrame, *sides: DataFrame) -> tuple[list[DataFrame], dict]:
    """Any rows through statistics that were learned on development rows only."""
    spark = development.sparkSession
    path = new_location(spark, "medians")
    state = fit_preprocessor(development, medians_path=path)
    medians = spark.read.parquet(path)
    return [apply_preprocessor(side, state, medians) for side in sides], state


def _pair_features(contracts: DataFrame, assigned: DataFrame) -> tuple[DataFrame, dict]:
    """Features of all pairs with their side of the split.

    A pair lies on one side and the statistics are frozen, so both sides are measured together, and
    contracts are joined with their side for the fit only.
    """
    development, _holdout = split_assignment_join(contracts, assigned, PAIR)
    (prepared,), state = _prepared(development, contracts)
    pairs = fav_features(prepared, label="label_favoritismo", amount=MODEL_AMOUNT)
    sides = assigned.select(*[F.col(c).alias(f"_of_{c}") for c in PAIR], "is_holdout")
    of = [f"_of_{c}" for c in PAIR]
    return pairs.join(sides, same_key(PAIR, of)).drop(*of), state


def eval_favoritism(
    contracts: DataFrame, grid: dict[str, list[int]] = OPERATIONAL_GRID, folds: int = MAX_FOLDS
) -> dict:
    """Pair model: split before any fit, tune on development, refit, score the holdout."""
    corpus, rows = counted_fingerprint(contracts)
    deal(contracts.sparkSession, rows)
    # Written once: the gate, the join of the contracts and the features read it.
    assigned = materialize(holdout_split_pair(contracts), "assignment")
    require_both_labels(assigned)
    features, state = _pair_features(contracts, assigned)
    sided = materialize(features, "features")
    fit_pairs, check_pairs = (sided.where(side).drop("is_holdout") for side in (~F.col("is_holdout"), F.col("is_holdout")))
    try:
        model, tried = rf_tune(fit_pairs, grid, folds)
        trees, depth = int(model.getNumTrees), int(model.getMaxDepth())
        scored = score_pairs(check_pairs, model).select(
            group_id(PAIR).alias("id"), "label", F.col("score_riesgo_favoritismo").alias("score")
        )
        metrics = holdout_metrics(scored)
        positives, negatives = label_counts(fit_pairs)
        check_positives, check_negatives = label_counts(check_pairs)
        settings = [r.asDict() for r in tried.collect()]
        importances = {r["variable"]: r["importancia"] for r in rf_importances(contracts.sparkSession, model).collect()}
    finally:
        discard(sided)
        discard(assigned)
    return {
        "algorithm": "RandomForestClassificationModel",
        "amount_source": MODEL_AMOUNT,
        "features": PAIR_FEATURES,
        "training_data_fingerprint_sha256": corpus,
        "n_desarrollo": positives + negatives,
        "positivos_desarrollo": positives,
        "n_holdout": check_positives + check_negatives,
        "positivos_holdout": check_positives,
        "mejor_configuracion": {"numTrees": trees, "maxDepth": depth, "auc_pr_cv": settings[0]["auc_pr_cv"]},
        "configuraciones": settings,
        "metricas_holdout_final": metrics,
        "feature_importances": importances,
        "preprocessor_fit_scope": "development_only",
        "preprocessor_fit_engine": state["fit_engine"],
    }


def _sided_by_family(contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What group features need of the contracts, with the family of the object and the side of the split, and the assignment; both written."""
    # Only whether a contract has an id is counted, and the id has most bytes.
    needed = contracts.select(
        F.when(F.col("id_contrato").isNotNull(), F.lit("")).alias("id_contrato"), *GROUP[:2], "monto", "fecha_contrato", "modalidad", "objeto",
        *[c for c in ("categoria_principal",) if c in contracts.columns], "label_fraccionamiento",
    )
    # Written once: the families, the split and the join read it.
    keyed = materialize(with_family_of_texts(needed), "keyed")
    assigned = materialize(holdout_split_family(keyed, keyed=True), "assignment")
    require_both_labels(assigned)
    sided = materialize(hot_split_join(keyed, assigned.select(*GROUP, "is_holdout"), GROUP, assigned, "n_contratos"), "sided")
    discard(keyed)
    return sided, assigned


def _group_features(development: DataFrame, holdout: DataFrame) -> tuple[list[DataFrame], dict]:
    """Group features of both sides, written, from statistics of the development side."""
    sides = [side.withColumn("_unnamed", F.col("objeto").isNull()) for side in (development, holdout)]
    prepared, state = _prepared(sides[0], *sides)
    features = [frac_features(family_after_fill(side), label="label_fraccionamiento", family="_family") for side in prepared]
    return [materialize(side, "features") for side in features], state


def eval_splitting(
    contracts: DataFrame, k_values: Sequence[int] = K_VALUES, seeds: Sequence[int] = VALIDATION_SEEDS
) -> dict:
    """Splitting model: the same with object families; labels only choose k."""
    corpus, rows = counted_fingerprint(contracts)
    deal(contracts.sparkSession, rows)
    sided, assigned = _sided_by_family(contracts)
    try:
        (fit_groups, check_groups), state = _group_features(*[sided.where(side).drop("is_holdout") for side in (~F.col("is_holdout"), F.col("is_holdout"))])
    finally:
        discard(sided)
        discard(assigned)
    try:
        counts = {"desarrollo": label_counts(fit_groups), "holdout": label_counts(check_groups)}
        if not all(all(pair) for pair in counts.values()):
            raise GateError(f"a side of the split lacks a label: {counts}")
        table = [r.asDict() for r in kmeans_tune(fit_groups, k_values, seeds).collect()]
        best = table[0]
        model, scaler = kmeans_train(fit_groups, best["k"])
        scored = score_groups(check_groups, model, scaler).select(
            group_id(GROUP).alias("id"), "label", F.col("score_anomalia").alias("score")
        )
        metrics = holdout_metrics(scored, by_rank=True)
    finally:
        discard(fit_groups)
        discard(check_groups)
    return {
        "algorithm": "StandardScalerModel + KMeansModel + centroid distance",
        "features": GROUP_FEATURES,
        "training_data_fingerprint_sha256": corpus,
        "k_values": list(k_values),
        "n_desarrollo": sum(counts["desarrollo"]),
        "positivos_desarrollo": counts["desarrollo"][0],
        "n_holdout": sum(counts["holdout"]),
        "positivos_holdout": counts["holdout"][0],
        "mejor_configuracion": best,
        "configuraciones": table,
        "metricas_holdout_final": metrics,
        "preprocessor_fit_scope": "development_only",
        "preprocessor_fit_engine": state["fit_engine"],
        "labels_used_for_fit": False,
    }
