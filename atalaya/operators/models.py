"""Pair classifiers and the clustering model, on MLlib."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.operators.contract import count_flag
from atalaya.operators.evaluation import auc_metrics, grid_metrics, group_id, holdout_metrics, stratified_folds, validation_sides
from atalaya.operators.favoritism import PAIR, PAIR_FEATURES
from atalaya.operators.forests import forest_nodes, nested_scores
from atalaya.operators.splitting import GROUP, GROUP_FEATURES
from atalaya.runtime import discard, in_parallel, materialize, spread

# --- fixed values -----------------------------------------------------------
SEED = 42
OPERATIONAL_GRID = {"numTrees": [100, 200, 300], "maxDepth": [3, 4, 6]}
MAX_FOLDS, MIN_FOLDS = 5, 3
K_VALUES = [2, 3, 4, 5, 6]
VALIDATION_SEEDS = [11, 23, 37, 53, 71]
COMPARED_FOREST = {"numTrees": 100, "maxDepth": 3}
COMPARED_BOOSTING = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
METRICS = ["accuracy", "auc_pr", "auc_roc", "precision", "recall", "f1", "recall_at_k"]
# ----------------------------------------------------------------------------


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def positive_probability() -> Column:
    return vector_to_array("probability")[1]


def label_counts(features: DataFrame) -> tuple[int, int]:
    row = features.agg(
        F.coalesce(count_flag(F.col("label") == 1), F.lit(0)).alias("pos"),
        F.coalesce(count_flag(F.col("label") == 0), F.lit(0)).alias("neg"),
    ).first()
    return row["pos"], row["neg"]


def class_weights(features: DataFrame) -> DataFrame:
    """Adds `peso`: n / (2 * rows of the class), so that both classes weigh the same."""
    positives, negatives = label_counts(features)
    if not positives or not negatives:
        raise GateError(f"training needs both classes: positive={positives}, negative={negatives}")
    total = positives + negatives
    weight = F.when(F.col("label") == 1, F.lit(total / (2 * positives)))
    return features.withColumn("peso", weight.otherwise(F.lit(total / (2 * negatives))))


def _forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="peso", seed=SEED, **params)


def rf_train(features: DataFrame, trees: int, depth: int) -> RandomForestClassificationModel:
    """Weighted random forest on the pair features in their fixed order."""
    weighted = class_weights(features).select(*PAIR_FEATURES, "label", "peso")
    weighted = spread(weighted, [*PAIR_FEATURES, "label"], sum(label_counts(features)))
    rows = assemble(weighted, PAIR_FEATURES).select("features", "label", "peso")
    return _forest(numTrees=int(trees), maxDepth=int(depth)).fit(rows)


def fold_number(features: DataFrame, most: int = MAX_FOLDS) -> int:
    folds = min(most, *label_counts(features))
    if folds < MIN_FOLDS:
        raise GateError(f"cross-validation needs {MIN_FOLDS} groups of each label")
    return folds


def rf_tune(
    features: DataFrame,
    grid: dict[str, list[int]] = OPERATIONAL_GRID,
    folds: int = MAX_FOLDS,
    parallelism: int = MAX_FOLDS,
) -> tuple[RandomForestClassificationModel, DataFrame]:
    """Cross-validation on AUC-PR over numbers of trees and depths; best model and all settings.

    Each fold is fitted once, with most trees and the greatest depth. The other settings are parts
    of that forest and are scored in the same pass.
    """
    folds = fold_number(features, folds)
    sizes, depths = [int(n) for n in grid["numTrees"]], [int(d) for d in grid["maxDepth"]]
    # Written once: the same rows are fitted for every fold.
    kept = materialize(
        stratified_folds(class_weights(features), folds).select(*PAIR_FEATURES, "label", "peso", "fold"), "folds"
    )
    # Every fold reads the rows several times before its fit keeps them. What an executor loses is computed again, in the same order.
    rows = assemble(spread(kept, [*PAIR_FEATURES, "label", "fold"], kept.count()), PAIR_FEATURES).select("features", "label", "peso", "fold")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    forest = _forest(numTrees=max(sizes), maxDepth=max(depths))

    def left_out(fold: int) -> DataFrame:
        fit_rows = rows.where(F.col("fold") != fold).select("features", "label", "peso")
        nodes = forest_nodes(features.sparkSession, forest.copy().fit(fit_rows)).toPandas()
        scored = nested_scores(kept.where(F.col("fold") == fold), PAIR_FEATURES, nodes, sizes, depths)
        return scored.withColumn("fold", F.lit(fold))

    try:
        parts = in_parallel(features.sparkSession, [lambda f=fold: left_out(f) for fold in range(folds)], parallelism)
    finally:
        rows.unpersist()
    # Written once: counts, offsets and areas read the scores.
    scored = materialize(reduce(DataFrame.unionByName, parts), "votes")
    try:
        areas = auc_metrics(scored, groups=["trees", "depth", "fold"]).groupBy("trees", "depth")
        means = areas.agg(F.avg("auc_pr").alias("auc_pr_cv")).collect()
    finally:
        discard(kept)
        discard(scored)
    tried = sorted(((int(r["trees"]), int(r["depth"]), float(r["auc_pr_cv"])) for r in means), key=lambda r: (-r[2], r[0], r[1]))
    table = features.sparkSession.createDataFrame(tried, "numTrees int, maxDepth int, auc_pr_cv double")
    return rf_train(features, *tried[0][:2]), table.orderBy(F.desc("auc_pr_cv"), "numTrees", "maxDepth")


def rf_importances(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    rows = [(name, float(v)) for name, v in zip(PAIR_FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "variable string, importancia double").orderBy(
        F.desc("importancia"), "variable"
    )


def score_pairs(features: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Pair features with the probability of the positive class."""
    scored = model.transform(assemble(features, PAIR_FEATURES))
    return scored.withColumn("score_riesgo_favoritismo", positive_probability()).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def compare_classifiers(features: DataFrame, folds: int = MAX_FOLDS) -> DataFrame:
    """Logistic regression, forest and boosting, scored out of fold on seven metrics."""
    spark = features.sparkSession
    folds = fold_number(features, folds)
    dealt = stratified_folds(class_weights(features), folds).withColumn("id", group_id(PAIR))
    kept = materialize(dealt.select("id", *PAIR_FEATURES, "label", "peso", "fold"), "folds")
    # All fits and scores read these rows. What an executor loses is computed again, in the same order.
    rows = assemble(spread(kept, ["id"], kept.count()), PAIR_FEATURES).select("id", "features", "label", "peso", "fold")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    columns = {"featuresCol": "features", "labelCol": "label", "weightCol": "peso"}
    models = {
        "regresion_logistica": LogisticRegression(**columns),
        "bosque_aleatorio": RandomForestClassifier(**columns, seed=SEED, **COMPARED_FOREST),
        "potenciacion_gradiente": GBTClassifier(**columns, seed=SEED, **COMPARED_BOOSTING),
    }

    def out_of_fold(name: str, fold: int) -> DataFrame:
        fitted = models[name].copy().fit(rows.where(F.col("fold") != fold))
        scored = fitted.transform(rows.where(F.col("fold") == fold))
        return scored.select("id", "label", positive_probability().alias("score"))

    try:
        runs = [(name, fold) for name in models for fold in range(folds)]
        parts = in_parallel(spark, [lambda r=run: out_of_fold(*r) for run in runs])
        of_model = lambda name: reduce(DataFrame.unionByName, [part for run, part in zip(runs, parts) if run[0] == name])
        found = in_parallel(spark, [lambda n=name: holdout_metrics(of_model(n)) for name in models])
        results = [(name, *[float(metrics[m]) for m in METRICS]) for name, metrics in zip(models, found)]
    finally:
        rows.unpersist()
        discard(kept)
    schema = ", ".join(["modelo string", *[f"{m} double" for m in METRICS]])
    return spark.createDataFrame(results, schema).orderBy(F.desc("auc_pr"), F.desc("f1"), F.desc("auc_roc"), "modelo")


# --- clustering -----------------------------------------------------------------


def kmeans_train(groups: DataFrame, k: int, seed: int = SEED) -> tuple[KMeansModel, StandardScalerModel]:
    """Scaler with mean and deviation, then k-means; labels are never used."""
    models, scaler = _clusterings(groups, [k], seed)
    return models[int(k)], scaler


def _clusterings(groups: DataFrame, k_values: Sequence[int], seed: int = SEED) -> tuple[dict[int, KMeansModel], StandardScalerModel]:
    """A model of each k; the rows are spread, ordered and scaled once for all."""
    ordered = spread(groups.select(*GROUP_FEATURES), GROUP_FEATURES, groups.count())
    raw = assemble(ordered, GROUP_FEATURES, "features_raw").select("features_raw")
    scaler = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True).fit(raw)
    # Every iteration reads the scaled rows. What an executor loses is computed again, in the same order.
    scaled = scaler.transform(raw).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = lambda k: KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed).fit(scaled)
        ks = [int(k) for k in k_values]
        return dict(zip(ks, in_parallel(groups.sparkSession, [lambda k=k: fit(k) for k in ks]))), scaler
    finally:
        scaled.unpersist()


def centroid_distance(clustered: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Adds the Euclidean distance of `features` to the center of its own cluster.

    Centers are k short rows of a fitted model, so they travel as literals.
    """
    table = F.array(*[F.array(*[F.lit(float(x)) for x in center]) for center in centers])
    gaps = F.zip_with(
        vector_to_array("features"), F.element_at(table, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)
    )
    return clustered.withColumn("score_anomalia", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)))


def score_groups(groups: DataFrame, model: KMeansModel, scaler: StandardScalerModel) -> DataFrame:
    """Group features with cluster and anomaly score. Nothing is fitted."""
    scaled = scaler.transform(assemble(groups, GROUP_FEATURES, "features_raw"))
    scored = centroid_distance(model.transform(scaled), [list(c) for c in model.clusterCenters()])
    return scored.drop("features_raw", "features")


def _cluster_metrics(fit_rows: DataFrame, check_rows: DataFrame, k_values: Sequence[int]) -> dict[int, dict]:
    """Metrics of every k on the rows left out, whose scores are counted together."""
    fitted, scaler = _clusterings(fit_rows, k_values)
    scored = [
        score_groups(check_rows, model, scaler).select(
            F.lit(k).alias("k"), group_id(GROUP).alias("id"), "label", F.col("score_anomalia").alias("score")
        )
        for k, model in fitted.items()
    ]
    return grid_metrics(reduce(DataFrame.unionByName, scored), "k")


def kmeans_tune(
    groups: DataFrame, k_values: Sequence[int] = K_VALUES, seeds: Sequence[int] = VALIDATION_SEEDS
) -> DataFrame:
    """Every k over repeated validation splits; best mean AUC-PR, then recall@k, then smallest k."""
    found: dict[int, list[dict]] = {int(k): [] for k in k_values}

    def validated(seed: int) -> dict[int, dict]:
        sided = validation_sides(groups, seed)
        try:
            return _cluster_metrics(*[sided.where(side).drop("_validates") for side in (~F.col("_validates"), F.col("_validates"))], list(found))
        finally:
            discard(sided)

    for metrics in in_parallel(groups.sparkSession, [lambda s=seed: validated(s) for seed in seeds], len(seeds)):
        for k, values in metrics.items():
            found[k].append(values)
    rows = []
    for k, metrics in found.items():
        areas = [m["auc_pr"] for m in metrics]
        recalls = [m["recall_at_k"] for m in metrics]
        rows.append((k, sum(areas) / len(areas), min(areas), max(areas), sum(recalls) / len(recalls)))
    schema = (
        "k int, auc_pr_validacion_medio double, auc_pr_validacion_min double, "
        "auc_pr_validacion_max double, recall_at_k_validacion_medio double"
    )
    return groups.sparkSession.createDataFrame(rows, schema).orderBy(
        F.desc("auc_pr_validacion_medio"), F.desc("recall_at_k_validacion_medio"), "k"
    )
