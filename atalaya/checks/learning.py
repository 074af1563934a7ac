"""Checks of splits, metrics and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.checks.analysis import groups, pairs
from atalaya.checks.foundation import family_sql
from atalaya.checks.proxies import Tables, define
from atalaya.checks.registry import check, rounded
from atalaya.operators import evaluation, favoritism, isolation, models, splitting
from atalaya.operators.fingerprint import group_fingerprint
from atalaya.plans.benchmark import benchmark_job
from atalaya.plans.evaluate import eval_favoritism, eval_splitting
from atalaya.plans.monitor import monitor_batch
from atalaya.plans.score import score_contracts
from atalaya.plans.train import train_candidate
from atalaya.runtime import materialize, new_location

JOINT = evaluation.KEY_JOINT


def _order(keys: str, salt: str) -> str:
    return f"ORDER BY md5(concat_ws('{JOINT}', {keys}, '{salt}')), {keys}"


# --- splits ---------------------------------------------------------------------------------

_PAIR, _FAMILY = "id_proveedor, id_entidad", "id_proveedor, id_entidad, objeto_familia"
define(
    "reparto_pares",
    f"""
    SELECT *, (row_number() OVER (PARTITION BY label {_order(_PAIR, 'holdout-pair')}) - 1) % 4 = 0 AS is_holdout
    FROM (SELECT {_PAIR}, max(label_favoritismo::INT)::BIGINT AS label, count(*) AS n_contratos FROM training GROUP BY ALL)""",
    "training",
)
define(
    "reparto_familias",
    f"""
    SELECT *, (row_number() OVER (PARTITION BY label {_order(_FAMILY, 'holdout-family')}) - 1) % 4 = 0 AS is_holdout
    FROM (SELECT {_FAMILY}, max(label_fraccionamiento::INT)::BIGINT AS label, count(*) AS n_contratos
      FROM (SELECT *, {family_sql('objeto', 'categoria_principal')} AS objeto_familia FROM training) GROUP BY ALL)""",
    "training",
)


def _long_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.col("label").cast("bigint"))


@check(
    "stratified_folds",
    f"""SELECT {_PAIR}, label, (row_number() OVER (PARTITION BY label {_order(_PAIR, 'folds')}) - 1) % 3 AS fold
        FROM reparto_pares""",
    "reparto_pares",
)
def _(t: Tables) -> DataFrame:
    labelled = evaluation.holdout_split_pair(t.training).select(*favoritism.PAIR, "label")
    folded = evaluation.stratified_folds(labelled, 3)
    return _long_label(folded).withColumn("fold", F.col("fold").cast("bigint"))


@check("holdout_split_pair", "SELECT * FROM reparto_pares", "reparto_pares")
def _(t: Tables) -> DataFrame:
    return _long_label(evaluation.holdout_split_pair(t.training))


@check("holdout_split_family", "SELECT * FROM reparto_familias", "reparto_familias")
def _(t: Tables) -> DataFrame:
    return _long_label(evaluation.holdout_split_family(t.training))


@check(
    "validation_split",
    f"""SELECT {_FAMILY}, label, (row_number() OVER (PARTITION BY label {_order(_FAMILY, 'validation-11')}) - 1) % 3 = 0
        AS validacion FROM reparto_familias""",
    "reparto_familias",
)
def _(t: Tables) -> DataFrame:
    assigned = evaluation.holdout_split_family(t.training).select(*splitting.GROUP, "label")
    fit_rows, check_rows = evaluation.validation_split(assigned, 11)
    both = fit_rows.withColumn("validacion", F.lit(False)).unionByName(check_rows.withColumn("validacion", F.lit(True)))
    return _long_label(both)


@check(
    "split_assignment_join",
    f"SELECT id_contrato, is_holdout FROM training JOIN reparto_pares USING ({_PAIR})",
    "training reparto_pares",
)
def _(t: Tables) -> DataFrame:
    development, holdout = evaluation.split_assignment_join(t.training, evaluation.holdout_split_pair(t.training))
    return development.select("id_contrato", F.lit(False).alias("is_holdout")).unionByName(
        holdout.select("id_contrato", F.lit(True).alias("is_holdout"))
    )


@check(
    "disjoint_split_check",
    f"""SELECT count(*) AS n_compartidos FROM (SELECT {_PAIR} FROM reparto_pares WHERE is_holdout
        INTERSECT SELECT {_PAIR} FROM reparto_pares WHERE NOT is_holdout)""",
    "reparto_pares",
)
def _(t: Tables) -> DataFrame:
    sides = evaluation.split_assignment_join(t.training, evaluation.holdout_split_pair(t.training))
    return evaluation.disjoint_split_check(*sides)


@check(
    "union_train_batch",
    """SELECT label_favoritismo, count(*) AS n, sum(monto) AS monto FROM
       (SELECT * FROM training UNION ALL SELECT * FROM training WHERE fecha_contrato >= TIMESTAMP '2026-01-01') GROUP BY ALL""",
    "training",
)
def _(t: Tables) -> DataFrame:
    batch = t.training.where(F.col("fecha_contrato") >= "2026-01-01")
    union = evaluation.union_train_batch(t.training, batch)
    return union.groupBy("label_favoritismo").agg(F.count(F.lit(1)).alias("n"), F.sum("monto").alias("monto"))


# --- metrics over scored line items ------------------------------------------------------------

define(
    "puntuados",
    """SELECT id_contrato AS id, coalesce(modalidad = 'Contratación Directa', false)::INT::BIGINT AS label,
       floor(coalesce(monto, 0) / 1000) / 1100 AS score FROM contracts""",
    "contracts",
)
define(
    "previstos",
    """SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS rango,
       (row_number() OVER (ORDER BY score DESC, id) <= (SELECT sum(label) FROM puntuados))::INT::BIGINT AS pred
       FROM puntuados""",
    "puntuados",
)


def scored(t: Tables) -> DataFrame:
    return t.contracts.select(
        F.col("id_contrato").alias("id"),
        F.coalesce(F.col("modalidad") == "Contratación Directa", F.lit(False)).cast("bigint").alias("label"),
        (F.floor(F.coalesce("monto", F.lit(0.0)) / 1000) / F.lit(1100)).alias("score"),
    )


def _confusion_sql(view: str, pred: str) -> str:
    return f"""
    SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall,
      2 * tp / greatest(2 * tp + fp + fn, 1) AS f1, (tp + tn) / n AS accuracy
    FROM (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positivos,
      count(*) FILTER (WHERE label = 1 AND {pred}) AS tp, count(*) FILTER (WHERE label = 0 AND {pred}) AS fp,
      count(*) FILTER (WHERE label = 0 AND NOT {pred}) AS tn, count(*) FILTER (WHERE label = 1 AND NOT {pred}) AS fn
      FROM {view})"""


@check("confusion_counts", _confusion_sql("previstos", "pred = 1"), "previstos")
def _(t: Tables) -> DataFrame:
    return evaluation.confusion_counts(evaluation.rank_predictions(scored(t)))


@check("threshold_metrics", _confusion_sql("puntuados", "score >= 0.5"), "puntuados")
def _(t: Tables) -> DataFrame:
    return evaluation.threshold_metrics(scored(t))


@check("rank_predictions", "SELECT * FROM previstos", "previstos")
def _(t: Tables) -> DataFrame:
    ranked = evaluation.rank_predictions(scored(t))
    return ranked.withColumn("pred", F.col("pred").cast("bigint"))


@check(
    "recall_at_k",
    """SELECT CAST(sum(label * pred) AS BIGINT) AS hits, CAST(sum(label) AS BIGINT) AS k,
       sum(label * pred) / sum(label) AS recall_at_k FROM previstos""",
    "previstos",
)
def _(t: Tables) -> DataFrame:
    return evaluation.recall_at_k(scored(t))


@check(
    "auc_metrics",
    """
    , g AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS q FROM puntuados GROUP BY score),
    c AS (SELECT *, sum(p) OVER () AS tp, sum(q) OVER () AS tq,
        coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q_bajo,
        coalesce(sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p_alto,
        coalesce(sum(q) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q_alto FROM g)
    SELECT CAST(max(tp) AS BIGINT) AS positivos, CAST(max(tq) AS BIGINT) AS negativos,
      round(sum(p * (q_bajo + q / 2)) / (max(tp) * max(tq)), 6) AS auc_roc,
      round(sum(p / tp * ((p_alto + p) / (p_alto + p + q_alto + q)
        + CASE WHEN p_alto + q_alto > 0 THEN p_alto / (p_alto + q_alto) ELSE p / (p + q) END) / 2), 6) AS auc_pr
    FROM c""",
    "puntuados",
)
def _(t: Tables) -> DataFrame:
    return rounded(evaluation.auc_metrics(scored(t)), 6, "auc_roc", "auc_pr")


@check(
    "class_weights",
    """SELECT label, count(*) AS n, (SELECT count(*) FROM pares) / (2 * count(*)) AS peso FROM pares GROUP BY label""",
    "pares",
)
def _(t: Tables) -> DataFrame:
    return models.class_weights(pairs(t)).groupBy("label", "peso").agg(F.count(F.lit(1)).alias("n"))


_CENTER = splitting.GROUP_FEATURES


define(
    "centros",
    f"""SELECT (max_contratos_ventana_15d > 1)::INT AS cluster, {', '.join(f'avg({x}) AS m{i}' for i, x in enumerate(_CENTER))}
        FROM grupos GROUP BY 1""",
    "grupos",
)
_DISTANCE_SQL = f"""SELECT {_FAMILY}, label, round(sqrt({' + '.join(f'pow({x} - m{i}, 2)' for i, x in enumerate(_CENTER))}), 3)
    AS score_anomalia FROM grupos JOIN centros ON (max_contratos_ventana_15d > 1)::INT = cluster"""


def _distances(t: Tables) -> DataFrame:
    """Groups with their distance to the mean of the bursts or of the rest."""
    # Written once: the means and the distances read it.
    clustered = materialize(groups(t.written()), "groups").withColumn("cluster", (F.col("max_contratos_ventana_15d") > 1).cast("int"))
    means = clustered.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in _CENTER]).orderBy("cluster")
    centers = [[r[c] for c in _CENTER] for r in means.collect()]
    vectors = clustered.withColumn("features", array_to_vector(F.array(*[F.col(c).cast("double") for c in _CENTER])))
    found = models.centroid_distance(vectors, centers).select(*splitting.GROUP, "label", "score_anomalia")
    return rounded(found, 3, "score_anomalia")


@check("centroid_distance", f"SELECT {_FAMILY}, score_anomalia FROM ({_DISTANCE_SQL})", "grupos centros")
def _(t: Tables) -> DataFrame:
    return _distances(t).drop("label")


def _by_amount(t: Tables) -> DataFrame:
    """Groups scored by a plain feature, so that SQL can rank them too."""
    # Written once: counts, ranks and hits read it.
    signalled = splitting.interpretable_signal(materialize(groups(t.written()), "groups"))
    return signalled.withColumn("score_anomalia", F.col("monto_total_grupo")).withColumn(
        "id", evaluation.group_id(splitting.GROUP)
    )


@check(
    "sanity_top_k",
    f"""
    , r AS (SELECT *, max_contratos_ventana_15d >= 3 AND pct_montos_bajo_umbral >= 0.7 AS senal,
      row_number() OVER (ORDER BY monto_total_grupo DESC, concat_ws('{JOINT}', {_FAMILY})) AS rango FROM grupos)
    SELECT count(*) AS n_grupos, CAST(sum(label) AS BIGINT) AS positivos, count(*) FILTER (WHERE senal) AS senal_marcados,
      count(*) FILTER (WHERE senal AND label = 1) AS senal_positivos,
      count(*) FILTER (WHERE label = 1 AND rango <= (SELECT sum(label) FROM grupos)) AS top_k_aciertos FROM r""",
    "grupos",
)
def _(t: Tables) -> DataFrame:
    found = _by_amount(t)
    numbered = evaluation.numbered_by_score(found, "score_anomalia", "id")
    return splitting.sanity_top_k(found, numbered)


@check(
    "contamination_cut",
    f"""
    , distancias AS ({_DISTANCE_SQL}),
    corte AS (SELECT quantile_cont(score_anomalia, 0.95) AS x FROM distancias),
    marcados AS (SELECT label, score_anomalia > x AS pred FROM distancias, corte)
    {_confusion_sql('marcados', 'pred')}""",
    "grupos centros",
)
def _(t: Tables) -> DataFrame:
    marked = isolation.contamination_cut(_distances(t), 0.05, "score_anomalia")
    return evaluation.confusion_counts(marked)


@check("choose_contamination")
def _(t: Tables) -> DataFrame:
    rows = materialize(groups(t.written()), "groups")
    scored = []
    for seed in models.VALIDATION_SEEDS:
        fit_rows, check_rows = (materialize(part, "validation") for part in evaluation.validation_split(rows, seed))
        forest = isolation.isolation_train(fit_rows, splitting.GROUP_FEATURES, splitting.GROUP, trees=100, seed=seed)
        found = isolation.isolation_score(check_rows, splitting.GROUP_FEATURES, forest)
        scored.append(materialize(found.select("label", F.col("score_aislamiento").alias("score")), "scored"))
    return isolation.choose_contamination(scored)


@check("group_fingerprint")
def _(t: Tables) -> DataFrame:
    return group_fingerprint(t.contracts)


# --- models: their fits are checked by rows and by the bounds in the tests -----------------------


@check("rf_train")
def _(t: Tables) -> DataFrame:
    rows = materialize(pairs(t.written()), "pairs")
    model = models.rf_train(rows, 100, 3)
    return models.score_pairs(rows, model).select(*favoritism.PAIR, "label", "score_riesgo_favoritismo")


@check("rf_importances")
def _(t: Tables) -> DataFrame:
    return models.rf_importances(t.spark, models.rf_train(materialize(pairs(t.written()), "pairs"), 100, 3))


@check("rf_tune")
def _(t: Tables) -> DataFrame:
    return models.rf_tune(materialize(pairs(t.written()), "pairs"))[1]


@check("compare_classifiers")
def _(t: Tables) -> DataFrame:
    return models.compare_classifiers(materialize(pairs(t.written()), "pairs"))


@check("rank_favoritism")
def _(t: Tables) -> DataFrame:
    rows = materialize(pairs(t.written()), "pairs")
    return favoritism.rank_favoritism(models.score_pairs(rows, models.rf_train(rows, 100, 3)))


@check("kmeans_train")
def _(t: Tables) -> DataFrame:
    model, _scaler = models.kmeans_train(materialize(groups(t.written()), "groups"), 3)
    rows = [(i, *[float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    return t.spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{c} double" for c in splitting.GROUP_FEATURES))


@check("kmeans_tune")
def _(t: Tables) -> DataFrame:
    return models.kmeans_tune(materialize(groups(t.written()), "groups"))


@check("score_groups")
def _(t: Tables) -> DataFrame:
    rows = materialize(splitting.interpretable_signal(groups(t.written())), "groups")
    return models.score_groups(rows, *models.kmeans_train(rows, 3))


@check("rank_splitting")
def _(t: Tables) -> DataFrame:
    rows = materialize(splitting.interpretable_signal(groups(t.written())), "groups")
    return splitting.rank_splitting(models.score_groups(rows, *models.kmeans_train(rows, 3)))


@check("isolation_forest")
def _(t: Tables) -> DataFrame:
    return isolation.isolation_forest(materialize(favoritism.fav_features_real(t.contracts), "pairs"))


@check("ranking_param_grid")
def _(t: Tables) -> DataFrame:
    return isolation.ranking_param_grid(materialize(groups(t.written()), "groups"))


def _table(t: Tables, report: dict) -> DataFrame:
    numbers = {**report["metricas_holdout_final"], **{k: report[k] for k in ("n_desarrollo", "n_holdout")}}
    return t.spark.createDataFrame([(k, float(v)) for k, v in numbers.items()], "metrica string, valor double")


@check("eval_favoritism")
def _(t: Tables) -> DataFrame:
    return _table(t, eval_favoritism(t.written().training))


@check("eval_splitting")
def _(t: Tables) -> DataFrame:
    return _table(t, eval_splitting(t.written().training))


def _candidate(t: Tables, training: DataFrame | None = None) -> str:
    folder = new_location(t.spark, "candidate")
    train_candidate(t.training if training is None else training, folder, inherited={"numTrees": 100, "maxDepth": 3, "k": 3, "champion": "none"})
    return folder


@check("train_candidate")
def _(t: Tables) -> DataFrame:
    from atalaya.plans.train import MANIFEST
    from atalaya.sources.sinks import read_json

    training = read_json(t.spark, f"{_candidate(t.written())}/{MANIFEST}")["training"]
    rows = [(k, float(training[k])) for k in sorted(training) if k.endswith(("_rows", "_positives"))]
    return t.spark.createDataFrame(rows, "medida string, valor double")


@check("score_pairs")
def _(t: Tables) -> DataFrame:
    t = t.written()
    return score_contracts(t.contracts, _candidate(t))[0]


@check("drift_report_groups")
def _(t: Tables) -> DataFrame:
    t = t.written()
    early = F.col("fecha_contrato") < "2024-01-01"
    report, _decision = monitor_batch(t.training.where(~early), _candidate(t, t.training.where(early)), "despues")
    return report


@check("monitor_batch")
def _(t: Tables) -> DataFrame:
    t = t.written()
    early = F.col("fecha_contrato") < "2024-01-01"
    _report, decision = monitor_batch(t.training.where(~early), _candidate(t, t.training.where(early)), "despues")
    return decision


@check("benchmark_job")
def _(t: Tables) -> DataFrame:
    t = t.written()
    return benchmark_job(t.spark, lambda: (t.contracts, t.contracts.count()))
