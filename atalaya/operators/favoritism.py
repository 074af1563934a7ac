"""Supplier-entity pair features and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.errors import ContractError
from atalaya.functions.amounts import modality_flags
from atalaya.operators.skew import crowded_keys, divide

PAIR = ["id_proveedor", "id_entidad"]
# --- fixed values: model inputs, in the order of the feature vector ------------
PAIR_FEATURES = [
    "n_contratos", "monto_total", "monto_promedio", "n_objetos_unicos",
    "pct_contratacion_directa", "pct_comparacion_precios",
    "n_funcionarios_distintos", "dias_actividad", "concentracion_objeto",
    "contratos_por_mes", "monto_por_funcionario",
]
SMALL_PAYMENT_LIMIT = 5000
# --------------------------------------------------------------------------------


_FLAGS = ["es_contratacion_directa", "es_comparacion_precios"]


def _pair_cells(contracts: DataFrame, amount: str, values: list[str], label: str | None = None) -> DataFrame:
    """Partial measures per pair and combination of `values`, so that distinct counts expand few rows."""
    return contracts.groupBy(*PAIR, *values).agg(
        F.count("id_contrato").alias("_contracts"), F.sum(amount).alias("_sum"), F.count(amount).alias("_amounts"),
        *[F.sum(F.col(f).cast("double")).alias(f) for f in _FLAGS], *[F.count(f).alias(f"_of_{f}") for f in _FLAGS],
        F.min("fecha_contrato").alias("_first"), F.max("fecha_contrato").alias("_last"),
        *([F.max(F.col(label).cast("int")).alias("label")] if label else []),
    )


def _pair_measures() -> list:
    ratio = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return [
        F.sum("_contracts").alias("n_contratos"), F.sum("_sum").alias("monto_total"), ratio("_sum", "_amounts").alias("monto_promedio"),
        F.countDistinct("objeto").alias("n_objetos_unicos"),
        *[ratio(f, f"_of_{f}").alias(f.replace("es_", "pct_", 1)) for f in _FLAGS],
        F.min("_first").alias("_first"), F.max("_last").alias("_last"),
    ]


def _activity(pairs: DataFrame) -> DataFrame:
    """Derived columns that all pair tables have."""
    with_days = pairs.withColumn(
        "dias_actividad", F.greatest(F.datediff("_last", "_first"), F.lit(1))
    )
    return with_days.withColumns(
        {
            "concentracion_objeto": 1 - F.col("n_objetos_unicos") / F.col("n_contratos"),
            "contratos_por_mes": F.col("n_contratos") / (F.col("dias_actividad") / 30),
        }
    ).drop("_first", "_last")


def _cell_features(contracts: DataFrame, label: str | None, amount: str) -> DataFrame:
    """Measures of pairs that may have very many contracts: distinct values are combined per (pair, value) first."""
    measures = [*_pair_measures(), F.countDistinct("id_funcionario").alias("n_funcionarios_distintos")]
    if label:
        measures.append(F.max("label").alias("label"))
    return _pair_cells(contracts, amount, ["objeto", "id_funcionario"], label).groupBy(*PAIR).agg(*measures)


def _whole_features(contracts: DataFrame, label: str | None, amount: str) -> DataFrame:
    """The same measures from one shuffle that brings all contracts of a pair to one task."""
    rows = contracts.select(
        # Activity is counted in days, and a day takes fewer bytes of the shuffle than a time.
        *PAIR, "objeto", "id_funcionario", F.to_date("fecha_contrato").alias("_day"), F.col(amount).alias("_amount"), *_FLAGS,
        F.col("id_contrato").isNotNull().alias("_is_contract"), *([F.col(label).cast("int").alias("label")] if label else []),
    )
    distinct = lambda c: F.size(F.collect_set(c)).cast("bigint")
    return rows.repartition(*PAIR).groupBy(*PAIR).agg(
        F.count_if("_is_contract").alias("n_contratos"), F.sum("_amount").alias("monto_total"),
        F.try_divide(F.sum("_amount"), F.count("_amount")).alias("monto_promedio"), distinct("objeto").alias("n_objetos_unicos"),
        *[F.try_divide(F.sum(F.col(f).cast("double")), F.count(f)).alias(f.replace("es_", "pct_", 1)) for f in _FLAGS],
        F.min("_day").alias("_first"), F.max("_day").alias("_last"),
        distinct("id_funcionario").alias("n_funcionarios_distintos"), *([F.max("label").alias("label")] if label else []),
    )


def fav_features(contracts: DataFrame, *, label: str | None = None, amount: str = "monto") -> DataFrame:
    """Features per supplier-entity pair.

    Contracts are shuffled once, by pair. Pairs with more contracts than one task may hold take two more
    shuffles, in which distinct values are combined before they meet at the pair.
    """
    needed = [amount, "es_contratacion_directa", "es_comparacion_precios", *([label] if label else [])]
    missing = [c for c in needed if c not in contracts.columns]
    if missing:
        raise ContractError(f"pair features need columns {missing}")
    crowded = crowded_keys(contracts, PAIR)
    if crowded is None:
        measured = _whole_features(contracts, label, amount)
    else:
        many, few = divide(contracts, PAIR, crowded)
        apart = _cell_features(many, label, amount).withColumns({c: F.to_date(c) for c in ("_first", "_last")})
        measured = _whole_features(few, label, amount).unionByName(apart)
    pairs = _activity(measured)
    per_official = F.col("monto_total") / F.greatest("n_funcionarios_distintos", F.lit(1))
    return pairs.withColumn("monto_por_funcionario", per_official).select(
        *PAIR, *PAIR_FEATURES, *(["label"] if label else [])
    )


def fav_features_real(contracts: DataFrame) -> DataFrame:
    """Reduced features for open data without officials; pairs with at least two contracts."""
    flagged = contracts.withColumns(
        {name: F.coalesce(flag, F.lit(False)) for name, flag in modality_flags(F.col("modalidad")).items()}
    )
    pairs = _pair_cells(flagged, "monto", ["objeto"]).groupBy(*PAIR).agg(*_pair_measures())
    return _activity(pairs.where(F.col("n_contratos") >= 2))


def small_payment_flag(pairs: DataFrame, limit: float = SMALL_PAYMENT_LIMIT) -> DataFrame:
    """Marks pairs whose mean amount is below `limit`."""
    return pairs.withColumn("posible_pago_individual_agrupado", F.col("monto_promedio") < limit)


def rank_favoritism(scored: DataFrame) -> DataFrame:
    """Pairs by probability of the positive class, highest first, ties by key."""
    columns = [
        *PAIR, "n_contratos", "pct_contratacion_directa", "pct_comparacion_precios",
        "score_riesgo_favoritismo", *(["label"] if "label" in scored.columns else []),
    ]
    return scored.select(*columns).orderBy(F.desc("score_riesgo_favoritismo"), *PAIR)
