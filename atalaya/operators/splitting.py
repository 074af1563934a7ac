"""Contract splitting: 15-day windows, group features and the readable signal.

Contracts of one group and second are one point. The frame runs over points, in
slices of the time axis that each carry the 15 days after them. A slice has a
bounded number of points however large its group is. Group features need slices
only for groups with more contracts than one task may hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atalaya.errors import ContractError
from atalaya.functions.norms import threshold
from atalaya.functions.text import object_family
from atalaya.operators.skew import crowded_keys, divide, hot_split_join, same_key
from atalaya.runtime import discard, materialize

GROUP = ["id_proveedor", "id_entidad", "objeto_familia"]
# --- fixed values ---------------------------------------------------------------
WINDOW_SECONDS = 15 * 86_400
THRESHOLD_SHARE = 0.95
SIGNAL_CONTRACTS, SIGNAL_SHARE = 3, 0.7
GROUP_FEATURES = [
    "n_contratos_grupo", "max_contratos_ventana_15d", "monto_total_ventana_15d",
    "pct_montos_bajo_umbral", "monto_total_grupo",
]
# --------------------------------------------------------------------------------
_SLICE_SECONDS = 90 * 86_400
#: Texts of a family table that is sent to all tasks at most.
FAMILY_TEXTS = 100_000


def with_family(contracts: DataFrame) -> DataFrame:
    category = F.col("categoria_principal") if "categoria_principal" in contracts.columns else None
    return contracts.withColumn("objeto_familia", object_family(F.col("objeto"), category))


def with_family_of_texts(contracts: DataFrame, most: int = FAMILY_TEXTS) -> DataFrame:
    """The same from a table of the distinct texts, for contracts that are cheap to read: few texts stand for many rows.

    With more than `most` distinct texts the family is made for every row.
    """
    keys = [c for c in ("objeto", "categoria_principal") if c in contracts.columns]
    # Written once: the count and the join read it.
    texts = materialize(with_family(contracts.select(*keys).distinct()), "families")
    if texts.count() > most:
        discard(texts)
        return with_family(contracts)
    of = {c: f"_of_{c}" for c in keys}
    joined = contracts.join(F.broadcast(texts.withColumnsRenamed(of)), same_key(keys, list(of.values())), "left")
    return joined.drop(*of.values())


def with_known_family(contracts: DataFrame) -> DataFrame:
    """Contracts, cheap to read, with the family of their object before missing objects are filled; for `family_after_fill`."""
    return with_family_of_texts(contracts).withColumn("_unnamed", F.col("objeto").isNull())


def family_after_fill(prepared: DataFrame) -> DataFrame:
    """Adds `_family` to contracts of `with_known_family` whose missing objects are filled: a family is made again for those only."""
    category = F.col("categoria_principal") if "categoria_principal" in prepared.columns else None
    family = F.when(F.col("_unnamed"), object_family(F.col("objeto"), category)).otherwise(F.col("objeto_familia"))
    return prepared.withColumn("_family", family).drop("_unnamed", "objeto_familia")


def _seconds(contracts: DataFrame) -> DataFrame:
    return contracts.withColumn("_ts", F.col("fecha_contrato").cast("timestamp").cast("long"))


def window_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds to each point (keys, _ts, n, monto) the totals from its time to 15 days later."""
    keys = list(keys)
    own = F.floor(F.col("_ts") / _SLICE_SECONDS)
    # The first 15 days of a slice also serve the slice before it.
    serves = F.when(
        F.pmod("_ts", F.lit(_SLICE_SECONDS)) < WINDOW_SECONDS, F.array(own, own - 1)
    ).otherwise(F.array(own))
    sliced = points.withColumn("_own", own).withColumn("_slice", F.explode(serves))
    ahead = Window.partitionBy(*keys, "_slice").orderBy("_ts").rangeBetween(0, WINDOW_SECONDS)
    return (
        sliced.withColumn("contratos_ventana_15d", F.sum("n").over(ahead))
        .withColumn("monto_ventana_15d", F.sum("monto").over(ahead))
        .where(F.col("_slice") == F.col("_own"))
        .drop("_own", "_slice")
    )


def _points(contracts: DataFrame, keys: Sequence[str], *measures) -> DataFrame:
    return _seconds(contracts).groupBy(*keys, "_ts").agg(
        F.count("id_contrato").alias("n"), F.sum("monto").alias("monto"), *measures
    )


def window_15d(contracts: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Per contract: number and amount of its group's contracts in the next 15 days, inclusive."""
    keys = list(keys)
    # Written once: the totals and the frequent keys read it.
    points = materialize(_points(contracts, keys, F.count(F.lit(1)).alias("_rows")), "points")
    totals = window_points(points, keys).select(*keys, "_ts", "contratos_ventana_15d", "monto_ventana_15d")
    return hot_split_join(_seconds(contracts), totals, [*keys, "_ts"], points, "_rows").drop("_ts")


def _best(columns: Sequence[str]):
    """The window with most contracts; of several the earliest."""
    return F.min_by(
        F.struct(*[F.col(c) for c in columns]), F.struct(-F.col("contratos_ventana_15d"), F.col("_ts"))
    )


def pick_one_window(contracts: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """One window per group: most contracts, then earliest start; its own amount."""
    points = window_points(_points(contracts, keys), keys)
    best = points.groupBy(*keys).agg(_best(["contratos_ventana_15d", "monto_ventana_15d"]).alias("w"))
    return best.select(
        *keys,
        F.col("w.contratos_ventana_15d").alias("max_contratos_ventana_15d"),
        F.col("w.monto_ventana_15d").alias("monto_total_ventana_15d"),
    )


def _cells(base: DataFrame, label: str | None) -> DataFrame:
    """Contracts of one group, object and second."""
    return base.groupBy(*GROUP, "objeto", "_ts").agg(
        F.count_if("_is_contract").alias("n"), F.sum("monto").alias("monto"), F.sum("_under").alias("_under"),
        F.count("_under").alias("_compared"), F.count("objeto").alias("_named"), *([F.max("label").alias("label")] if label else []),
    )


def _group_measures(label: str | None) -> list:
    return [
        F.sum("n").alias("n_contratos_grupo"),
        F.try_divide(F.sum("_under"), F.sum("_compared")).alias("pct_montos_bajo_umbral"),
        F.sum("monto").alias("monto_total_grupo"),
        _best(["contratos_ventana_15d", "monto_ventana_15d"]).alias("_w"),
        *([F.max("label").alias("label")] if label else []),
    ]


def _representative():
    """The most frequent object, ties to the smallest text."""
    return F.min_by("objeto", F.struct(-F.col("_n"), F.col("objeto"))).alias("objeto")


def _sliced_features(base: DataFrame, label: str | None) -> DataFrame:
    """Measures of groups that may have very many contracts, over slices of the time axis."""
    # Written once: what follows reads the cells for the windows and for the representative objects.
    cells = materialize(_cells(base, label), "cells")
    seconds = cells.groupBy(*GROUP, "_ts").agg(
        *[F.sum(c).alias(c) for c in ("n", "monto", "_under", "_compared")], *([F.max("label").alias("label")] if label else [])
    )
    groups = window_points(seconds, GROUP).groupBy(*GROUP).agg(*_group_measures(label)).where(F.col("n_contratos_grupo") >= 2)
    per_object = cells.groupBy(*GROUP, "objeto").agg(F.sum("_named").alias("_n"))
    return groups.join(per_object.groupBy(*GROUP).agg(_representative()), GROUP, "inner")


def _whole_features(base: DataFrame, label: str | None) -> DataFrame:
    """The same measures from one shuffle that brings all contracts of a group to one task."""
    # Contracts have dates, since one without a threshold fails the job. Most groups have one contract and go before anything is put in order.
    cells = _cells(base.repartition(*GROUP), label)
    kept = cells.withColumn("_of_group", F.sum("n").over(Window.partitionBy(*GROUP))).where(F.col("_of_group") >= 2)
    ahead = Window.partitionBy(*GROUP).orderBy("_ts").rangeBetween(0, WINDOW_SECONDS)
    windows = kept.withColumn("contratos_ventana_15d", F.sum("n").over(ahead)).withColumn("monto_ventana_15d", F.sum("monto").over(ahead))
    named = windows.withColumn("_n", F.sum("_named").over(Window.partitionBy(*GROUP, "objeto")))
    return named.groupBy(*GROUP).agg(*_group_measures(label), _representative())


def frac_features(contracts: DataFrame, *, label: str | None = None, family: str | None = None) -> DataFrame:
    """Features per supplier, entity and object family with at least two contracts.

    Contracts are shuffled once, by group. Groups with more contracts than one task may hold go over slices.
    `family` names the column that holds the family of `objeto`, where it is known.
    """
    needed = {"id_proveedor", "id_entidad", "objeto", "fecha_contrato", "monto", "id_contrato"}
    missing = sorted((needed | ({label} if label else set())) - set(contracts.columns))
    if missing:
        raise ContractError(f"group features need columns {missing}")
    category = F.col("categoria_principal") if "categoria_principal" in contracts.columns else F.lit(None)
    limit = threshold(F.col("fecha_contrato"), F.col("objeto"), category)
    keyed = with_family(contracts) if family is None else contracts.withColumn("objeto_familia", F.col(family))
    base = _seconds(keyed).select(
        *GROUP, "objeto", "_ts", "monto", (F.col("monto") < limit * THRESHOLD_SHARE).cast("bigint").alias("_under"),
        F.col("id_contrato").isNotNull().alias("_is_contract"), *([F.col(label).cast("int").alias("label")] if label else []),
    )
    # A null key is no group. A family is never null, and a condition on it would make it once more for every row.
    base = base.dropna(subset=GROUP[:2])
    # A group is part of a pair and few pairs are crowded, so families are made for the contracts of those only.
    pairs = crowded_keys(contracts, GROUP[:2])
    crowded = None if pairs is None else crowded_keys(divide(base, GROUP[:2], pairs)[0], GROUP)
    if crowded is None:
        measured = _whole_features(base, label)
    else:
        many, few = divide(base, GROUP, crowded)
        measured = _whole_features(few, label).unionByName(_sliced_features(many, label))
    return measured.select(
        *GROUP,
        "objeto",
        "n_contratos_grupo",
        F.col("_w.contratos_ventana_15d").alias("max_contratos_ventana_15d"),
        F.col("_w.monto_ventana_15d").alias("monto_total_ventana_15d"),
        "pct_montos_bajo_umbral",
        "monto_total_grupo",
        *(["label"] if label else []),
    )


def interpretable_signal(groups: DataFrame) -> DataFrame:
    """Marks groups with 3 or more contracts in 15 days, mostly just under the threshold."""
    return groups.withColumn(
        "senal_priorizacion_fraccionamiento",
        (F.col("max_contratos_ventana_15d") >= SIGNAL_CONTRACTS)
        & (F.col("pct_montos_bajo_umbral") >= SIGNAL_SHARE),
    )


def rank_splitting(scored: DataFrame) -> DataFrame:
    """Groups by anomaly score, highest first, ties by key."""
    columns = [
        "id_proveedor", "id_entidad", "objeto", "objeto_familia", "max_contratos_ventana_15d",
        "monto_total_ventana_15d", "pct_montos_bajo_umbral", "score_anomalia",
        "senal_priorizacion_fraccionamiento", *(["label"] if "label" in scored.columns else []),
    ]
    return scored.select(*columns).orderBy(F.desc("score_anomalia"), *GROUP)


def sanity_top_k(scored: DataFrame, numbered: DataFrame) -> DataFrame:
    """Known positives among the best scores and among signalled groups, in one row.

    `numbered` is `scored` with its global `rango` by descending score.
    """
    positive = F.col("label") == 1
    flagged = F.col("senal_priorizacion_fraccionamiento")
    totals = scored.agg(
        F.count(F.lit(1)).alias("n_grupos"),
        F.coalesce(F.sum(F.when(positive, 1)), F.lit(0)).alias("positivos"),
        F.coalesce(F.sum(F.when(flagged, 1)), F.lit(0)).alias("senal_marcados"),
        F.coalesce(F.sum(F.when(flagged & positive, 1)), F.lit(0)).alias("senal_positivos"),
    ).withColumn("_k", F.lit(1))
    known = totals.select("positivos").first()["positivos"]
    hits = numbered.where(F.col("rango") <= known).agg(
        F.coalesce(F.sum(F.when(positive, 1)), F.lit(0)).alias("top_k_aciertos")
    ).withColumn("_k", F.lit(1))
    return totals.join(hits, "_k").drop("_k")
