"""Star query over the fact table and its dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_left_join(
    facts: DataFrame, suppliers: DataFrame, entities: DataFrame, officials: DataFrame
) -> DataFrame:
    """Filtered facts with supplier and entity names; facts without a dimension row stay.

    Callers filter the facts first. Small dimensions are broadcast by the optimizer,
    larger ones are shuffled, with hot keys split at run time.
    """
    kept = facts.where(F.col("id_entidad").isNotNull())
    return (
        kept.join(suppliers.select("id_proveedor", F.col("nombre_proveedor").alias("razon_social")), "id_proveedor", "left")
        .join(entities.select("id_entidad", "nombre_entidad"), "id_entidad", "left")
        .join(officials.select("id_funcionario", "nombre_funcionario"), "id_funcionario", "left")
        .select(
            "id_contrato", "id_proveedor", "id_entidad", "monto", "modalidad",
            "razon_social", "nombre_entidad", "nombre_funcionario",
        )
    )


def orphan_left_vs_inner(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of a left and of an inner join with the same dimension, as one row of counts."""
    known = dimension.select(key).distinct().withColumn("_known", F.lit(True))
    joined = facts.select(key).join(known, key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("filas_left"),
        F.count("_known").alias("filas_inner"),
    )
