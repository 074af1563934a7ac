"""Report tables: renamed columns, gates, decimal types and stable views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.operators.quality import order_inversions, require_columns, require_publishable

# --- fixed values: report layouts (column, type) ------------------------------
FAVORITISM = {
    "id_proveedor": "string", "id_entidad": "string", "n_contratos": "int",
    "monto_total": "decimal(20,2)", "pct_contratacion_directa": "decimal(9,8)",
    "pct_comparacion_precios": "decimal(9,8)", "score_riesgo": "decimal(10,9)",
}
SPLITTING = {
    "id_proveedor": "string", "id_entidad": "string", "objeto_familia": "string", "objeto": "string",
    "max_contratos_ventana": "int", "pct_bajo_umbral": "decimal(9,8)",
    "score_anomalia": "decimal(18,10)", "senal_priorizacion": "int",
}
LINKS = {
    "id_proveedor": "string", "id_funcionario": "string", "n_contratos": "int",
    "comparte_telefono": "int", "comparte_direccion": "int",
}
VIEWS = {
    "favoritismo": "vw_reporte_favoritismo",
    "fraccionamiento": "vw_reporte_fraccionamiento",
    "vinculos": "vw_reporte_vinculos",
}
SPLITTING_NAMES = {
    "max_contratos_ventana_15d": "max_contratos_ventana",
    "pct_montos_bajo_umbral": "pct_bajo_umbral",
    "cumple_regla_fraccionamiento": "senal_priorizacion",
    "senal_priorizacion_fraccionamiento": "senal_priorizacion",
}
SPLITTING_TOP = 25
# --------------------------------------------------------------------------------


def _typed(df: DataFrame, layout: dict[str, str], run_at: str) -> DataFrame:
    return df.select(
        *[F.col(c).cast(t).alias(c) for c, t in layout.items()],
        F.lit(run_at).cast("timestamp").alias("fecha_calculo"),
    )


def report_favoritism(ranking: DataFrame, run_at: str) -> DataFrame:
    """Pair report after its gates (one job)."""
    named = ranking.withColumnRenamed("score_riesgo_favoritismo", "score_riesgo")
    require_columns(named, list(FAVORITISM), "favoritism report")
    require_publishable(
        named,
        ["id_proveedor", "id_entidad"],
        ["pct_contratacion_directa", "pct_comparacion_precios", "score_riesgo"],
        ["n_contratos", "monto_total"],
        "favoritism report",
    )
    return _typed(named, FAVORITISM, run_at)


def report_splitting(ranking: DataFrame, run_at: str) -> DataFrame:
    """Group report after its gates; the older name of the flag is accepted too.

    A group is one of an object family; its object is the representative one and may repeat.
    """
    named = ranking.withColumnsRenamed({k: v for k, v in SPLITTING_NAMES.items() if k in ranking.columns})
    require_columns(named, list(SPLITTING), "splitting report")
    require_publishable(
        named,
        ["id_proveedor", "id_entidad", "objeto_familia"],
        ["pct_bajo_umbral"],
        ["max_contratos_ventana"],
        "splitting report",
    )
    return _typed(named.withColumn("senal_priorizacion", F.col("senal_priorizacion").cast("boolean")), SPLITTING, run_at)


def report_links(links: DataFrame, run_at: str) -> DataFrame:
    """Supplier-official report after its gates."""
    named = links.withColumnsRenamed({k: v for k, v in {"src": "id_proveedor", "dst": "id_funcionario"}.items() if k in links.columns})
    require_columns(named, list(LINKS), "link report")
    require_publishable(named, ["id_proveedor", "id_funcionario"], [], ["n_contratos"], "link report")
    flags = {c: F.col(c).cast("boolean") for c in ("comparte_telefono", "comparte_direccion")}
    return _typed(named.withColumns(flags), LINKS, run_at)


def report_views(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Register the stable views; returns their names by report."""
    for name, df in tables.items():
        df.createOrReplaceTempView(VIEWS[name])
    return {name: VIEWS[name] for name in tables}


def report_filter(spark: SparkSession, view: str, score: str, minimum: float) -> DataFrame:
    """Rows of a view with at least `minimum`, best first; the bound is a parameter."""
    if view not in VIEWS.values() or not score.isidentifier():
        raise ValueError(f"unknown view or column: {view!r}, {score!r}")
    return spark.sql(
        f"SELECT * FROM {view} WHERE {score} >= CAST(:minimum AS DOUBLE) ORDER BY {score} DESC",
        args={"minimum": float(minimum)},
    )


def publish_gate_counts(spark: SparkSession, expected: dict[str, int]) -> dict[str, int]:
    """Published rows equal prepared rows, and both report queries keep their order."""
    counts = {name: spark.table(VIEWS[name]).count() for name in expected}
    wrong = {n: (expected[n], counts[n]) for n in expected if expected[n] != counts[n]}
    if wrong:
        raise GateError(f"published rows differ from prepared rows: {wrong}")
    checks = {}
    if "favoritismo" in expected:
        checks["favoritismo"] = (report_filter(spark, VIEWS["favoritismo"], "score_riesgo", 0.5), "score_riesgo")
    if "fraccionamiento" in expected:
        top = spark.table(VIEWS["fraccionamiento"]).orderBy(F.desc("score_anomalia")).limit(SPLITTING_TOP)
        checks["fraccionamiento"] = (top, "score_anomalia")
    for name, (query, score) in checks.items():
        if order_inversions(query, score).first()["inversiones"]:
            raise GateError(f"{name}: the report query lost its descending order")
    return counts
