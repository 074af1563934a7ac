"""Dated procurement rules: regimes, thresholds and expected procedures.

Outputs are references that order cases for review. They are not legal findings.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.functions.text import strip_accents

# --- fixed values -----------------------------------------------------------
NEW_REGIME_FROM = "2025-04-22"
NEW_REGIME, OLD_REGIME = "Ley 32069", "Ley 30225"
WORKS, GOODS_SERVICES = "obras", "bienes_servicios"
THRESHOLDS = {
    2018: {"bienes_servicios": 400_000.0, "obras": 1_800_000.0},
    2019: {"bienes_servicios": 400_000.0, "obras": 1_800_000.0},
    2020: {"bienes_servicios": 400_000.0, "obras": 1_800_000.0},
    2021: {"bienes_servicios": 400_000.0, "obras": 1_800_000.0},
    2022: {"bienes_servicios": 400_000.0, "obras": 2_800_000.0},
    2023: {"bienes_servicios": 480_000.0, "obras": 2_800_000.0},
    2024: {"bienes_servicios": 480_000.0, "obras": 2_800_000.0},
    2025: {"bienes_servicios": 485_000.0, "obras": 5_000_000.0},
    2026: {"bienes_servicios": 485_000.0, "obras": 5_000_000.0},
}
SOURCES = {
    2023: {
        "ley_presupuesto": "Ley N.° 31638 - Presupuesto del Sector Público para el Año Fiscal 2023",
        "url_presupuesto": "https://www.gob.pe/institucion/mef/normas-legales/3715319-31638",
    },
    2024: {
        "ley_presupuesto": "Ley N.° 31953 - Presupuesto del Sector Público para el Año Fiscal 2024",
        "url_presupuesto": "https://www.gob.pe/institucion/mef/normas-legales/6964231-31953",
    },
    2025: {
        "ley_presupuesto": "Ley N.° 32185 - Presupuesto del Sector Público para el Año Fiscal 2025",
        "url_presupuesto": "https://www.gob.pe/institucion/mef/normas-legales/6278077-32185",
        "url_topes": "https://www.gob.pe/77926-montos-para-la-determinacion-de-los-procedimientos-de-seleccion-segun-ley-de-presupuesto-del-sector-publico-para-el-ano-fiscal-2025-ley-32185",
        "ley_regimen": "Ley N.° 32069 - Ley General de Contrataciones Públicas",
        "url_vigencia_regimen": "https://www.gob.pe/institucion/oece/noticias/1153925-oece-inicia-funciones-con-la-entrada-en-vigencia-de-la-nueva-ley-general-de-contrataciones-publicas",
    },
    2026: {
        "ley_presupuesto": "Ley N.° 32513 - Presupuesto del Sector Público para el Año Fiscal 2026",
        "url_presupuesto": "https://www.gob.pe/institucion/mef/normas-legales/7475743-32513",
        "ley_regimen": "Ley N.° 32069 - Ley General de Contrataciones Públicas",
        "url_regimen": "https://www.gob.pe/institucion/oece/colecciones/45029-ley-n-32069-ley-general-de-contrataciones-publicas",
    },
}
WORKS_WORDS = [
    "obra", "construcción", "construccion", "vial", "carretera", "pavimentación",
    "pavimentacion", "rehabilitación vial", "rehabilitacion vial",
]
SPECIAL_MODALITIES = [
    "contratacion directa", "comparacion de precios", "subasta inversa",
    "catalogo electronico", "acuerdo marco", "compra corporativa",
    "dialogo competitivo", "compra publica de innovacion",
]
CATEGORY_WORDS = {
    "obras": ["works", "obra", "obras"],
    "bienes_servicios": [
        "goods", "services", "consultingservices", "consulting services",
        "bienes", "servicios", "consultoria", "consultoría",
    ],
}
TYPE_WORDS = {
    "works": ["works", "obra", "obras"],
    "goods": ["goods", "bien", "bienes"],
    "services": ["services", "servicio", "servicios", "consultingservices", "consulting services"],
}
SIMPLIFIED = "Adjudicación Simplificada"
SHORT_TENDER, SHORT_CONTEST = "Licitación Pública Abreviada", "Concurso Público Abreviado"
SHORT_EITHER = "Licitación/Concurso Público Abreviado"
TENDER, CONTEST, EITHER = "Licitación Pública", "Concurso Público", "Licitación/Concurso Público"
NO_INFORMATION = "sin_informacion"
SPECIAL = "especial_no_inferible_por_cuantia"
NO_AMOUNT = "sin_cuantia_para_comparar"
COMPATIBLE = "compatible_referencial_por_cuantia"
NEEDS_REVIEW = "requiere_revision_contexto"
# ----------------------------------------------------------------------------


def _by_word(raw: Column, words: dict[str, list[str]]) -> Column:
    value = F.lower(F.trim(raw.cast("string")))
    found = [F.when(value.isin(*accepted), F.lit(name)) for name, accepted in words.items()]
    return F.coalesce(*found)


def normalize_category(raw: Column) -> Column:
    """`obras` or `bienes_servicios` from a structured category; null when unknown."""
    return _by_word(raw, CATEGORY_WORDS)


def structured_type(raw: Column) -> Column:
    """`works`, `goods` or `services` from a structured category; null when unknown."""
    return _by_word(raw, TYPE_WORDS)


def is_works(text: Column, category: Column) -> Column:
    """Structured category when known, else whether the text has a works word in it."""
    mentions = F.lower(text.cast("string")).rlike("|".join(WORKS_WORDS))
    return F.coalesce(normalize_category(category) == WORKS, mentions, F.lit(False))


def threshold_category(text: Column, category: Column) -> Column:
    return F.when(is_works(text, category), F.lit(WORKS)).otherwise(F.lit(GOODS_SERVICES))


def regime(date: Column) -> Column:
    in_force = date.cast("timestamp_ntz") >= F.lit(NEW_REGIME_FROM).cast("timestamp_ntz")
    return F.when(in_force, F.lit(NEW_REGIME)).otherwise(F.lit(OLD_REGIME))


def threshold_or_null(date: Column, text: Column, category: Column) -> Column:
    """Threshold amount; null for a year outside the table (see `threshold`)."""
    by_category = {
        name: F.create_map(*[F.lit(x) for year, row in THRESHOLDS.items() for x in (year, row[name])])
        for name in (WORKS, GOODS_SERVICES)
    }
    year = F.year(date)
    return F.when(
        is_works(text, category), F.try_element_at(by_category[WORKS], year)
    ).otherwise(F.try_element_at(by_category[GOODS_SERVICES], year))


def threshold(date: Column, text: Column, category: Column) -> Column:
    """Threshold amount; a year outside the table fails the job, it is never approximated."""
    return F.coalesce(
        threshold_or_null(date, text, category),
        F.raise_error(
            F.concat(F.lit("no threshold for year "), F.coalesce(F.year(date).cast("string"), F.lit("null")))
        ).cast("double"),
    )


def threshold_table(spark: SparkSession) -> DataFrame:
    """The thresholds as a dimension: one row per year and category (18 rows)."""
    rows = [(year, name, amount) for year, row in THRESHOLDS.items() for name, amount in row.items()]
    return spark.createDataFrame(rows, "anio int, categoria_umbral string, umbral double")


def unknown_years(contracts: DataFrame) -> DataFrame:
    """Contract years that have no threshold, with their number of contracts."""
    years = contracts.groupBy(F.year("fecha_contrato").alias("anio")).agg(F.count(F.lit(1)).alias("n_contratos"))
    known = threshold_table(contracts.sparkSession).select("anio").distinct()
    return years.join(F.broadcast(known), "anio", "left_anti")


def require_known_years(contracts: DataFrame) -> None:
    """Stop before use when any contract falls in a year without threshold."""
    unknown = unknown_years(contracts).orderBy("anio").limit(5).collect()
    if unknown:
        raise GateError(f"no threshold for years {[row['anio'] for row in unknown]}")


def threshold_join(contracts: DataFrame) -> DataFrame:
    """Contracts with year, threshold category and the amount joined from the dimension.

    The dimension is the fixed 18-row table, so it is broadcast.
    """
    keyed = contracts.withColumn("anio", F.year("fecha_contrato")).withColumn(
        "categoria_umbral", threshold_category(F.col("objeto"), F.col("categoria_principal"))
    )
    table = threshold_table(contracts.sparkSession)
    return keyed.join(F.broadcast(table), ["anio", "categoria_umbral"], "left")


def _name_below(rules: Column, works: Column, kind: Column) -> Column:
    return (
        F.when(rules == OLD_REGIME, F.lit(SIMPLIFIED))
        .when(works | (kind == "goods"), F.lit(SHORT_TENDER))
        .when(kind == "services", F.lit(SHORT_CONTEST))
        .otherwise(F.lit(SHORT_EITHER))
    )


def _name_above(works: Column, kind: Column) -> Column:
    return (
        F.when(kind == "services", F.lit(CONTEST))
        .when(works | kind.isin("goods", "works"), F.lit(TENDER))
        .otherwise(F.lit(EITHER))
    )


def _expected(amount: Column, limit: Column, below: Column, above: Column) -> Column:
    return F.when(amount.isNotNull(), F.when(amount.cast("double") < limit, below).otherwise(above))


def _accepts(expected: Column, observed: Column) -> Column:
    """Whether a plain observed name fits the expected one; combined names fit either part."""
    names = [SIMPLIFIED, SHORT_TENDER, SHORT_CONTEST, SHORT_EITHER, TENDER, CONTEST, EITHER]
    parts = {SHORT_EITHER: [SHORT_TENDER, SHORT_CONTEST], EITHER: [TENDER, CONTEST]}
    fits = [
        (expected == name) & observed.isin(*[_plain(n) for n in [name, *parts.get(name, [])]]) for name in names
    ]
    return reduce(or_, fits)


def _modality_class(modality: Column, observed: Column, expected: Column) -> Column:
    return (
        F.when(F.coalesce(F.trim(modality.cast("string")), F.lit("")) == "", F.lit(NO_INFORMATION))
        .when(observed.rlike("|".join(SPECIAL_MODALITIES)), F.lit(SPECIAL))
        .when(expected.isNull(), F.lit(NO_AMOUNT))
        .when(_accepts(expected, observed), F.lit(COMPATIBLE))
        .otherwise(F.lit(NEEDS_REVIEW))
    )


def _plain(name: str) -> str:
    """Lower-case name without accents, for names that are fixed values."""
    decomposed = unicodedata.normalize("NFKD", name.strip().lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def procedure_name(date: Column, text: Column, category: Column) -> Column:
    """Procedure expected below the threshold."""
    return _name_below(regime(date), is_works(text, category), structured_type(category))


def procedure_by_amount(date: Column, amount: Column, text: Column, category: Column) -> Column:
    """Procedure expected for an amount on either side of the threshold; null without amount."""
    above = _name_above(is_works(text, category), structured_type(category))
    return _expected(amount, threshold(date, text, category), procedure_name(date, text, category), above)


def classify_modality(
    date: Column, amount: Column, modality: Column, text: Column, category: Column
) -> Column:
    """Observed modality against the reference procedure: one of five classes."""
    expected = procedure_by_amount(date, amount, text, category)
    return _modality_class(modality, strip_accents(modality), expected)


def with_modality_class(contracts: DataFrame) -> DataFrame:
    """Contracts with regime, class of the observed modality and reference procedure.

    The same rules as `classify_modality`, in steps, so that each part is computed once
    per row.
    """
    date, amount, modality, text, category = (
        F.col(c) for c in ("fecha_contrato", "monto", "modalidad", "objeto", "categoria_principal")
    )
    parts = contracts.withColumns(
        {
            "regimen": regime(date),
            "_works": is_works(text, category),
            "_kind": structured_type(category),
            "_limit": threshold(date, text, category),
            "_observed": strip_accents(modality),
        }
    )
    below = _name_below(F.col("regimen"), F.col("_works"), F.col("_kind"))
    above = _name_above(F.col("_works"), F.col("_kind"))
    expected = parts.withColumn(
        "procedimiento_referencial_cuantia", _expected(amount, F.col("_limit"), below, above)
    )
    return expected.withColumn(
        "clasificacion_modalidad",
        _modality_class(modality, F.col("_observed"), F.col("procedimiento_referencial_cuantia")),
    ).drop("_works", "_kind", "_limit", "_observed")


def normative_context(date: Column, text: Column, category: Column) -> Column:
    """Struct with the rules that apply to a row and the sources of its year."""
    no_sources = F.create_map().cast("map<string,string>")
    sources = no_sources
    for year, entries in SOURCES.items():
        listed = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
        sources = F.when(F.year(date) == year, listed).otherwise(sources)
    return F.struct(
        F.year(date).alias("anio"),
        regime(date).alias("regimen"),
        threshold_category(text, category).alias("categoria_umbral"),
        procedure_name(date, text, category).alias("procedimiento_referencial"),
        threshold(date, text, category).alias("umbral"),
        sources.alias("fuentes_normativas"),
    )
