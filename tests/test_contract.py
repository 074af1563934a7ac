import pytest

from atalaya.errors import ContractError, GateError
from atalaya.operators.contract import DOMAINS, cast_canonical, map_canonical, required_columns, validate
from atalaya.operators.quality import gate_domain, gate_relations, pk_unique, quality_report
from atalaya.plans.config import check_config
from atalaya.plans.integrate import integrate_domains
from atalaya.sources.readers import scan_csv_text

PHYSICAL = "NRO_CONTRATO string, COD_PROV string, SEC_EJEC string, IMP_ADJ string, FEC_SUSC string, TIP_PROC string, DESC_OBJ string, CAT_PRINC string, GT_FAV string, GT_FRAC string"
MAPPING = {
    "id_contrato": "NRO_CONTRATO", "id_proveedor": "COD_PROV", "id_entidad": "SEC_EJEC", "monto": "IMP_ADJ",
    "fecha_contrato": "FEC_SUSC", "modalidad": "TIP_PROC", "objeto": "DESC_OBJ", "categoria_principal": "CAT_PRINC",
}
ROWS = [
    ("C1", "000123", "E1", "100.5", "2024-01-01", "Licitación Pública", "cemento", "goods", "1", "0"),
    ("C2", "000124", "E1", None, "2024-02-01", None, None, None, "0", "1"),
]


@pytest.fixture
def physical(spark):
    return spark.createDataFrame(ROWS, PHYSICAL)


def test_domains_have_the_expected_shape():
    assert {d: len(s) for d, s in DOMAINS.items()} == {
        "contracts": 12, "suppliers": 3, "entities": 2, "officials": 5, "payments": 8,
    }
    assert "label_favoritismo" not in required_columns("contracts", "inference")
    assert "label_favoritismo" in required_columns("contracts", "training", without_nulls=True)


def test_mapping_keeps_text_ids_and_drops_the_rest(physical):
    rows = map_canonical(physical, "contracts", MAPPING).collect()
    assert rows[0]["id_proveedor"] == "000123"
    assert list(rows[0].asDict()) == list(MAPPING)


@pytest.mark.parametrize(
    "mapping, problem",
    [
        ({}, "empty"),
        ({"inventado": "COD_PROV"}, "unknown canonical"),
        ({"id_proveedor": "COD_PROV", "id_entidad": "COD_PROV"}, "more than once"),
        ({"id_proveedor": "NO_ESTA"}, "absent"),
    ],
)
def test_mapping_errors(physical, mapping, problem):
    with pytest.raises(ContractError, match=problem):
        map_canonical(physical, "contracts", mapping)


def test_imputable_nulls_pass_but_a_missing_column_fails(physical):
    typed = validate(map_canonical(physical, "contracts", MAPPING), "contracts")
    assert typed.where("monto is null").count() == 1
    without = {k: v for k, v in MAPPING.items() if k != "categoria_principal"}
    with pytest.raises(ContractError, match="categoria_principal"):
        cast_canonical(map_canonical(physical, "contracts", without), "contracts")


def test_invalid_number_names_its_column(spark):
    rows = spark.createDataFrame([("C1", "P", "E", "NO_ES_NUMERO", "2024-01-01", "m", "o", "c", "1", "0")], PHYSICAL)
    with pytest.raises(ContractError, match="monto"):
        validate(map_canonical(rows, "contracts", MAPPING), "contracts")


def test_boolean_labels_in_training(physical):
    mapping = {**MAPPING, "label_favoritismo": "GT_FAV", "label_fraccionamiento": "GT_FRAC"}
    typed = validate(map_canonical(physical, "contracts", mapping), "contracts", "training")
    assert typed.schema["label_favoritismo"].dataType.typeName() == "boolean"
    assert typed.where("label_favoritismo").count() == typed.where("label_fraccionamiento").count() == 1


def test_unknown_domain_mode_and_column(physical):
    with pytest.raises(ContractError):
        map_canonical(physical, "nada", MAPPING)
    with pytest.raises(ContractError):
        cast_canonical(map_canonical(physical, "contracts", MAPPING), "contracts", "otro")
    with pytest.raises(ContractError, match="outside the contract"):
        extra = map_canonical(physical, "contracts", MAPPING).selectExpr("*", "1 as sobra")
        cast_canonical(extra, "contracts")


def _datasets(spark):
    return {
        "contracts": spark.createDataFrame(
            [("C1", "P1", "E1", "F1", 10.0), ("C2", "P2", "E1", None, 20.0)],
            "id_contrato string, id_proveedor string, id_entidad string, id_funcionario string, monto double",
        ),
        "suppliers": spark.createDataFrame([("P1",), ("P2",)], "id_proveedor string"),
        "entities": spark.createDataFrame([("E1",)], "id_entidad string"),
        "officials": spark.createDataFrame([("F1",), ("F2",)], "id_funcionario string"),
        "payments": spark.createDataFrame([("G1", "C1"), ("G2", "C2")], "id_pago string, id_contrato string"),
    }


def test_clean_relations(spark):
    outcome = gate_relations(_datasets(spark))
    assert len(outcome) == 4 and {o["status"] for o in outcome.values()} == {"ok"}
    report = quality_report(_datasets(spark))
    assert {r["estado"] for r in report.collect()} == {"ok"}


def test_orphans_and_skipped_parent(spark):
    datasets = _datasets(spark)
    del datasets["officials"]
    skipped = gate_relations(datasets)["contracts.id_funcionario->officials.id_funcionario"]
    assert skipped["status"] == "skipped_parent_not_configured"
    datasets["suppliers"] = spark.createDataFrame([("P1",)], "id_proveedor string")
    with pytest.raises(GateError, match="P2"):
        gate_relations(datasets)


@pytest.mark.parametrize(
    "rows, problem",
    [
        ([("C1", "P", "E", "1"), ("C1", "P", "E", "2")], "duplicated"),
        ([("C1", "   ", "E", "1"), ("C2", "P", "E", "2")], "blank"),
        ([("C1", "P", "E", "-10"), ("C2", "P", "E", "2")], "negative"),
    ],
)
def test_domain_gates(spark, rows, problem):
    frame = spark.createDataFrame(rows, "id_contrato string, id_proveedor string, id_entidad string, monto string")
    full = frame.selectExpr(
        "*", "'2024-01-01' as fecha_contrato", "'m' as modalidad", "'o' as objeto", "'c' as categoria_principal"
    )
    with pytest.raises((GateError, ContractError), match=problem):
        gate_domain(cast_canonical(full, "contracts"))


def test_pk_metrics_report_both_counts(spark):
    row = pk_unique(spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "k string"), ["k"]).first()
    assert (row["filas"], row["claves_distintas"], row["claves_duplicadas"]) == (5, 2, 1)
    assert (row["filas_afectadas"], row["filas_excedentes"]) == (3, 3)


def test_empty_domain_has_zero_counts(spark):
    row = pk_unique(spark.createDataFrame([], "k string"), ["k"]).first()
    assert row["filas"] == row["filas_excedentes"] == 0


def test_integration_from_csv(spark, tmp_path):
    folder = tmp_path / "origen"
    spark.createDataFrame(ROWS, PHYSICAL).write.option("header", True).csv(str(folder))
    config = {
        "mode": "inference",
        "source": {"type": "local_csv", "datasets": {"contracts": str(folder)}},
        "mapping": {"contracts": MAPPING},
    }
    datasets, summary = integrate_domains(config, spark, str(tmp_path / "salida"))
    assert summary["domains"]["contracts"]["rows"] == 2 and "payments" in summary["skipped"]
    assert {r["id_proveedor"] for r in datasets["contracts"].collect()} == {"000123", "000124"}
    assert scan_csv_text(spark, str(tmp_path / "salida" / "contracts")).count() == 2
    assert (tmp_path / "salida" / "integration_manifest.json").exists()


@pytest.mark.parametrize(
    "change",
    [
        {"contract_schema_version": 2},
        {"mode": "otro"},
        {"source": {"type": "nube"}},
        {"source": {"type": "spark_sql", "tables": {}}},
        {"mapping": {}},
        {"mapping": {"contracts": {"id_contrato": "a"}}},
        {"mapping": {"contracts": MAPPING, "payments": {"id_pago": "a", "id_contrato": "b"}}},
    ],
)
def test_bad_configurations(change):
    config = {
        "source": {"type": "spark_sql", "tables": {"contracts": "t"}},
        "mapping": {"contracts": MAPPING},
    }
    check_config(config)
    with pytest.raises(ContractError):
        check_config({**config, **change})
