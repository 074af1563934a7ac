import hashlib

import pytest

from atalaya.errors import ContractError, GateError
from atalaya.operators import opendata

MAIN = "ocid string, buyer_id string, tender_procurementMethodDetails string, tender_mainProcurementCategory string"
CONTRACTS = "main_ocid string, id string, awardID string, value_amount double, dateSigned string, description string"
SUPPLIERS = "main_ocid string, awards_id string, id string, name string"


@pytest.fixture
def build(spark):
    def make(contracts, awards, suppliers, main=(("OC1", "B1", "m", "goods"), ("OC2", "B1", "m", "goods"))):
        return opendata.ocds_contract_award_supplier(
            spark.createDataFrame(list(main), MAIN),
            spark.createDataFrame([(o, i, a, 10.0, "2024-01-01", "cemento") for o, i, a in contracts], CONTRACTS),
            spark.createDataFrame(awards, "main_ocid string, id string"),
            spark.createDataFrame(suppliers, SUPPLIERS),
        )

    return make


def test_each_contract_takes_the_supplier_of_its_award(build):
    found = build(
        [("OC1", "1", "A1"), ("OC1", "2", "A2")], [("OC1", "A1"), ("OC1", "A2"), ("OC1", "A2")],
        [("OC1", "A1", "P1", "Uno"), ("OC1", "A2", "P2", "Dos")],
    )
    assert {r["id_contrato"]: r["id_proveedor"] for r in found.collect()} == {"OC1::1": "P1", "OC1::2": "P2"}
    assert found.first()["objeto"] == "Materiales de construcción"


def test_consortium_under_one_id(build):
    row = build([("OC1", "1", "A1")], [("OC1", "A1")], [("OC1", "A1", "P1", "CONSORCIO SUR")]).first()
    assert (row["id_proveedor"], row["es_consorcio"], row["n_integrantes_consorcio"]) == ("P1", True, None)


def test_several_suppliers_of_one_award(build):
    row = build([("OC1", "1", "A1")], [("OC1", "A1")], [("OC1", "A1", "P2", "b"), ("OC1", "A1", "P1", "a"), ("OC1", "A1", "P1", "a")]).first()
    assert row["id_proveedor"] == "MULTISUPPLIER:" + hashlib.sha256(b"P1|P2").hexdigest()[:16]
    assert (row["n_integrantes_consorcio"], row["integrantes_consorcio"]) == (2, "P1;P2")
    assert row["razon_social_adjudicada"] == "a / b" and row["es_consorcio"]


def test_ids_are_unique_across_processes_and_unresolved_awards_drop(build):
    found = build(
        [("OC1", "1", "A1"), ("OC2", "1", "A1"), ("OC2", "2", "A9"), ("OC2", "3", None)],
        [("OC1", "A1"), ("OC2", "A1"), ("OC2", "A9")],
        [("OC1", "A1", "P1", "x"), ("OC2", "A1", "P2", "y")],
    )
    counts = opendata.unresolved_counts(found).first()
    assert (counts["contratos"], counts["sin_adjudicacion"], counts["sin_proveedor"]) == (4, 1, 2)
    valid = opendata.ocds_valid_contracts(found)
    assert sorted(r["id_contrato"] for r in valid.collect()) == ["OC1::1", "OC2::1"]


def test_missing_columns_and_uniqueness_gate(spark):
    with pytest.raises(ContractError, match="awards_id"):
        opendata.award_supplier_identity(spark.createDataFrame([("a", "b")], "main_ocid string, id string"))
    with pytest.raises(GateError, match="not unique"):
        opendata.require_unique(spark.createDataFrame([("a",), ("a",)], "id string"), ["id"], "parties")


def test_catalogues(spark):
    parties = spark.createDataFrame(
        [("B1", "Muni", "['procuringEntity']"), ("B1", "Muni", "buyer"), ("P1", "Uno", "supplier"), ("B2", "X", "buyers")],
        "id string, name string, roles string",
    )
    entities = opendata.buyer_entities(parties).collect()
    assert [r["id_entidad"] for r in entities] == ["B1"] and entities[0]["telefono"] is None
    awarded = spark.createDataFrame([("P1", "Uno"), ("P9", "Consorcio Norte"), (None, "z")], "id string, name string")
    found = {r["id_proveedor"]: r for r in opendata.supplier_enrichment(parties, awarded).collect()}
    assert set(found) == {"P1", "P9"} and found["P9"]["es_consorcio"] and found["P9"]["ruc"] is None


def test_org_links_ignore_padding_and_nulls(spark, contracts):
    suppliers = spark.createDataFrame([("P1", " 1 ", None)], "id_proveedor string, telefono string, direccion string")
    entities = spark.createDataFrame([("E1", "1", None)], "id_entidad string, telefono string, direccion string")
    row = opendata.org_link_join(contracts([{}, {}]), suppliers, entities).first()
    assert row["comparte_telefono"] and not row["comparte_direccion"] and row["senal_organizacional"]
    assert row["n_contratos"] == 2


def test_a_chosen_row_is_shuffled_once(spark):
    """A row lies in its rank; carried beside it too, it would take twice the bytes."""
    rows = [("a", None, 2.0, "x"), ("a", "m", None, "y"), ("a", "m", 1.0, "z"), ("b", None, None, None), ("b", None, None, None), (None, "n", 3.0, "w")]
    df = spark.createDataFrame(rows, "k string, s string, v double, t string")
    assert sorted(map(tuple, opendata.dedupe_first(df, ["k"]).collect()), key=repr) == sorted([("a", "m", 1.0, "z"), ("b", None, None, None), (None, "n", 3.0, "w")], key=repr)
    assert ("a", None, 2.0, "x") in map(tuple, opendata.dedupe_first(df, ["k"], ["t"]).collect())
    assert ("a", "m", 1.0, "z") in map(tuple, opendata.dedupe_first(df, ["k"], ["v", "k"]).collect())
    shuffled = [line for line in opendata.dedupe_first(df, ["k"])._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_" in line]
    assert shuffled and all("min_by" not in line for line in shuffled)
