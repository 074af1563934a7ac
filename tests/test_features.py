import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from atalaya.errors import ContractError
from atalaya.operators import explore, favoritism, payments, splitting
from atalaya.operators import preprocessing as prep


@pytest.fixture
def train(contracts):
    return contracts([
        {"monto": 100.0, "objeto": "A"}, {"monto": 200.0, "objeto": "A"},
        {"monto": 300.0, "objeto": "B", "modalidad": "Contratación Directa"},
        {"monto": None, "objeto": "B"},
    ])


@pytest.mark.parametrize("external", [False, True])
def test_frozen_state_is_reused(contracts, train, tmp_path, external, spark):
    path = str(tmp_path / "m") if external else None
    state = prep.fit_preprocessor(train, medians_path=path)
    medians = spark.read.parquet(path) if external else None
    batch = contracts([
        {"monto": None, "objeto": "nuevo", "modalidad": None, "id_funcionario": None},
        {"monto": 9_999_999.0, "objeto": "A"},
        {"monto": None, "objeto": "A"},
        {"monto": 117_888.71, "objeto": None},
    ])
    rows = {r["id_contrato"]: r for r in prep.apply_preprocessor(batch, state, medians).collect()}
    assert rows["C0"]["monto"] == state["monto_mediana_global"] == 250.0
    assert rows["C0"]["modalidad"] == "Licitación Pública" and rows["C0"]["id_funcionario"] == "__NO_DISPONIBLE__"
    assert rows["C1"]["monto"] == 9_999_999.0 and rows["C1"]["monto_capped"] == state["monto_p99"]
    assert rows["C2"]["monto"] == 150.0
    # An observed amount stays although its object is missing.
    assert rows["C3"]["monto"] == 117_888.71 and rows["C3"]["objeto"] == "A"
    assert state["objeto_moda"] == "A" and state["object_medians_count"] == 2


def test_state_errors(train, contracts):
    state = prep.fit_preprocessor(train)
    with pytest.raises(ContractError, match="version"):
        prep.apply_preprocessor(train, {**state, "schema_version": 2})
    with pytest.raises(ContractError, match="table"):
        prep.apply_preprocessor(train, {**state, "monto_mediana_por_objeto_location": None})
    with pytest.raises(ContractError, match="valid amount"):
        prep.fit_preprocessor(contracts([{"monto": None}]))
    with pytest.raises(ContractError, match="modalidad"):
        prep.fit_preprocessor(contracts([{"modalidad": None}]))


def test_shuffled_medians_equal_broadcast_ones(contracts):
    rows = contracts([{"monto": None if i % 3 else float(i), "objeto": None if i % 7 == 0 else f"o{i % 5}"} for i in range(60)])
    medians = prep.object_medians(rows)
    both = [
        {r["id_contrato"]: r["mediana_objeto"] for r in prep.join_medians(rows, medians.hint(how)).collect()}
        for how in ("broadcast", "merge")
    ]
    assert both[0] == both[1] and len(both[0]) == 60


def test_capped_and_raw_amounts(contracts):
    rows = contracts([{"monto": 100.0}, {"monto": 1000.0}]).withColumn("monto_capped", F.least("monto", F.lit(200.0)))
    rows = rows.withColumns({"es_contratacion_directa": F.lit(False), "es_comparacion_precios": F.lit(False)})
    raw, capped = (favoritism.fav_features(rows, amount=a) for a in ("monto", "monto_capped"))
    assert raw.first()["monto_total"] == 1100.0 and capped.first()["monto_total"] == 300.0
    assert raw.columns == capped.columns == [*favoritism.PAIR, *favoritism.PAIR_FEATURES]
    with pytest.raises(ContractError, match="otra"):
        favoritism.fav_features(rows, amount="otra")


def test_modality_shares(contracts):
    rows = contracts([{"modalidad": m} for m in ("Contratación Directa", "Comparación de Precios", "Licitación Pública")])
    pair = favoritism.fav_features_real(rows).first()
    assert pair["pct_contratacion_directa"] == pair["pct_comparacion_precios"] == pytest.approx(1 / 3)


def test_one_window_gives_count_and_amount(contracts):
    days = [("2024-01-01", 100.0), ("2024-01-05", 100.0), ("2024-01-10", 100.0), ("2024-01-20", 900.0), ("2024-01-25", 900.0)]
    group = splitting.frac_features(contracts([{"fecha_contrato": d, "monto": m} for d, m in days])).first()
    assert (group["max_contratos_ventana_15d"], group["monto_total_ventana_15d"]) == (3, 300.0)
    assert splitting.interpretable_signal(splitting.frac_features(contracts([{"fecha_contrato": d, "monto": m} for d, m in days]))).first()[
        "senal_priorizacion_fraccionamiento"
    ]


def test_windows_equal_brute_force(contracts):
    rng = random.Random(5)
    start = datetime(2023, 12, 1)
    rows = []
    for i in range(300):
        # Whole seconds around the edges of 15 days, and copies of the same second.
        moment = start + timedelta(days=rng.choice([0, 15, 30, 89, 90, 105, rng.randint(0, 400)]), seconds=rng.choice([0, 0, 0, 1, -1]))
        rows.append({"id_proveedor": rng.choice(["P1", "P1", "P2"]), "fecha_contrato": moment.isoformat(), "monto": float(rng.randint(1, 50))})
    df = contracts(rows).withColumn("k", F.lit("k"))
    found = splitting.window_15d(df, ["id_proveedor", "k"]).collect()
    plain = [(r["id_proveedor"], r["fecha_contrato"], r["monto"]) for r in df.collect()]
    assert len(found) == 300
    for r in found:
        inside = [m for p, d, m in plain if p == r["id_proveedor"] and timedelta(0) <= d - r["fecha_contrato"] <= timedelta(days=15)]
        assert (r["contratos_ventana_15d"], r["monto_ventana_15d"]) == (len(inside), sum(inside))


def test_representative_object_breaks_ties_by_text(contracts):
    rows = contracts([{"objeto": "vías de obra"}, {"objeto": "carretera"}, {"objeto": "otra cosa"}])
    group = splitting.frac_features(rows).first()
    assert group["objeto"] == "carretera" and group["n_contratos_grupo"] == 2


def test_frac_fails_on_unknown_year(contracts):
    with pytest.raises(Exception, match="no threshold for year 2030"):
        splitting.frac_features(contracts([{"fecha_contrato": "2030-01-01"}] * 2)).collect()


def test_payments(spark, contracts):
    rows = contracts([{"monto": 100.0}, {"monto": 0.0}, {"monto": None}])
    paid = spark.createDataFrame(
        [("G1", "C0", datetime(2024, 1, 1), datetime(2024, 1, 11), 60.0, 60.0), ("G2", "C0", datetime(2024, 1, 5), datetime(2024, 1, 1), 40.0, 39.0),
         ("G3", "X", None, datetime(2024, 1, 1), 1.0, 1.0)],
        "id_pago string, id_contrato string, fecha_devengado timestamp, fecha_pagado timestamp, monto_devengado double, monto_pagado double",
    )
    summary = payments.payments_per_contract(rows, paid)
    found = {r["id_contrato"]: r for r in summary.collect()}
    assert found["C0"]["estado_pago_analitico"] == "pagado_aproximadamente_completo" and found["C0"]["n_pagos"] == 2
    assert found["C1"]["ratio_pagado_contrato"] is None and found["C2"]["n_pagos"] == 0
    metrics = {r["metrica"]: r["valor"] for r in payments.payment_metrics(summary, paid).collect()}
    assert metrics["payments_rows"] == 3 and metrics["dias_devengado_a_pagado_p50"] == 10
    assert metrics["contracts_with_payments"] == 1


def test_one_hot_and_scaling(contracts):
    rows = contracts([{"modalidad": "x", "monto": 1.0}, {"modalidad": None, "monto": 3.0}])
    coded = prep.one_hot(rows, "modalidad", prep.one_hot_values(rows, "modalidad")).orderBy("id_contrato").collect()
    assert [(r["modalidad_x"], r["modalidad_otros"]) for r in coded] == [(1.0, 0.0), (0.0, 0.0)]
    scaled = prep.standardize_column(rows, "monto", "z").orderBy("id_contrato").collect()
    assert [r["z"] for r in scaled] == [-1.0, 1.0]
    assert prep.one_hot_values(rows, "id_contrato", 1) == ["C0"]
    by_id = prep.one_hot(rows, "id_contrato", ["C0"]).orderBy("id_contrato").collect()
    assert [(r["id_contrato_C0"], r["id_contrato_otros"]) for r in by_id] == [(1.0, 0.0), (0.0, 1.0)]


def test_p_values_of_t(spark):
    # Two-sided 5 percent points of the t table, the Cauchy case, the normal limit, and both ends.
    rows = [(2.228139, 10.0, 0.05), (0.0, 7.5, 1.0), (-12.706205, 1.0, 0.05), (1.0, 1.0, 0.5), (1.959964, 1e9, 0.05), (40.0, 200.0, 0.0), (0.3, 2.0, 0.7924857)]
    found = spark.createDataFrame(rows, "t double, gl double, expected double").select("expected", explore.t_p_value(F.col("t"), F.col("gl")).alias("p"))
    for row in found.collect():
        assert row["p"] == pytest.approx(row["expected"], abs=1e-6)



def test_histogram_of_nothing_and_of_one_value(contracts):
    assert explore.equal_width_histogram(contracts([{"monto": None}]), "monto", 5).count() == 0
    assert explore.equal_width_histogram(contracts([{"monto": 2.0}] * 3), "monto", 4).first()["n"] == 3
