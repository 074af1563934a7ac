import pytest
from pyspark.sql import functions as F

from atalaya.functions.amounts import modality_flags
from atalaya.operators import favoritism, splitting
from atalaya.operators.favoritism import fav_features
from atalaya.operators.skew import crowded_keys, divide
from atalaya.operators.splitting import frac_features


def _mixed(contracts):
    rows = [
        {
            "id_proveedor": f"P{i % 3}", "id_entidad": None if i % 11 == 0 else f"E{i % 2}", "id_funcionario": f"F{i % 5}", "monto": float(i % 7) * 1000,
            "objeto": ["cemento", "cemento gris", "acero"][i % 4 % 3], "fecha_contrato": f"2024-0{1 + i % 6}-{1 + i % 27:02d}",
            "modalidad": "Contratación Directa" if i % 3 else "Licitación Pública",
        }
        for i in range(200)
    ]
    made = contracts(rows).withColumn("label", (F.col("monto") > 5000) & (F.col("id_proveedor") == "P1"))
    # Some contracts have no id.
    return made.withColumns({"id_contrato": F.when(F.col("monto") != 2000, F.col("id_contrato")), **modality_flags(F.col("modalidad"))})


def _plain_rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_features_shuffle_contracts_once(contracts):
    made = _mixed(contracts)
    for features in (fav_features(made, label="label"), frac_features(made, label="label")):
        assert features._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_families_are_made_once_a_row(contracts):
    plan = frac_features(_mixed(contracts), label="label")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "array_except" in line for line in plan.splitlines())


@pytest.mark.parametrize("module, features", [(favoritism, fav_features), (splitting, frac_features)])
def test_crowded_keys_have_the_same_features(contracts, monkeypatch, module, features):
    made = _mixed(contracts)
    whole = _plain_rows(features(made, label="label"))
    assert whole
    some = lambda df, on: df.where("id_proveedor = 'P1' OR id_entidad IS NULL").select(*on).distinct()
    monkeypatch.setattr(module, "crowded_keys", some)
    assert _plain_rows(features(made, label="label")) == whole
    monkeypatch.setattr(module, "crowded_keys", lambda df, on: df.select(*on).distinct())
    assert _plain_rows(features(made, label="label")) == whole


def test_crowded_keys_are_those_of_many_rows(spark):
    df = spark.range(0, 4000, 1, 4).select(F.when(F.col("id") % 4 > 0, "a").alias("k"), (F.col("id") % 500).alias("v"))
    assert [r["k"] for r in crowded_keys(df, ["k"], 1, 2000).collect()] == ["a"]
    assert {r["k"] for r in crowded_keys(df, ["k"], 1, 900).collect()} == {"a", None}
    assert crowded_keys(df, ["k"], 1, 3000) is None
    many, few = divide(df, ["k"], crowded_keys(df, ["k"], 1, 2000))
    assert (many.count(), few.count()) == (3000, 1000)
