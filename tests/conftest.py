from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from atalaya.runtime import tune

    yield tune(session)
    session.stop()


CONTRACT_COLUMNS = (
    "id_contrato string, id_proveedor string, id_entidad string, id_funcionario string, monto double, "
    "fecha_contrato timestamp, modalidad string, objeto string, categoria_principal string"
)


@pytest.fixture
def contracts(spark):
    """Build contracts from (id, amount, day, and any other columns by name)."""
    from datetime import datetime

    def build(rows, **defaults):
        base = {
            "id_proveedor": "P1", "id_entidad": "E1", "id_funcionario": "F1", "modalidad": "Licitación Pública",
            "objeto": "cemento", "categoria_principal": "goods",
        }
        base.update(defaults)
        made = []
        for number, row in enumerate(rows):
            full = {**base, "id_contrato": f"C{number}", "monto": 1.0, "fecha_contrato": "2024-01-01", **row}
            full["fecha_contrato"] = datetime.fromisoformat(full["fecha_contrato"])
            made.append(tuple(full[c.split()[0]] for c in CONTRACT_COLUMNS.split(", ")))
        return spark.createDataFrame(made, CONTRACT_COLUMNS)

    return build
