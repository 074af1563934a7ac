"""Training, scoring and monitoring from end to end on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from atalaya.checks.proxies import Tables
from atalaya.errors import GateError
from atalaya.operators.contract import LABELS
from atalaya.operators.fingerprint import fingerprint
from atalaya.plans.benchmark import benchmark_config
from atalaya.plans.evaluate import eval_favoritism, eval_splitting
from atalaya.plans.monitor import monitor_batch, retrain
from atalaya.plans.score import GROUP_RANKING, PAIR_RANKING, run_inference, score_contracts
from atalaya.plans.train import MANIFEST, train_candidate
from atalaya.sources.sinks import read_json

FOLDER = "/root/testdata/sf0.001"
SETTINGS = {"numTrees": 10, "maxDepth": 3, "k": 2, "champion": "champion-0"}


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def model(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models") / "candidate")
    train_candidate(tables.training, folder, inherited=SETTINGS)
    return folder


def test_candidate_manifest(spark, model, tables):
    manifest = read_json(spark, f"{model}/{MANIFEST}")
    assert manifest["status"] == "candidate"
    assert manifest["training"]["validation_state"] == "pending_candidate_evaluation"
    assert manifest["training"]["training_data_fingerprint_sha256"] == fingerprint(tables.training.repartition(3))
    with pytest.raises(FileExistsError):
        train_candidate(tables.training, model, inherited=SETTINGS)
    with pytest.raises(GateError, match="evaluate"):
        train_candidate(tables.training, model + "-new")


def test_fingerprint_sees_values_and_types(tables):
    some = tables.suppliers
    assert fingerprint(some) == fingerprint(some.select(*reversed(some.columns)))
    assert fingerprint(some) != fingerprint(some.withColumn("ruc", F.concat("ruc", F.lit("0"))))


def config(spark, df):
    df.createOrReplaceTempView("contratos_trabajo")
    return {
        "mode": "inference",
        "source": {"type": "spark_sql", "tables": {"contracts": "contratos_trabajo"}},
        "mapping": {"contracts": {c: c for c in df.columns}},
    }


@pytest.mark.parametrize("single_csv", [False, True])
def test_scoring_publishes_gated_rankings(spark, tables, model, tmp_path, single_csv):
    output = str(tmp_path / "scored")
    summary = run_inference(config(spark, tables.contracts), spark, model, output, single_csv=single_csv)
    if single_csv:
        assert (tmp_path / "scored" / f"{PAIR_RANKING}.csv").is_file()
    else:
        pairs = spark.read.parquet(f"{output}/{PAIR_RANKING}.parquet")
        assert pairs.count() == summary["favoritismo_scored_rows"] == 250
        assert spark.read.parquet(f"{output}/{GROUP_RANKING}.parquet").count() == summary["fraccionamiento_scored_rows"]
    assert summary["contracts_rows"] == 6000 and (tmp_path / "scored" / "inference_summary.json").exists()


def test_scoring_never_sees_labels(spark, tables, model):
    with pytest.raises(GateError, match="labels"):
        score_contracts(tables.training, model)
    with pytest.raises(GateError, match="inference"):
        run_inference({**config(spark, tables.contracts), "mode": "training"}, spark, model, "/tmp/no")


def test_monitoring_and_retraining(spark, tables, model, tmp_path):
    early = F.col("fecha_contrato") < "2024-01-01"
    train_rows, batch = tables.training.where(early), tables.training.where(~early)
    report, decision = monitor_batch(batch, model, "nuevo")
    assert {r["modelo"] for r in report.collect()} == {"favoritismo", "fraccionamiento"} and report.count() == 10
    row = decision.first()
    assert row["lote"] == "nuevo" and row["automatic_promotion"] is False
    blind = monitor_batch(batch.drop(*LABELS), model, "sin_labels")[1].first()
    assert not blind["candidate_allowed"] and blind["recall_at_k"] is None
    manifest = retrain(train_rows, batch, model, str(tmp_path / "retrained"))
    assert manifest["training"]["inherited_from_champion"].startswith("candidate-")


def test_evaluation_reserves_the_holdout(tables):
    report = eval_favoritism(tables.training, {"numTrees": [5], "maxDepth": [2]}, 3)
    assert report["n_desarrollo"] + report["n_holdout"] == 250
    assert report["preprocessor_fit_scope"] == "development_only"
    assert all(0 <= v <= 1 for v in report["metricas_holdout_final"].values())


def test_splitting_evaluation(tables):
    report = eval_splitting(tables.training, [2], [11])
    assert report["mejor_configuracion"]["k"] == 2 and not report["labels_used_for_fit"]
    assert all(0 <= v <= 1 for v in report["metricas_holdout_final"].values())


def test_benchmark_measures_every_stage(spark, tables):
    measured = {(r["etapa"], r["medida"]): r["valor"] for r in benchmark_config(spark, config(spark, tables.contracts), 1).collect()}
    assert measured[("integracion", "filas")] == 6000 and measured[("features", "filas_por_segundo")] > 0
