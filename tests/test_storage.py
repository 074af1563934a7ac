import pytest
from pyspark.sql import functions as F

from atalaya.errors import ContractError, GateError
from atalaya.operators import reports
from atalaya.plans.layers import LAYERS, layer_publish, refresh_layers
from atalaya.runtime import materialize, shared_folder
from atalaya.sources import readers, sinks, snapshots
from atalaya.streaming import totals


@pytest.fixture
def small(spark):
    return spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")


def test_new_output_is_distributed_and_never_overwrites(spark, small, tmp_path):
    folder = str(tmp_path / "out")
    written = sinks.sink_parquet_new({"uno": small.repartition(2), "dos": small.limit(1)}, folder)
    assert [spark.read.parquet(written[n]).count() for n in ("uno", "dos")] == [2, 1]
    assert len(list((tmp_path / "out" / "uno.parquet").glob("part-*.parquet"))) == 2
    with pytest.raises(FileExistsError):
        sinks.sink_parquet_new({"uno": small}, folder)


def test_staged_publication_keeps_the_previous_output(spark, small, tmp_path):
    final = str(tmp_path / "final")
    write = lambda df: lambda staging: df.write.parquet(staging)
    sinks.sink_staged_publish(spark, write(small), lambda s: None, final)

    def refuse(_staging):
        raise GateError("no")

    with pytest.raises(GateError):
        sinks.sink_staged_publish(spark, write(small.limit(1)), refuse, final)
    assert spark.read.parquet(final).count() == 2
    sinks.sink_staged_publish(spark, write(small.limit(1)), lambda s: None, final)
    assert spark.read.parquet(final).count() == 1
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["final"]


def test_single_csv(spark, small, tmp_path):
    target = tmp_path / "dir" / "uno.csv"
    sinks.sink_csv_single(small, str(target))
    assert target.read_text().splitlines() == ["id,x", "a,1.0", "b,2.0"]


def test_partition_pruning_shows_in_the_plan(spark, contracts, tmp_path):
    rows = [{"fecha_contrato": f"2024-{m:02d}-10", "monto": 50_000.0 * (m % 4)} for m in range(1, 13)]
    facts = sinks.sink_partitioned(contracts(rows), str(tmp_path / "facts"))
    kept = sinks.partition_prune_filter(facts)
    assert sorted(r["anio_mes"] for r in kept.collect()) == ["2024-07", "2024-11"]
    plan = kept._jdf.queryExecution().toString()
    line = next(part for part in plan.splitlines() if "PartitionFilters" in part)
    assert "anio_mes" in line.split("PartitionFilters")[1].split("]")[0]
    assert "GreaterThan(monto" in plan
    with pytest.raises(GateError):
        sinks.partition_prune_filter(facts.where("false"))


def test_only_needed_columns_are_read(spark, tmp_path, contracts):
    path = str(tmp_path / "c")
    contracts([{}]).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("contratos_poda")
    plan = readers.scan_table(spark, "contratos_poda", ["monto"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<monto:double>" in plan
    with pytest.raises(ContractError):
        readers.scan_table(spark, "contratos_poda", ["no_esta"])
    with pytest.raises(ContractError):
        readers.scan_table(spark, "  ")


def test_jdbc_options_are_quoted(monkeypatch, spark):
    parts = readers.Partitioning("id", 0, 100, 8)
    options = readers.jdbc_options("jdbc:x", "dbo.Mi Tabla", ["id", "a]b"], parts)
    assert options["dbtable"] == "(SELECT [id], [a]]b] FROM [dbo].[Mi Tabla]) source_rows"
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id"
    for bad in ("x; DROP TABLE y", "a--b", "a/*b", "\x00", " ", "a..b"):
        with pytest.raises(ContractError):
            readers.quote_table(bad)
    with pytest.raises(ContractError, match="read too"):
        readers.jdbc_options("jdbc:x", "t", ["a"], parts)
    monkeypatch.delenv("NO_HAY_URL", raising=False)
    with pytest.raises(ContractError, match="NO_HAY_URL"):
        readers.scan_jdbc(spark, "NO_HAY_URL", "t")


def test_medians_must_be_there(spark, small, tmp_path):
    external = {"monto_mediana_por_objeto_external": True}
    assert readers.load_medians(spark, None, {}) is None
    with pytest.raises(ContractError, match="no path"):
        readers.load_medians(spark, None, external)
    small.write.parquet(str(tmp_path / "m"))
    with pytest.raises(ContractError, match="lacks"):
        readers.load_medians(spark, str(tmp_path / "m"), external)


def test_versions(spark, small, tmp_path):
    path = str(tmp_path / "t")
    assert snapshots.snapshot_append(small, path) == 0
    assert snapshots.snapshot_update(spark, path, ["id"], F.col("id") == "a", "x", F.col("x") * 1.35) == 1
    assert snapshots.snapshot_update(spark, path, ["id"], F.col("id") == "a", "x", F.lit(9)) == 2

    def at(version):
        return {r["id"]: r["x"] for r in snapshots.snapshot_as_of(spark, path, ["id"], version).collect()}

    assert at(0) == {"a": 1.0, "b": 2.0} and at(1) == {"a": 1.35, "b": 2.0} and at(None) == {"a": 9.0, "b": 2.0}
    log = snapshots.snapshot_history(spark, path).orderBy("version").collect()
    assert [(r["operacion"], r["filas"]) for r in log] == [("WRITE", 2), ("UPDATE", 1), ("UPDATE", 1)]
    assert snapshots.snapshot_append(small.limit(1), path) == 3 and len(at(3)) == 1 and len(at(2)) == 2
    changed = snapshots.compare_with_version(spark, path, ["id"], 2, "x").collect()
    assert [(r["anterior"], r["actual"]) for r in changed] == [(9.0, 1.0)]
    with pytest.raises(GateError):
        snapshots.snapshot_as_of(spark, path, ["id"], 7)


def test_change_feed_kinds(spark):
    schema = "id string, x double"
    before = spark.createDataFrame([("same", None), ("edit", 1.0), ("gone", 2.0), ("null", None)], schema)
    after = spark.createDataFrame([("same", None), ("edit", 5.0), ("new", 3.0), ("null", 4.0)], schema)
    rows = {(r["id"], r["_change_type"], r["x"]) for r in snapshots.change_feed(before, after, ["id"], 4).collect()}
    assert rows == {
        ("edit", "update_preimage", 1.0), ("edit", "update_postimage", 5.0), ("gone", "delete", 2.0),
        ("new", "insert", 3.0), ("null", "update_preimage", None), ("null", "update_postimage", 4.0),
    }


def test_layers(spark, small, tmp_path):
    root = str(tmp_path)
    assert layer_publish(spark, root, "bronce", {"contratos": small}) == ["contratos"]
    with pytest.raises(FileNotFoundError, match="dataset_favoritismo"):
        layer_publish(spark, root, "plata", {"contratos_procesados": small})
    (tmp_path / "oro" / "dataset_favoritismo").mkdir(parents=True)
    published = layer_publish(spark, root, "oro", {name: small for name in LAYERS["oro"]})
    assert published == LAYERS["oro"] and not (tmp_path / "oro" / "dataset_favoritismo").exists()
    with pytest.raises(ValueError):
        layer_publish(spark, root, "oro", {"otra": small})


def test_layers_need_all_sources(spark, small, tmp_path):
    with pytest.raises(FileNotFoundError, match="pagos"):
        refresh_layers(spark, str(tmp_path), {name: small for name in LAYERS["bronce"] if name != "pagos"}, "no model")
    assert not list(tmp_path.iterdir())


def ranking(spark, rows):
    return spark.createDataFrame(rows, "id_proveedor string, id_entidad string, n_contratos int, monto_total double, pct_contratacion_directa double, pct_comparacion_precios double, score_riesgo_favoritismo double")


def test_report_gates(spark):
    good = ("P1", "E1", 2, 10.0, 0.5, 0.25, 0.75)
    table = reports.report_favoritism(ranking(spark, [good]), "2026-01-01")
    assert table.schema["score_riesgo"].dataType.simpleString() == "decimal(10,9)"
    for bad in (
        [good, good], [("P1", None, 2, 10.0, 0.5, 0.25, 0.75)], [("P1", "E1", 2, 10.0, 1.5, 0.25, 0.75)],
        [("P1", "E1", -2, 10.0, 0.5, 0.25, 0.75)], [("P1", "E1", 2, 10.0, 0.5, None, 0.75)],
    ):
        with pytest.raises(GateError):
            reports.report_favoritism(ranking(spark, bad), "2026-01-01")
    with pytest.raises(GateError, match="monto_total"):
        reports.report_favoritism(ranking(spark, [good]).drop("monto_total"), "2026-01-01")


def test_report_queries_and_counts(spark):
    rows = [(f"P{i}", "E1", 1, 1.0, 0.0, 0.0, i / 10) for i in range(10)]
    names = reports.report_views({"favoritismo": reports.report_favoritism(ranking(spark, rows), "2026-01-01")})
    found = [float(r["score_riesgo"]) for r in reports.report_filter(spark, names["favoritismo"], "score_riesgo", 0.5).collect()]
    assert found == [0.9, 0.8, 0.7, 0.6, 0.5]
    assert reports.publish_gate_counts(spark, {"favoritismo": 10}) == {"favoritismo": 10}
    with pytest.raises(GateError, match="differ"):
        reports.publish_gate_counts(spark, {"favoritismo": 11})
    with pytest.raises(ValueError):
        reports.report_filter(spark, "otra; DROP", "score_riesgo", 0.5)


def test_older_flag_name(spark):
    columns = "id_proveedor string, id_entidad string, objeto_familia string, objeto string, max_contratos_ventana_15d int, pct_montos_bajo_umbral double, score_anomalia double, cumple_regla_fraccionamiento boolean"
    row = reports.report_splitting(spark.createDataFrame([("P", "E", "f", "o", 3, 1.0, 2.5, True)], columns), "2026-01-01").first()
    assert row["senal_priorizacion"] == 1


FILES = [
    "C1,P0010,E01,Adjudicación Simplificada,85000.0\nC2,P0022,E03,Contratación Directa,42000.0\n",
    "C3,P0010,E01,Adjudicación Simplificada,91000.0\nC4,P0055,E02,Licitación Pública,310000.0\n",
    "C5,P0010,E01,Contratación Directa,120000.0\nC6,P0099,E04,Comparación de Precios,67000.0\n",
]
EXPECTED = [("E01", 3, 296000.0), ("E02", 1, 310000.0), ("E03", 1, 42000.0), ("E04", 1, 67000.0)]


def drop_file(folder, number):
    folder.mkdir(exist_ok=True)
    text = "id_contrato,id_proveedor,id_entidad,modalidad,monto\n" + FILES[number]
    (folder / f"lote_{number}.csv").write_text(text, encoding="utf-8")


def test_stream_totals_grow_with_arriving_files(spark, tmp_path):
    source = tmp_path / "in"
    drop_file(source, 0)
    query = totals.stream_entity_totals(
        totals.scan_stream_csv(spark, str(source)), str(tmp_path / "progress"), str(tmp_path / "out")
    )
    try:
        first = totals.stream_drain_read(query, spark, str(tmp_path / "out"))
        assert [tuple(r) for r in first.collect()] == [("E01", 1, 85000.0), ("E03", 1, 42000.0)]
        drop_file(source, 1)
        drop_file(source, 2)
        last = totals.stream_drain_read(query, spark, str(tmp_path / "out"))
        assert [tuple(r) for r in last.collect()] == EXPECTED
    finally:
        query.stop()


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for number in range(3):
        drop_file(source, number)
        query = totals.stream_entity_totals(
            totals.scan_stream_csv(spark, str(source)), str(tmp_path / "progress"), out, available_now=True
        )
        query.awaitTermination()
    assert [tuple(r) for r in totals.latest_totals(spark, out).collect()] == EXPECTED


def test_stream_to_memory(spark, tmp_path):
    source = tmp_path / "in"
    for number in range(3):
        drop_file(source, number)
    query = totals.stream_to_memory(totals.scan_stream_csv(spark, str(source)), str(tmp_path / "progress"), "agregado")
    try:
        assert [tuple(r) for r in totals.drain_memory(query, spark, "agregado").collect()] == EXPECTED
    finally:
        query.stop()


def test_materialized_rows_live_in_the_shared_folder(spark, small):
    kept = materialize(small, "prueba")
    assert kept.schema == small.schema and kept.count() == 2
    assert kept.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark))
