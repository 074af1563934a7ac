"""Checks of sources, sinks, versions, reports and the stream."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.checks.analysis import groups, pairs
from atalaya.checks.proxies import Tables
from atalaya.checks.registry import check, day
from atalaya.operators import graph, reports, splitting
from atalaya.operators.evaluation import numbered_by_score
from atalaya.operators.explore import top_suppliers
from atalaya.operators.quality import require_publishable
from atalaya.plans.layers import published, refresh_layers
from atalaya.plans.score import run_inference
from atalaya.plans.train import train_candidate
from atalaya.runtime import materialize, new_location
from atalaya.sources import sinks, snapshots
from atalaya.sources.readers import scan_csv_text, scan_table
from atalaya.streaming import totals

# --- sources and sinks -----------------------------------------------------------------------


@check("scan_csv_text", "SELECT id_proveedor, ruc, nombre_proveedor FROM suppliers", "suppliers")
def _(t: Tables) -> DataFrame:
    path = new_location(t.spark, "csv")
    t.suppliers.write.option("header", True).csv(path)
    return scan_csv_text(t.spark, path, ["id_proveedor", "ruc", "nombre_proveedor"])


@check("scan_table", "SELECT id_contrato, id_proveedor, monto FROM contracts", "contracts")
def _(t: Tables) -> DataFrame:
    t.contracts.createOrReplaceTempView("contratos_catalogo")
    return scan_table(t.spark, "contratos_catalogo", ["id_contrato", "id_proveedor", "monto"])


@check("sink_parquet_new", "SELECT id_contrato, monto FROM contracts", "contracts")
def _(t: Tables) -> DataFrame:
    written = sinks.sink_parquet_new({"contratos": t.contracts.select("id_contrato", "monto")}, new_location(t.spark, "new"))
    return t.spark.read.parquet(written["contratos"])


@check(
    "sink_csv_single",
    "SELECT id_proveedor, CAST(count(*) AS VARCHAR) AS n_contratos FROM contracts GROUP BY ALL ORDER BY count(*) DESC, 1 LIMIT 15",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    target = sinks.sink_csv_single(top_suppliers(t.contracts), new_location(t.spark, "single") + "/top.csv")
    return scan_csv_text(t.spark, target)


@check(
    "sink_csv_domains",
    "SELECT id_proveedor, ruc FROM suppliers UNION ALL SELECT id_entidad, nombre_entidad FROM entities",
    "suppliers entities",
)
def _(t: Tables) -> DataFrame:
    folder = new_location(t.spark, "domains")
    sinks.sink_csv_domains({"suppliers": t.suppliers, "entities": t.entities}, {"status": "ok"}, folder)
    one = scan_csv_text(t.spark, f"{folder}/suppliers", ["id_proveedor", "ruc"])
    other = scan_csv_text(t.spark, f"{folder}/entities", ["id_entidad", "nombre_entidad"])
    return one.unionAll(other)


def _facts(t: Tables) -> DataFrame:
    return sinks.sink_partitioned(t.contracts, new_location(t.spark, "facts"))


@check(
    "sink_partitioned",
    "SELECT strftime(fecha_contrato, '%Y-%m') AS anio_mes, count(*) AS n, sum(monto) AS monto FROM contracts GROUP BY ALL",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return _facts(t).groupBy("anio_mes").agg(F.count(F.lit(1)).alias("n"), F.sum("monto").alias("monto"))


@check(
    "recent_partitions",
    "SELECT DISTINCT strftime(fecha_contrato, '%Y-%m') AS anio_mes FROM contracts ORDER BY 1 DESC LIMIT 6",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return sinks.recent_partitions(_facts(t))


@check(
    "partition_prune_filter",
    """
    , m AS (SELECT *, strftime(fecha_contrato, '%Y-%m') AS anio_mes FROM contracts)
    SELECT id_contrato, monto, anio_mes FROM m WHERE monto > 100000 AND anio_mes >= (
      SELECT min(anio_mes) FROM (SELECT DISTINCT anio_mes FROM m ORDER BY 1 DESC LIMIT 6))""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return sinks.partition_prune_filter(_facts(t)).select("id_contrato", "monto", "anio_mes")


@check(
    "sink_table",
    """SELECT id_entidad, count(*) AS n_contratos, round(sum(monto), 2) AS monto_total FROM contracts
       GROUP BY ALL ORDER BY monto_total DESC, id_entidad LIMIT 5""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    path = new_location(t.spark, "table")
    table = "plata_contratos_" + path.rsplit("-", 1)[1]
    sinks.sink_table(t.contracts, table, path)
    return sinks.entity_totals(t.spark, table)


@check("sink_staged_publish", "SELECT id_proveedor, id_entidad, n_contratos FROM pares", "pares")
def _(t: Tables) -> DataFrame:
    final = new_location(t.spark, "published")
    rows = pairs(t).select("id_proveedor", "id_entidad", "n_contratos")
    sinks.sink_staged_publish(
        t.spark,
        lambda staging: rows.write.parquet(staging),
        lambda staging: require_publishable(
            t.spark.read.parquet(staging), ["id_proveedor", "id_entidad"], [], ["n_contratos"], "pairs"
        ),
        final,
    )
    return t.spark.read.parquet(final)


#: Table, source view and a sum over it, layer by layer.
_LAYER_SUMS = {
    "bronce": [
        ("contratos", "contracts", "monto"), ("pagos", "payments", "monto_pagado"), ("proveedores", "suppliers", "1"),
        ("entidades", "entities", "1"), ("funcionarios", "officials", "1"),
    ],
    "plata": [
        ("contratos_procesados", "prepared", "monto_capped"), ("dataset_favoritismo", "pares", "n_contratos"),
        ("dataset_fraccionamiento", "grupos", "n_contratos_grupo"), ("proveedores", "suppliers", "1"),
        ("entidades", "entities", "1"), ("funcionarios", "officials", "1"),
    ],
    "oro": [
        ("ranking_riesgo_favoritismo", "pares", "n_contratos"),
        ("ranking_riesgo_fraccionamiento", "grupos", "max_contratos_ventana_15d"),
        ("ranking_vinculos_proveedor_funcionario", "(SELECT * FROM vinculos WHERE senal_vinculo)", "n_contratos"),
        ("resumen_pagos_contrato", "(SELECT id_contrato, count(id_pago) AS n_pagos FROM contracts LEFT JOIN payments "
         "USING (id_contrato) GROUP BY id_contrato)", "n_pagos"),
        ("resumen_modalidades_regimen", "(SELECT regimen, modalidad, clasificacion_modalidad, count(*) AS n_contratos "
         "FROM clasificados GROUP BY ALL)", "n_contratos"),
        ("vinculos_pagerank", "rangos", "pagerank"),
    ],
}


@check(
    "layer_publish",
    " UNION ALL ".join(
        f"SELECT '{layer}' AS capa, '{name}' AS tabla, count(*) AS filas, round(sum({value}), 3)::DOUBLE AS suma FROM {view}"
        for layer, rows in _LAYER_SUMS.items() for name, view, value in rows
    ),
    "contracts payments suppliers entities officials prepared pares grupos vinculos clasificados rangos",
)
def _(t: Tables) -> DataFrame:
    """All tables of the three layers, from the domains and a model trained on them."""
    t = t.written()
    root, model = new_location(t.spark, "layers"), new_location(t.spark, "model")
    train_candidate(t.training, model, inherited={"numTrees": 100, "maxDepth": 3, "k": 3, "champion": "none"})
    sources = {
        "contratos": t.contracts, "pagos": t.payments, "proveedores": t.suppliers, "entidades": t.entities,
        "funcionarios": t.officials,
    }
    refresh_layers(t.spark, root, sources, model)
    parts = []
    for layer, rows in _LAYER_SUMS.items():
        tables = published(t.spark, root, layer)
        for name, _view, value in rows:
            parts.append(tables[name].agg(
                F.count(F.lit(1)).alias("filas"), F.round(F.sum(F.expr(value)).cast("double"), 3).alias("suma")
            ).select(F.lit(layer).alias("capa"), F.lit(name).alias("tabla"), "filas", "suma"))
    return reduce(DataFrame.unionByName, parts)


# --- versions ----------------------------------------------------------------------------------

_KEY = ["id_contrato"]


def _corrected():
    return F.col("modalidad") == "Licitación Pública"


def _versions(t: Tables) -> str:
    path = new_location(t.spark, "versions")
    snapshots.snapshot_append(t.contracts.select("id_contrato", "modalidad", "monto"), path)
    snapshots.snapshot_update(t.spark, path, _KEY, _corrected(), "monto", F.col("monto") * 2)
    return path


@check(
    "snapshot_append",
    "SELECT id_contrato, modalidad, monto FROM contracts",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    path = new_location(t.spark, "versions")
    snapshots.snapshot_append(t.contracts.select("id_contrato", "modalidad", "monto"), path)
    return snapshots.snapshot_as_of(t.spark, path, _KEY)


@check(
    "snapshot_update",
    """SELECT id_contrato, modalidad, CASE WHEN modalidad = 'Licitación Pública' THEN monto * 2 ELSE monto END AS monto
       FROM contracts""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return snapshots.snapshot_as_of(t.spark, _versions(t), _KEY)


@check(
    "snapshot_as_of",
    """SELECT id_contrato, monto AS anterior, monto * 2 AS actual FROM contracts
       WHERE modalidad = 'Licitación Pública' AND monto IS NOT NULL""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return snapshots.compare_with_version(t.spark, _versions(t), _KEY, 0, "monto")


@check(
    "snapshot_history",
    """SELECT CAST(0 AS BIGINT) AS version, 'WRITE' AS operacion, count(*) AS filas FROM contracts UNION ALL
       SELECT CAST(1 AS BIGINT), 'UPDATE', count(*) FILTER (WHERE modalidad = 'Licitación Pública') FROM contracts""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return snapshots.snapshot_history(t.spark, _versions(t)).select("version", "operacion", "filas")


@check(
    "change_feed",
    """
    , antes AS (SELECT id_contrato, monto FROM contracts WHERE modalidad IS DISTINCT FROM 'Comparación de Precios'),
    despues AS (SELECT id_contrato, CASE WHEN modalidad = 'Licitación Pública' THEN monto + 1 ELSE monto END AS monto
      FROM contracts WHERE modalidad IS DISTINCT FROM 'Adjudicación Simplificada'),
    d AS (SELECT coalesce(a.id_contrato, b.id_contrato) AS id_contrato, a.monto AS x, b.monto AS y,
      a.id_contrato IS NULL AS nuevo, b.id_contrato IS NULL AS borrado
      FROM antes a FULL JOIN despues b ON a.id_contrato = b.id_contrato)
    SELECT id_contrato, y AS monto, 'insert' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM d WHERE nuevo
    UNION ALL SELECT id_contrato, x, 'delete', 1 FROM d WHERE borrado
    UNION ALL SELECT id_contrato, x, 'update_preimage', 1 FROM d WHERE NOT nuevo AND NOT borrado AND x IS DISTINCT FROM y
    UNION ALL SELECT id_contrato, y, 'update_postimage', 1 FROM d WHERE NOT nuevo AND NOT borrado AND x IS DISTINCT FROM y""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    missing = F.col("modalidad").isNull()
    before = t.contracts.where(missing | (F.col("modalidad") != "Comparación de Precios"))
    after = t.contracts.where(missing | (F.col("modalidad") != "Adjudicación Simplificada")).withColumn(
        "monto", F.when(_corrected(), F.col("monto") + 1).otherwise(F.col("monto"))
    )
    return snapshots.change_feed(before.select("id_contrato", "monto"), after.select("id_contrato", "monto"), _KEY, 1)


# --- reports -------------------------------------------------------------------------------------

RUN_AT = "2026-11-30 00:00:00"


def _pair_ranking(t: Tables) -> DataFrame:
    # Written once: gates, counts and views read it.
    return materialize(pairs(t), "pairs").withColumn("score_riesgo_favoritismo", F.col("concentracion_objeto"))


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, for a comparison in any engine."""
    numbers = [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    return day(df.withColumns({c: F.col(c).cast("double") for c in numbers}), "fecha_calculo")


_PAIR_REPORT = """SELECT id_proveedor, id_entidad, n_contratos, monto_total,
  CAST(CAST(pct_contratacion_directa AS DECIMAL(9, 8)) AS DOUBLE) AS pct_contratacion_directa,
  CAST(CAST(pct_comparacion_precios AS DECIMAL(9, 8)) AS DOUBLE) AS pct_comparacion_precios,
  CAST(CAST(concentracion_objeto AS DECIMAL(10, 9)) AS DOUBLE) AS score_riesgo, '2026-11-30' AS fecha_calculo FROM pares"""


@check("report_favoritism", _PAIR_REPORT, "pares")
def _(t: Tables) -> DataFrame:
    return _plain(reports.report_favoritism(_pair_ranking(t), RUN_AT))


def _by_family(t: Tables) -> DataFrame:
    signalled = splitting.interpretable_signal(materialize(groups(t), "groups"))
    return signalled.withColumn("score_anomalia", F.col("monto_total_grupo") / 1000)


_GROUP_REPORT = """SELECT id_proveedor, id_entidad, objeto_familia, objeto, max_contratos_ventana_15d AS max_contratos_ventana,
  CAST(CAST(pct_montos_bajo_umbral AS DECIMAL(9, 8)) AS DOUBLE) AS pct_bajo_umbral,
  CAST(CAST(monto_total_grupo / 1000 AS DECIMAL(18, 10)) AS DOUBLE) AS score_anomalia,
  (max_contratos_ventana_15d >= 3 AND pct_montos_bajo_umbral >= 0.7)::INT AS senal_priorizacion,
  '2026-11-30' AS fecha_calculo FROM grupos"""


@check("report_splitting", _GROUP_REPORT, "grupos")
def _(t: Tables) -> DataFrame:
    t = t.written()
    return _plain(reports.report_splitting(_by_family(t), RUN_AT))


def _links(t: Tables) -> DataFrame:
    edges = graph.edge_aggregate(t.contracts).where(F.col("dst").isNotNull())
    return materialize(graph.contact_match_join(edges, t.suppliers, t.officials), "links")


@check(
    "report_links",
    """SELECT src AS id_proveedor, dst AS id_funcionario, n_contratos, comparte_telefono::INT AS comparte_telefono,
       comparte_direccion::INT AS comparte_direccion, '2026-11-30' AS fecha_calculo FROM vinculos WHERE dst IS NOT NULL""",
    "vinculos",
)
def _(t: Tables) -> DataFrame:
    return _plain(reports.report_links(_links(t), RUN_AT))


@check(
    "report_views",
    """SELECT 'vw_reporte_favoritismo' AS vista, count(*) AS filas FROM pares UNION ALL
       SELECT 'vw_reporte_fraccionamiento', count(*) FROM grupos UNION ALL
       SELECT 'vw_reporte_vinculos', count(*) FROM vinculos WHERE dst IS NOT NULL""",
    "pares grupos vinculos",
)
def _(t: Tables) -> DataFrame:
    t = t.written()
    names = reports.report_views({
        "favoritismo": reports.report_favoritism(_pair_ranking(t), RUN_AT),
        "fraccionamiento": reports.report_splitting(_by_family(t), RUN_AT),
        "vinculos": reports.report_links(_links(t), RUN_AT),
    })
    parts = [
        t.spark.table(v).agg(F.count(F.lit(1)).alias("filas")).select(F.lit(v).alias("vista"), "filas")
        for v in names.values()
    ]
    return reduce(DataFrame.unionByName, parts)


@check("report_filter", f"SELECT * FROM ({_PAIR_REPORT}) WHERE score_riesgo >= 0.1", "pares")
def _(t: Tables) -> DataFrame:
    names = reports.report_views({"favoritismo": reports.report_favoritism(_pair_ranking(t), RUN_AT)})
    return _plain(reports.report_filter(t.spark, names["favoritismo"], "score_riesgo", 0.1))


@check(
    "publish_gate_counts",
    "SELECT 'favoritismo' AS reporte, count(*) AS filas FROM pares UNION ALL SELECT 'fraccionamiento', count(*) FROM grupos "
    "UNION ALL SELECT 'vinculos', count(*) FROM vinculos WHERE dst IS NOT NULL",
    "pares grupos vinculos",
)
def _(t: Tables) -> DataFrame:
    t = t.written()
    tables = {
        "favoritismo": reports.report_favoritism(_pair_ranking(t), RUN_AT),
        "fraccionamiento": reports.report_splitting(_by_family(t), RUN_AT),
        "vinculos": reports.report_links(_links(t), RUN_AT),
    }
    reports.report_views(tables)
    found = reports.publish_gate_counts(t.spark, {name: df.count() for name, df in tables.items()})
    return t.spark.createDataFrame(list(found.items()), "reporte string, filas bigint")


@check(
    "global_row_number",
    "SELECT id_contrato, row_number() OVER (ORDER BY monto DESC NULLS LAST, id_contrato) AS rango FROM contracts",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return numbered_by_score(t.contracts, "monto", "id_contrato").select("id_contrato", "rango")


# --- stream -----------------------------------------------------------------------------------------


def _arrivals(t: Tables) -> str:
    """The events as CSV files of arriving contracts."""
    folder = new_location(t.spark, "arrivals")
    t.raw("events").select(
        F.col("event_id").cast("string").alias("id_contrato"),
        F.col("user_id").cast("string").alias("id_proveedor"),
        F.col("event_type").alias("id_entidad"),
        F.lit("Contratación Directa").alias("modalidad"),
        F.floor(F.col("value") * 100).cast("double").alias("monto"),
    ).repartition(3).write.option("header", True).csv(folder)
    return folder


@check(
    "scan_stream_csv",
    "SELECT CAST(event_id AS VARCHAR) AS id_contrato, event_type AS id_entidad, floor(value * 100) AS monto FROM events",
)
def _(t: Tables) -> DataFrame:
    out, checkpoint = new_location(t.spark, "stream"), new_location(t.spark, "progress")
    stream = totals.scan_stream_csv(t.spark, _arrivals(t)).select("id_contrato", "id_entidad", "monto")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return t.spark.read.parquet(out)


_TOTALS = """SELECT event_type AS id_entidad, count(*) AS n_contratos, sum(floor(value * 100)) AS monto_acumulado
  FROM events GROUP BY ALL"""


@check("stream_entity_totals", _TOTALS)
def _(t: Tables) -> DataFrame:
    out, checkpoint = new_location(t.spark, "totals"), new_location(t.spark, "progress")
    query = totals.stream_entity_totals(
        totals.scan_stream_csv(t.spark, _arrivals(t)), checkpoint, out, available_now=True
    )
    query.awaitTermination()
    return totals.latest_totals(t.spark, out)


@check("stream_drain_read", _TOTALS)
def _(t: Tables) -> DataFrame:
    out, checkpoint = new_location(t.spark, "totals"), new_location(t.spark, "progress")
    query = totals.stream_entity_totals(totals.scan_stream_csv(t.spark, _arrivals(t)), checkpoint, out)
    try:
        return totals.stream_drain_read(query, t.spark, out)
    finally:
        query.stop()


# --- the scoring job -----------------------------------------------------------------------------------


@check("run_inference")
def _(t: Tables) -> DataFrame:
    t = t.written()
    model = new_location(t.spark, "candidate")
    train_candidate(t.training, model, inherited={"numTrees": 100, "maxDepth": 3, "k": 3, "champion": "none"})
    t.contracts.createOrReplaceTempView("contratos_para_puntuar")
    config = json.loads(json.dumps({
        "mode": "inference",
        "source": {"type": "spark_sql", "tables": {"contracts": "contratos_para_puntuar"}},
        "mapping": {"contracts": {c: c for c in t.contracts.columns}},
    }))
    summary = run_inference(config, t.spark, model, new_location(t.spark, "scored"))
    rows = [(k, float(v)) for k, v in summary.items() if k.endswith("_rows")]
    return t.spark.createDataFrame(rows, "medida string, valor double")
