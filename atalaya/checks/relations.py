"""Checks of joins and of the supplier-official graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.checks.proxies import Tables, define
from atalaya.checks.registry import check, rounded
from atalaya.operators import graph
from atalaya.plans.star import orphan_left_vs_inner, star_left_join


@check(
    "star_left_join",
    """
    SELECT c.id_contrato, c.id_proveedor, c.id_entidad, c.monto, c.modalidad, s.nombre_proveedor AS razon_social,
      e.nombre_entidad, f.nombre_funcionario
    FROM (SELECT * FROM contracts WHERE monto > 100000 AND id_entidad IS NOT NULL) c
    LEFT JOIN suppliers s ON c.id_proveedor = s.id_proveedor LEFT JOIN entities e ON c.id_entidad = e.id_entidad
    LEFT JOIN officials f ON c.id_funcionario = f.id_funcionario""",
    "contracts suppliers entities officials",
)
def _(t: Tables) -> DataFrame:
    return star_left_join(t.contracts.where(F.col("monto") > 100_000), t.suppliers, t.entities, t.officials)


@check(
    "orphan_left_vs_inner",
    """SELECT count(*) AS filas_left, count(o.id_contrato) AS filas_inner FROM order_payments p
       LEFT JOIN settled_orders o ON p.id_contrato = o.id_contrato""",
    "order_payments settled_orders",
)
def _(t: Tables) -> DataFrame:
    return orphan_left_vs_inner(t.order_payments, t.settled_orders, "id_contrato")


define(
    "aristas",
    """SELECT id_proveedor AS src, id_funcionario AS dst, count(*) AS n_contratos, sum(monto) AS monto_total
       FROM contracts GROUP BY ALL""",
    "contracts",
)
define(
    "vertices",
    """SELECT id_proveedor AS id, 'proveedor' AS tipo FROM suppliers UNION ALL
       SELECT id_funcionario, 'funcionario' FROM officials""",
    "suppliers", "officials",
)
define(
    "vinculos",
    """
    SELECT a.*, coalesce(s.telefono = f.telefono, FALSE) AS comparte_telefono,
      coalesce(s.direccion = f.direccion, FALSE) AS comparte_direccion,
      coalesce(s.telefono = f.telefono, FALSE) OR coalesce(s.direccion = f.direccion, FALSE) AS senal_vinculo,
      s.telefono AS tel_prov, s.direccion AS dir_prov, f.telefono AS tel_func, f.direccion AS dir_func
    FROM aristas a LEFT JOIN suppliers s ON a.src = s.id_proveedor LEFT JOIN officials f ON a.dst = f.id_funcionario""",
    "aristas", "suppliers", "officials",
)


@check("edge_aggregate", "SELECT * FROM aristas", "aristas")
def _(t: Tables) -> DataFrame:
    return graph.edge_aggregate(t.contracts)


@check("union_vertices", "SELECT * FROM vertices", "vertices")
def _(t: Tables) -> DataFrame:
    return graph.union_vertices(t.suppliers, t.officials)


@check(
    "graph_build",
    """SELECT 'vertices' AS parte, count(*) AS n FROM vertices UNION ALL SELECT 'aristas', count(*) FROM aristas""",
    "vertices aristas",
)
def _(t: Tables) -> DataFrame:
    vertices, edges = graph.graph_build(t.contracts, t.suppliers, t.officials)

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("parte"), "n")

    return counted("vertices", vertices).unionByName(counted("aristas", edges))


@check("contact_match_join", "SELECT * FROM vinculos", "vinculos")
def _(t: Tables) -> DataFrame:
    return graph.contact_match_join(graph.edge_aggregate(t.contracts), t.suppliers, t.officials)


@check("suspicious_links", "SELECT * FROM vinculos WHERE senal_vinculo", "vinculos")
def _(t: Tables) -> DataFrame:
    return graph.suspicious_links(graph.edge_aggregate(t.contracts), t.suppliers, t.officials)


@check(
    "link_recall",
    """
    , esperados AS (SELECT DISTINCT id_proveedor AS src, id_funcionario AS dst FROM contracts
      WHERE modalidad = 'Contratación Directa' AND id_funcionario IS NOT NULL)
    SELECT count(*) AS esperados, count(*) FILTER (WHERE senal_vinculo) AS recuperados
    FROM esperados LEFT JOIN vinculos USING (src, dst)""",
    "contracts vinculos",
)
def _(t: Tables) -> DataFrame:
    links = graph.contact_match_join(graph.edge_aggregate(t.contracts), t.suppliers, t.officials)
    direct = F.col("modalidad") == "Contratación Directa"
    expected = t.contracts.where(direct & F.col("id_funcionario").isNotNull()).select(
        F.col("id_proveedor").alias("src"), F.col("id_funcionario").alias("dst")
    )
    return graph.link_recall(links, expected)


# Suppliers have no incoming edge, so their rank is the reset share after the first round,
# and the ranks of officials are stable from the second round on.
define(
    "rangos",
    """
    SELECT id, tipo, crudo * count(*) OVER () / sum(crudo) OVER () AS pagerank FROM (
      SELECT v.id, v.tipo, 0.15 + 0.85 * coalesce(r.recibido, 0) AS crudo FROM vertices v
      LEFT JOIN (SELECT dst, sum(0.15::DOUBLE / n) AS recibido
        FROM (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n FROM aristas WHERE dst IS NOT NULL) GROUP BY dst) r
      ON v.id = r.dst)""",
    "vertices", "aristas",
)


def _ranks(t: Tables) -> DataFrame:
    return graph.pagerank(*graph.graph_build(t.contracts, t.suppliers, t.officials))


@check("pagerank", "SELECT id, tipo, round(pagerank, 6) AS pagerank FROM rangos", "rangos")
def _(t: Tables) -> DataFrame:
    return rounded(_ranks(t), 6, "pagerank")


@check(
    "top_officials",
    """SELECT id, tipo, round(pagerank, 6) AS pagerank FROM rangos WHERE tipo = 'funcionario'
       ORDER BY rangos.pagerank DESC, id LIMIT 10""",
    "rangos",
)
def _(t: Tables) -> DataFrame:
    return rounded(graph.top_officials(_ranks(t)), 6, "pagerank")


# Links between suppliers and officials of all contracts. Labels sink to the smallest id in rounds; the graph is
# a dense two-layer one, whose paths are short.
_ROUNDS = 8
define(
    "enlaces",
    """SELECT DISTINCT id_proveedor AS src, id_funcionario AS dst FROM training WHERE id_funcionario IS NOT NULL""",
    "training",
)


def _sinking_labels() -> str:
    steps = [", lados AS (SELECT src AS a, dst AS b FROM enlaces UNION SELECT dst, src FROM enlaces), r0 AS (SELECT id, id AS raiz FROM vertices)"]
    steps += [
        f"""r{i} AS (SELECT v.id, least(v.raiz, coalesce(min(w.raiz), v.raiz)) AS raiz FROM r{i - 1} v
        LEFT JOIN lados ON v.id = lados.a LEFT JOIN r{i - 1} w ON lados.b = w.id GROUP BY v.id, v.raiz)"""
        for i in range(1, _ROUNDS + 1)
    ]
    return ", ".join(steps) + f" SELECT id, raiz AS component FROM r{_ROUNDS}"


@check("connected_components", _sinking_labels(), "enlaces vertices")
def _(t: Tables) -> DataFrame:
    links = t.training.where(F.col("id_funcionario").isNotNull()).select(
        F.col("id_proveedor").alias("src"), F.col("id_funcionario").alias("dst")
    )
    return graph.connected_components(graph.union_vertices(t.suppliers, t.officials), links)
