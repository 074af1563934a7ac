"""Procurement domains as views over the supplied order tables, for Spark and as SQL.

Amounts are whole numbers, so that sums do not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.functions.amounts import DIRECT_AWARD, PRICE_COMPARISON
from atalaya.operators.preprocessing import apply_preprocessor, fit_preprocessor
from atalaya.runtime import deal, materialize


def _pick(value: Column, choices: dict[str, str], other: Column | None = None) -> Column:
    found = [F.when(value == k, F.lit(v)) for k, v in choices.items()]
    return F.coalesce(*found, other if other is not None else F.lit(None).cast("string"))


CATEGORY_OF_TYPE = {
    "PROMO": "works", "ECONOMY": "services", "STANDARD": "services", "LARGE": "goods", "MEDIUM": "goods",
}
OBJECT_PREFIX = {
    "Brand#1": "Obra vial ", "Brand#2": "Mantenimiento de las vías ", "Brand#3": "Adquisición de equipos informáticos ",
}


#: Modalities by the first mark of a line.
MODALITY_OF_MARK = {
    "R": DIRECT_AWARD, "A": PRICE_COMPARISON, "O": "Adjudicación Simplificada", "P": "Licitación Pública",
    "B": "Licitación Pública Abreviada",
}


class Tables:
    """The supplied tables of one scale, and the domains derived from them."""

    def __init__(self, spark: SparkSession, folder: str, lines: DataFrame | None = None) -> None:
        self.spark, self.folder, self._written = spark, folder, lines

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _lines(self) -> DataFrame:
        if self._written is not None:
            return self._written
        deal(self.spark, self.raw("lineitem").count())
        # Orders meet customers first, so that the many lines are shuffled for two joins and not for three.
        orders = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        prefix = _pick(F.col("p_brand"), OBJECT_PREFIX, F.lit(""))
        parts = self.raw("part").select(
            "p_partkey", F.when(F.col("p_size") < 50, F.concat(prefix, "p_name")).alias("objeto"),
            _pick(F.col("p_type"), CATEGORY_OF_TYPE).alias("categoria_principal"),
        )
        return (
            self._narrow_lines()
            .join(orders.select("o_orderkey", "o_custkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .drop("o_orderkey", "p_partkey")
        )

    def _narrow_lines(self) -> DataFrame:
        """Line items as keys, date, amount and four marks (modality, official, both labels), because the joins shuffle every byte."""
        other = F.when(F.col("l_linestatus") == "O", "O").otherwise(F.when(F.col("l_quantity") < 25, "P").otherwise("B"))
        modality = F.when(F.col("l_quantity") < 50, _pick(F.col("l_returnflag"), {"R": "R", "A": "A"}, other))
        favoured = (F.col("l_quantity") >= 49) & (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)
        split = (F.col("l_quantity") >= 48) & (F.col("l_linestatus") == "O")
        marks = [modality, F.when(F.col("l_tax") < 0.08, "F"), *[F.when(x, "1").when(~x, "0") for x in (favoured, split)]]
        return self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
            F.when(
                (F.col("l_discount") != 0.05) | (F.col("l_tax") != 0.03),
                F.floor(F.col("l_extendedprice") * 10).cast("double"),
            ).alias("monto"),
            F.concat(*[F.coalesce(m, F.lit("-")) for m in marks]).alias("marks"),
        )

    def written(self) -> Tables:
        """The same tables over joined lines that are written once, for queries that read contracts several times."""
        if self._written is not None:
            return self
        return Tables(self.spark, self.folder, materialize(self._lines(), "lines"))

    @staticmethod
    def _line_id() -> Column:
        return F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
        )

    @cached_property
    def training(self) -> DataFrame:
        """Labelled contracts: one per line item."""
        mark = lambda at: F.substring("marks", at, 1)
        flag = lambda at: F.when(mark(at) != "-", mark(at) == "1")
        return self._lines().select(
            self._line_id().alias("id_contrato"),
            F.concat(F.lit("P"), "l_suppkey").alias("id_proveedor"),
            F.concat(F.lit("E"), "c_nationkey").alias("id_entidad"),
            F.when(mark(2) == "F", F.concat(F.lit("F"), "o_custkey")).alias("id_funcionario"),
            "monto",
            (F.col("l_shipdate") + F.expr("interval 25 years")).cast("timestamp").alias("fecha_contrato"),
            _pick(mark(1), MODALITY_OF_MARK).alias("modalidad"),
            "objeto",
            "categoria_principal",
            flag(3).alias("label_favoritismo"),
            flag(4).alias("label_fraccionamiento"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        return self.training.drop("label_favoritismo", "label_fraccionamiento")

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.concat(F.lit("P"), "s_suppkey").alias("id_proveedor"),
            F.col("s_name").alias("nombre_proveedor"),
            F.lpad(F.col("s_suppkey").cast("string"), 11, "0").alias("ruc"),
            F.concat(F.lit("T"), "s_nationkey").alias("telefono"),
            F.when(F.col("s_acctbal") > 0, F.concat(F.lit("D"), F.floor(F.col("s_acctbal") / 100))).alias("direccion"),
        )

    @cached_property
    def entities(self) -> DataFrame:
        return self.raw("nation").select(
            F.concat(F.lit("E"), "n_nationkey").alias("id_entidad"),
            F.col("n_name").alias("nombre_entidad"),
            F.concat(F.lit(" T"), "n_nationkey").alias("telefono"),
            F.concat(F.lit("D"), "n_nationkey", F.lit(" ")).alias("direccion"),
        )

    @cached_property
    def officials(self) -> DataFrame:
        return self.raw("customer").select(
            F.concat(F.lit("F"), "c_custkey").alias("id_funcionario"),
            F.concat(F.lit("E"), "c_nationkey").alias("id_entidad"),
            F.col("c_name").alias("nombre_funcionario"),
            F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
            F.concat(F.lit("T"), "c_nationkey").alias("telefono"),
            F.when(F.col("c_acctbal") > 0, F.concat(F.lit("D"), F.floor(F.col("c_acctbal") / 100))).alias("direccion"),
        )

    def _payment_columns(self, contract: Column) -> list[Column]:
        return [
            F.concat(F.lit("G"), self._line_id()).alias("id_pago"),
            contract.alias("id_contrato"),
            F.col("l_shipdate").cast("timestamp").alias("fecha_devengado"),
            F.col("l_shipdate").cast("timestamp").alias("fecha_girado"),
            F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_quantity") - 5).cast("int"))
            .cast("timestamp")
            .alias("fecha_pagado"),
            F.floor("l_extendedprice").cast("double").alias("monto_devengado"),
            F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("monto_pagado"),
            F.col("l_linestatus").alias("estado"),
        ]

    @cached_property
    def payments(self) -> DataFrame:
        """One payment for each contract."""
        return self.raw("lineitem").select(*self._payment_columns(self._line_id()))

    @cached_property
    def order_contracts(self) -> DataFrame:
        """Orders as contracts, for the payment analysis."""
        return self.raw("orders").select(
            F.concat(F.lit("O"), "o_orderkey").alias("id_contrato"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.floor(F.col("o_totalprice") / 2).cast("double")).alias("monto"),
            F.when(F.col("o_orderpriority") != "1-URGENT", F.lit("Licitación Pública")).alias("modalidad"),
            (F.col("o_orderdate") + F.expr("interval 25 years")).cast("timestamp").alias("fecha_contrato"),
            F.lit("goods").alias("categoria_principal"),
            F.col("o_orderpriority").alias("objeto"),
            F.col("o_orderstatus").alias("_status"),
        )

    @cached_property
    def settled_orders(self) -> DataFrame:
        """Without orders in progress, so that their payments are orphans."""
        return self.order_contracts.where(F.col("_status") != "P")

    @cached_property
    def order_payments(self) -> DataFrame:
        """Line items as payments of their order, among them payments of orders in progress."""
        return self.raw("lineitem").select(*self._payment_columns(F.concat(F.lit("O"), "l_orderkey")))

    # --- open contracting ---------------------------------------------------------

    @cached_property
    def ocds_main(self) -> DataFrame:
        return self.raw("orders").select(
            F.concat(F.lit("OC"), "o_orderkey").alias("ocid"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("B"), "o_custkey")).alias("buyer_id"),
            F.col("o_orderstatus").alias("tender_procurementMethodDetails"),
            F.col("o_orderpriority").alias("tender_mainProcurementCategory"),
        )

    @cached_property
    def ocds_contracts(self) -> DataFrame:
        deal(self.spark, self.raw("lineitem").count())
        lines = self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
        prefix = _pick(F.col("p_brand"), OBJECT_PREFIX, F.lit(""))
        return lines.select(
            F.concat(F.lit("OC"), "l_orderkey").alias("main_ocid"),
            self._line_id().alias("id"),
            F.concat(F.lit("A"), "l_linenumber").alias("awardID"),
            (F.floor("l_extendedprice") - 10_000).cast("string").alias("value_amount"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("dateSigned"),
            F.concat(prefix, "p_name").alias("description"),
        )

    @cached_property
    def ocds_awards(self) -> DataFrame:
        return self.raw("lineitem").where(F.col("l_returnflag") != "N").select(
            F.concat(F.lit("OC"), "l_orderkey").alias("main_ocid"),
            F.concat(F.lit("A"), "l_linenumber").alias("id"),
        )

    @cached_property
    def ocds_awards_suppliers(self) -> DataFrame:
        joined = self.raw("lineitem").join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        consortium = F.when(F.col("s_nationkey") < 5, F.lit("Consorcio ")).otherwise(F.lit(""))
        return joined.select(
            F.concat(F.lit("OC"), "l_orderkey").alias("main_ocid"),
            F.concat(F.lit("A"), "l_linenumber").alias("awards_id"),
            F.concat(F.lit("P"), "l_suppkey").alias("id"),
            F.concat(consortium, "s_name").alias("name"),
        )

    @cached_property
    def ocds_parties(self) -> DataFrame:
        """Suppliers, and one row per order for its buyer (so buyers repeat)."""
        supplier = self.raw("supplier").select(
            F.concat(F.lit("P"), "s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.lit("['tenderer', 'supplier']").alias("roles"),
            F.lpad(F.col("s_suppkey").cast("string"), 11, "0").alias("identifier_id"),
            F.concat(F.lit("D"), "s_nationkey").alias("address_streetAddress"),
            F.when(F.col("s_acctbal") > 0, F.concat(F.lit("T"), "s_nationkey")).alias("contactPoint_telephone"),
        )
        roles = {"BUILDING": "buyer;procuringEntity", "MACHINERY": "procuringEntity", "FURNITURE": "buyers"}
        buyer = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            F.concat(F.lit("B"), "c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            _pick(F.col("c_mktsegment"), roles, F.lit('["payer","buyer"]')).alias("roles"),
            F.lit(None).cast("string").alias("identifier_id"),
            F.concat(F.lit("D"), "c_nationkey").alias("address_streetAddress"),
            F.concat(F.lit("T"), "c_nationkey").alias("contactPoint_telephone"),
        )
        return supplier.unionByName(buyer)

    # --- derived ---------------------------------------------------------------------

    @cached_property
    def state(self) -> dict:
        return fit_preprocessor(self.contracts)

    @cached_property
    def prepared(self) -> DataFrame:
        return apply_preprocessor(self.training, self.state)


# --- the same domains as SQL -----------------------------------------------------------

_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"


def _case(column: str, choices: dict[str, str], other: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in choices.items())
    return f"CASE {column} {whens}{f' ELSE {other}' if other else ''} END"


def _payment_sql(contract: str) -> str:
    return f"""'G' || {_LINE_ID} AS id_pago, {contract} AS id_contrato, l_shipdate AS fecha_devengado,
      l_shipdate AS fecha_girado, l_shipdate + to_days(CAST(l_quantity - 5 AS INTEGER)) AS fecha_pagado,
      floor(l_extendedprice) AS monto_devengado, floor(l_extendedprice * (1 - l_discount)) AS monto_pagado,
      l_linestatus AS estado"""


_OBJECT_SQL = f"{_case('p_brand', OBJECT_PREFIX, chr(39) * 2)} || p_name"

VIEWS = {
    "training": f"""
    SELECT {_LINE_ID} AS id_contrato, 'P' || l_suppkey AS id_proveedor, 'E' || c_nationkey AS id_entidad,
      CASE WHEN l_tax < 0.08 THEN 'F' || o_custkey END AS id_funcionario,
      CASE WHEN l_discount <> 0.05 OR l_tax <> 0.03 THEN floor(l_extendedprice * 10) END AS monto,
      l_shipdate + INTERVAL 25 YEAR AS fecha_contrato,
      CASE WHEN l_quantity < 50 THEN
        CASE WHEN l_returnflag = 'R' THEN '{DIRECT_AWARD}' WHEN l_returnflag = 'A' THEN '{PRICE_COMPARISON}'
             WHEN l_linestatus = 'O' THEN 'Adjudicación Simplificada'
             WHEN l_quantity < 25 THEN 'Licitación Pública' ELSE 'Licitación Pública Abreviada' END
      END AS modalidad,
      CASE WHEN p_size < 50 THEN {_OBJECT_SQL} END AS objeto,
      {_case('p_type', CATEGORY_OF_TYPE)} AS categoria_principal,
      (l_quantity >= 49 AND l_returnflag = 'R' AND l_discount >= 0.05) AS label_favoritismo,
      (l_quantity >= 48 AND l_linestatus = 'O') AS label_fraccionamiento
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN part ON l_partkey = p_partkey""",
    "contracts": "SELECT * EXCLUDE (label_favoritismo, label_fraccionamiento) FROM training",
    "suppliers": """
    SELECT 'P' || s_suppkey AS id_proveedor, s_name AS nombre_proveedor,
      lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS ruc, 'T' || s_nationkey AS telefono,
      CASE WHEN s_acctbal > 0 THEN 'D' || CAST(floor(s_acctbal / 100) AS BIGINT) END AS direccion
    FROM supplier""",
    "entities": """
    SELECT 'E' || n_nationkey AS id_entidad, n_name AS nombre_entidad, ' T' || n_nationkey AS telefono,
      'D' || n_nationkey || ' ' AS direccion FROM nation""",
    "officials": """
    SELECT 'F' || c_custkey AS id_funcionario, 'E' || c_nationkey AS id_entidad, c_name AS nombre_funcionario,
      lower(c_name) || '@example.org' AS email, 'T' || c_nationkey AS telefono,
      CASE WHEN c_acctbal > 0 THEN 'D' || CAST(floor(c_acctbal / 100) AS BIGINT) END AS direccion
    FROM customer""",
    "payments": f"SELECT {_payment_sql(_LINE_ID)} FROM lineitem",
    "order_contracts": """
    SELECT 'O' || o_orderkey AS id_contrato,
      CASE WHEN o_orderpriority <> '5-LOW' THEN floor(o_totalprice / 2) END AS monto,
      CASE WHEN o_orderpriority <> '1-URGENT' THEN 'Licitación Pública' END AS modalidad,
      o_orderdate + INTERVAL 25 YEAR AS fecha_contrato, 'goods' AS categoria_principal, o_orderpriority AS objeto,
      o_orderstatus AS _status FROM orders""",
    "settled_orders": "SELECT * FROM order_contracts WHERE _status <> 'P'",
    "order_payments": f"SELECT {_payment_sql(chr(39) + 'O' + chr(39) + ' || l_orderkey')} FROM lineitem",
    "ocds_main": """
    SELECT 'OC' || o_orderkey AS ocid, CASE WHEN o_orderpriority <> '5-LOW' THEN 'B' || o_custkey END AS buyer_id,
      o_orderstatus AS tender_procurementMethodDetails, o_orderpriority AS tender_mainProcurementCategory
    FROM orders""",
    "ocds_contracts": f"""
    SELECT 'OC' || l_orderkey AS main_ocid, {_LINE_ID} AS id, 'A' || l_linenumber AS "awardID",
      floor(l_extendedprice) - 10000 AS value_amount, l_shipdate AS "dateSigned", {_OBJECT_SQL} AS description
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "ocds_awards": """
    SELECT 'OC' || l_orderkey AS main_ocid, 'A' || l_linenumber AS id FROM lineitem WHERE l_returnflag <> 'N'""",
    "ocds_awards_suppliers": """
    SELECT 'OC' || l_orderkey AS main_ocid, 'A' || l_linenumber AS awards_id, 'P' || l_suppkey AS id,
      CASE WHEN s_nationkey < 5 THEN 'Consorcio ' ELSE '' END || s_name AS name
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "ocds_parties": """
    SELECT 'P' || s_suppkey AS id, s_name AS name, '[''tenderer'', ''supplier'']' AS roles,
      lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS identifier_id, 'D' || s_nationkey AS "address_streetAddress",
      CASE WHEN s_acctbal > 0 THEN 'T' || s_nationkey END AS "contactPoint_telephone" FROM supplier
    UNION ALL
    SELECT 'B' || c_custkey, c_name,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'buyer;procuringEntity' WHEN 'MACHINERY' THEN 'procuringEntity'
        WHEN 'FURNITURE' THEN 'buyers' ELSE '["payer","buyer"]' END,
      NULL, 'D' || c_nationkey, 'T' || c_nationkey
    FROM orders JOIN customer ON o_custkey = c_custkey""",
    # --- derived
    "medians": """
    SELECT objeto, quantile_cont(monto, 0.5) AS monto_mediana FROM training
    WHERE objeto IS NOT NULL AND monto IS NOT NULL GROUP BY objeto""",
    "partly": """
    SELECT c.*, coalesce(c.monto, m.monto_mediana) AS monto_parcial
    FROM training c LEFT JOIN medians m ON c.objeto = m.objeto""",
    "overall": "SELECT quantile_cont(monto_parcial, 0.5) AS mediana_global FROM partly",
    "cap": "SELECT quantile_cont(coalesce(monto_parcial, mediana_global), 0.99) AS monto_p99 FROM partly, overall",
    "modes": """
    SELECT
      (SELECT modalidad FROM training WHERE modalidad IS NOT NULL GROUP BY modalidad
       ORDER BY count(*) DESC, modalidad LIMIT 1) AS modalidad_moda,
      (SELECT objeto FROM training WHERE objeto IS NOT NULL GROUP BY objeto
       ORDER BY count(*) DESC, objeto LIMIT 1) AS objeto_moda""",
    "prepared": f"""
    SELECT id_contrato, id_proveedor, id_entidad, coalesce(id_funcionario, '__NO_DISPONIBLE__') AS id_funcionario,
      coalesce(monto_parcial, mediana_global) AS monto, fecha_contrato,
      coalesce(modalidad, modalidad_moda) AS modalidad, coalesce(objeto, objeto_moda) AS objeto, categoria_principal,
      label_favoritismo, label_fraccionamiento,
      least(coalesce(monto_parcial, mediana_global), monto_p99) AS monto_capped,
      coalesce(modalidad, modalidad_moda) = '{DIRECT_AWARD}' AS es_contratacion_directa,
      coalesce(modalidad, modalidad_moda) = '{PRICE_COMPARISON}' AS es_comparacion_precios
    FROM partly, overall, cap, modes""",
}
_NEEDS = {
    "contracts": ["training"],
    "settled_orders": ["order_contracts"],
    "medians": ["training"],
    "partly": ["medians"],
    "overall": ["partly"],
    "cap": ["overall"],
    "modes": ["training"],
    "prepared": ["cap", "modes"],
}


def define(name: str, body: str, *needs: str) -> None:
    """Add a derived view that checks share."""
    VIEWS[name] = body
    _NEEDS[name] = list(needs)


def with_views(names: str, query: str) -> str:
    """The query after the definitions of the named views and of what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        visit(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in ordered)
    return f"WITH {parts}\n{query}"
