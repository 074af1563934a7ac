"""Checks of mapping, casts, gates, text and dated rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.checks.proxies import Tables, define
from atalaya.checks.registry import check, day, rounded
from atalaya.functions import norms, text
from atalaya.functions.amounts import accrual_delay_days, cap_amount, cast_boolean, modality_flags, year_month
from atalaya.operators import contract, explore, opendata, payments, quality
from atalaya.plans.integrate import integrate_domains

DIRECT = "Contratación Directa"

# --- physical source with text columns, some of them invalid --------------------------


def physical_contracts(t: Tables) -> DataFrame:
    bad_amount = (F.col("l_quantity") == 7) & (F.col("l_tax") == 0.01)
    bad_date = (F.col("l_quantity") == 8) & (F.col("l_tax") == 0.02)
    no_entity = (F.col("l_quantity") == 9) & (F.col("l_tax") == 0.04)
    words = F.when(F.col("l_returnflag") == "R", F.lit(" SÍ ")).when(F.col("l_returnflag") == "A", F.lit("no"))
    return t.raw("lineitem").select(
        t._line_id().alias("NRO_CONTRATO"),
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("COD_PROV"),
        F.when(~no_entity, F.col("l_linenumber").cast("string")).alias("SEC_EJEC"),
        F.when(bad_amount, F.lit("NO_ES_NUMERO")).otherwise(F.floor("l_extendedprice").cast("string")).alias("IMP_ADJ"),
        F.when(bad_date, F.lit("mañana")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("FEC_SUSC"),
        F.col("l_returnflag").alias("TIP_PROC"),
        F.col("l_linestatus").alias("DESC_OBJ"),
        F.lit("goods").alias("CAT_PRINC"),
        F.coalesce(words, F.lit("quizás")).alias("GT_FAV"),
        F.when(F.col("l_linestatus") == "O", F.lit("1")).otherwise(F.lit("0")).alias("GT_FRAC"),
        F.lit("sobra").alias("NO_CANONICA"),
    )


MAPPING = {
    "id_contrato": "NRO_CONTRATO", "id_proveedor": "COD_PROV", "id_entidad": "SEC_EJEC", "monto": "IMP_ADJ",
    "fecha_contrato": "FEC_SUSC", "modalidad": "TIP_PROC", "objeto": "DESC_OBJ", "categoria_principal": "CAT_PRINC",
    "label_favoritismo": "GT_FAV", "label_fraccionamiento": "GT_FRAC",
}
define(
    "physical",
    """
    SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS id_contrato,
      lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS id_proveedor,
      CASE WHEN NOT (l_quantity = 9 AND l_tax = 0.04) THEN CAST(l_linenumber AS VARCHAR) END AS id_entidad,
      CASE WHEN l_quantity = 7 AND l_tax = 0.01 THEN 'NO_ES_NUMERO'
           ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS monto,
      CASE WHEN l_quantity = 8 AND l_tax = 0.02 THEN 'mañana' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS fecha_contrato,
      l_returnflag AS modalidad, l_linestatus AS objeto, 'goods' AS categoria_principal,
      CASE l_returnflag WHEN 'R' THEN ' SÍ ' WHEN 'A' THEN 'no' ELSE 'quizás' END AS label_favoritismo,
      CASE WHEN l_linestatus = 'O' THEN '1' ELSE '0' END AS label_fraccionamiento
    FROM lineitem""",
)
_TRUTH = """CASE WHEN lower(trim({0})) IN ('1', 'true', 't', 'si', 'sí', 'yes', 'y') THEN TRUE
     WHEN lower(trim({0})) IN ('0', 'false', 'f', 'no', 'n') THEN FALSE END"""


@check("map_canonical", "SELECT * FROM physical", "physical")
def _(t: Tables) -> DataFrame:
    return contract.map_canonical(physical_contracts(t), "contracts", MAPPING)


def _invalid(column: str, value: str) -> str:
    return (
        f"SELECT 'invalid' AS regla, '{column}' AS columna, "
        f"CAST(count(*) FILTER (WHERE {column} IS NOT NULL AND {value} IS NULL) AS BIGINT) AS n FROM physical"
    )


def _nulls(column: str, value: str) -> str:
    return (
        f"SELECT 'null' AS regla, '{column}' AS columna, "
        f"CAST(count(*) FILTER (WHERE {value} IS NULL) AS BIGINT) AS n FROM physical"
    )


_CASTS = {
    "monto": "TRY_CAST(monto AS DOUBLE)",
    "fecha_contrato": "TRY_CAST(fecha_contrato AS TIMESTAMP)",
    "label_favoritismo": _TRUTH.format("label_favoritismo"),
    "label_fraccionamiento": _TRUTH.format("label_fraccionamiento"),
}
_STRICT = ["id_contrato", "id_proveedor", "id_entidad", "fecha_contrato", "label_favoritismo", "label_fraccionamiento"]


@check(
    "cast_canonical",
    " UNION ALL ".join(
        [_invalid(c, v) for c, v in _CASTS.items()] + [_nulls(c, _CASTS.get(c, c)) for c in _STRICT]
    ),
    "physical",
)
def _(t: Tables) -> DataFrame:
    mapped = contract.map_canonical(physical_contracts(t), "contracts", MAPPING)
    return contract.contract_report(contract.cast_canonical(mapped, "contracts", "training"))


@check(
    "cast_boolean",
    f"SELECT label_favoritismo AS texto, {_TRUTH.format('label_favoritismo')} AS valor, count(*) AS n "
    "FROM physical GROUP BY ALL",
    "physical",
)
def _(t: Tables) -> DataFrame:
    raw = physical_contracts(t).select(F.col("GT_FAV").alias("texto"), cast_boolean(F.col("GT_FAV")).alias("valor"))
    return raw.groupBy("texto", "valor").agg(F.count(F.lit(1)).alias("n"))


@check("null_contract", " UNION ALL ".join(_nulls(c, _CASTS.get(c, c)) for c in _STRICT), "physical")
def _(t: Tables) -> DataFrame:
    mapped = contract.map_canonical(physical_contracts(t), "contracts", MAPPING)
    return contract.null_contract(mapped, "contracts", "training")


@check(
    "integrate_domains",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dominio, count(*) AS filas FROM {v}"
        for d, v in {
            "contracts": "contracts", "suppliers": "suppliers", "entities": "entities",
            "officials": "officials", "payments": "payments",
        }.items()
    ),
    "contracts suppliers entities officials payments",
)
def _(t: Tables) -> DataFrame:
    domains = {
        "contracts": t.contracts, "suppliers": t.suppliers, "entities": t.entities,
        "officials": t.officials, "payments": t.payments,
    }
    mapping = {}
    for name, df in domains.items():
        df.createOrReplaceTempView(f"fuente_{name}")
        mapping[name] = {c: c for c in df.columns if c in contract.DOMAINS[name].names}
    config = {
        "mode": "inference",
        "source": {"type": "spark_sql", "tables": {name: f"fuente_{name}" for name in domains}},
        "mapping": mapping,
    }
    _, summary = integrate_domains(config, t.spark)
    rows = [(name, part["rows"]) for name, part in summary["domains"].items()]
    return t.spark.createDataFrame(rows, "dominio string, filas bigint")


# --- gates ------------------------------------------------------------------------------


@check(
    "pk_unique",
    """
    WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS filas, count(*) AS claves_distintas,
      count(*) FILTER (WHERE n > 1) AS claves_duplicadas,
      CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS filas_afectadas,
      CAST(sum(n) - count(*) AS BIGINT) AS filas_excedentes FROM k""",
)
def _(t: Tables) -> DataFrame:
    return quality.pk_unique(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@check(
    "duplicate_sample",
    """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
    ORDER BY l_orderkey, l_linenumber LIMIT 5""",
)
def _(t: Tables) -> DataFrame:
    return quality.duplicate_sample(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@check(
    "blank_ids",
    """
    SELECT 'id_proveedor' AS columna, count(*) FILTER (WHERE l_tax = 0.02) AS n_vacios FROM lineitem
    UNION ALL SELECT 'id_contrato', 0 FROM (SELECT count(*) FROM lineitem)""",
)
def _(t: Tables) -> DataFrame:
    ids = t.raw("lineitem").select(
        F.when(F.col("l_tax") == 0.02, F.lit("   ")).otherwise(F.col("l_suppkey").cast("string")).alias("id_proveedor"),
        t._line_id().alias("id_contrato"),
    )
    return quality.blank_ids(ids, ["id_proveedor", "id_contrato"])


@check("negative_amounts", "SELECT count(*) FILTER (WHERE c_acctbal < 0) AS n_negativos FROM customer")
def _(t: Tables) -> DataFrame:
    return quality.negative_amounts(t.raw("customer"), "c_acctbal")


@check(
    "fk_orphans",
    """
    , huerfanas AS (SELECT DISTINCT id_contrato AS clave FROM order_payments WHERE id_contrato NOT IN
        (SELECT id_contrato FROM settled_orders))
    SELECT (SELECT count(*) FROM huerfanas) AS n_huerfanas,
      (SELECT string_agg(clave, ',' ORDER BY clave) FROM (SELECT clave FROM huerfanas ORDER BY clave LIMIT 5)) AS muestra""",
    "settled_orders order_payments",
)
def _(t: Tables) -> DataFrame:
    return quality.fk_orphans(t.order_payments, "id_contrato", t.settled_orders, "id_contrato")


def _gate_sql(domain: str, view: str, key: str, ids: list[str], amount: bool) -> str:
    def row(rule: str, column: str, value: str) -> str:
        return f"SELECT '{domain}' AS dominio, '{rule}' AS regla, '{column}' AS columna, CAST({value} AS BIGINT) AS valor FROM {view}"

    distinct = f"count(DISTINCT {key})"
    repeated = f"(SELECT {{}} FROM (SELECT count(*) AS n FROM {view} GROUP BY {key}) WHERE n > 1)"
    rows = [
        row("filas", "", "count(*)"),
        row("claves_distintas", "", distinct),
        row("filas_excedentes", "", f"count(*) - {distinct}"),
        row("claves_duplicadas", "", repeated.format("count(*)")),
        row("filas_afectadas", "", repeated.format("coalesce(sum(n), 0)")),
        *[row("vacio", c, f"count(*) FILTER (WHERE trim({c}) = '')") for c in ids],
    ]
    if amount:
        rows.append(row("negativo", "monto", "count(*) FILTER (WHERE monto < 0)"))
    # A row built from a scalar subquery would repeat for every row of the table.
    return " UNION ALL ".join(f"SELECT DISTINCT * FROM ({r})" for r in rows)


def _orphans_sql(child: str, child_view: str, column: str, parent: str, parent_view: str | None) -> str:
    value = "CAST(NULL AS BIGINT)" if parent_view is None else (
        f"(SELECT count(DISTINCT {column}) FROM {child_view} WHERE {column} IS NOT NULL "
        f"AND {column} NOT IN (SELECT {column} FROM {parent_view}))"
    )
    return f"SELECT '{child}' AS dominio, 'huerfanas' AS regla, '{child}.{column}->{parent}.{column}' AS columna, {value} AS valor"


_REPORT = " UNION ALL ".join([
    _gate_sql("contracts", "contracts", "id_contrato", ["id_contrato", "id_proveedor", "id_entidad", "id_funcionario"], True),
    _gate_sql("suppliers", "suppliers", "id_proveedor", ["id_proveedor"], False),
    _gate_sql("entities", "entities", "id_entidad", ["id_entidad"], False),
    _gate_sql("payments", "order_payments", "id_pago", ["id_contrato", "id_pago"], False),
    _orphans_sql("contracts", "contracts", "id_proveedor", "suppliers", "suppliers"),
    _orphans_sql("contracts", "contracts", "id_entidad", "entities", "entities"),
    _orphans_sql("contracts", "contracts", "id_funcionario", "officials", None),
    _orphans_sql("payments", "order_payments", "id_contrato", "contracts", "contracts"),
])


@check(
    "quality_report",
    f"""
    SELECT *, CASE WHEN valor IS NULL THEN 'skipped_parent_not_configured'
      WHEN regla IN ('filas', 'claves_distintas') OR valor = 0 THEN 'ok' ELSE 'error' END AS estado
    FROM ({_REPORT})""",
    "contracts suppliers entities order_payments",
)
def _(t: Tables) -> DataFrame:
    return quality.quality_report(
        {"contracts": t.contracts, "suppliers": t.suppliers, "entities": t.entities, "payments": t.order_payments}
    )


@check(
    "orphan_payments",
    "SELECT count(*) AS orphan_payments FROM order_payments WHERE id_contrato NOT IN (SELECT id_contrato FROM settled_orders)",
    "settled_orders order_payments",
)
def _(t: Tables) -> DataFrame:
    return quality.orphan_payments(t.order_payments, t.settled_orders)


@check(
    "publish_gate_pk",
    """
    SELECT count(*) AS filas, count(*) FILTER (WHERE id_proveedor IS NULL OR id_funcionario IS NULL) AS nulos,
      count(*) FILTER (WHERE id_proveedor IS NOT NULL AND id_funcionario IS NOT NULL) AS completas,
      count(DISTINCT CASE WHEN id_proveedor IS NOT NULL AND id_funcionario IS NOT NULL
        THEN id_proveedor || '/' || id_funcionario END) AS distintas
    FROM contracts""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    key = ["id_proveedor", "id_funcionario"]
    gate = quality.publish_gate_pk(t.contracts, key)
    return gate.select(
        "filas", "nulos", (F.col("filas") - F.col("nulos")).alias("completas"),
        (F.col("filas") - F.col("duplicados")).alias("distintas"),
    )


@check(
    "publish_gate_range",
    """
    SELECT 'l_discount' AS columna, count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 1 OR l_discount IS NULL) AS n_fuera FROM lineitem
    UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity NOT BETWEEN 0 AND 1 OR l_quantity IS NULL) FROM lineitem
    UNION ALL SELECT 'l_returnflag', count(*) FROM lineitem""",
)
def _(t: Tables) -> DataFrame:
    return quality.publish_gate_range(t.raw("lineitem"), ["l_discount", "l_quantity", "l_returnflag"])


# --- text -------------------------------------------------------------------------------


def norm_sql(x: str) -> str:
    return f"coalesce(trim(regexp_replace(strip_accents(lower(trim({x}))), '[^a-z0-9]+', ' ', 'g')), '')"


_STOPS = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_SYNONYM = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SYNONYMS.items()) + " ELSE x END"


def tokens_sql(x: str) -> str:
    kept = f"list_filter(string_split({norm_sql(x)}, ' '), lambda x: x <> '' AND NOT list_contains({_STOPS}, x))"
    return f"list_filter(list_transform({kept}, lambda x: {_SYNONYM}), lambda x: NOT list_contains({_STOPS}, x))"


def family_sql(x: str, category: str | None) -> str:
    group = "'sin_categoria'" if category is None else f"coalesce(nullif({norm_sql(category)}, ''), 'sin_categoria')"
    words = f"array_to_string(list_sort(list_distinct({tokens_sql(x)})), '|')"
    return f"{group} || '::' || coalesce(nullif({words}, ''), '__SIN_OBJETO__')"


@check("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS huella, length({norm_sql('text')}) AS largo FROM documents")
def _(t: Tables) -> DataFrame:
    plain = text.normalize_text(F.col("text"))
    return t.raw("documents").select(
        "doc_id", F.md5(plain).alias("huella"), F.length(plain).cast("bigint").alias("largo")
    )


@check(
    "tokens_filtered",
    f"SELECT doc_id, md5(array_to_string({tokens_sql('text')}, ' ')) AS huella, len({tokens_sql('text')}) AS n FROM documents",
)
def _(t: Tables) -> DataFrame:
    tokens = text.tokens_filtered(F.col("text"))
    return t.raw("documents").select(
        "doc_id", F.md5(F.array_join(tokens, " ")).alias("huella"), F.size(tokens).cast("bigint").alias("n")
    )


@check("object_family", f"SELECT doc_id, md5({family_sql('text', 'lang')}) AS huella FROM documents")
def _(t: Tables) -> DataFrame:
    family = text.object_family(F.col("text"), F.col("lang"))
    return t.raw("documents").select("doc_id", F.md5(family).alias("huella"))


@check(
    "object_family_contracts",
    f"SELECT {family_sql('objeto', 'categoria_principal')} AS objeto_familia, count(*) AS n FROM contracts GROUP BY ALL",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    family = text.object_family(F.col("objeto"), F.col("categoria_principal"))
    return t.contracts.groupBy(family.alias("objeto_familia")).agg(F.count(F.lit(1)).alias("n"))


def _pattern_sql(pattern: str) -> str:
    # Word boundaries of RE2 know ASCII only, so they are spelled out.
    spelled = pattern.replace(r"\bobra\b", r"(^|[^\p{L}\p{N}_])obra([^\p{L}\p{N}_]|$)")
    return spelled.replace("'", "''")


def categorize_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{_pattern_sql(p)}') THEN '{n}'" for n, p in text.OBJECT_CATEGORIES)
    return f"CASE {whens} ELSE '{text.OTHER_CATEGORY}' END"


@check("categorize_text", f"SELECT doc_id, {categorize_sql('text')} AS categoria FROM documents")
def _(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.categorize_text(F.col("text")).alias("categoria"))


@check(
    "categorize_objects",
    f"SELECT objeto, {categorize_sql('objeto')} AS categoria, count(*) AS n FROM contracts GROUP BY ALL",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return t.contracts.groupBy("objeto", text.categorize_text(F.col("objeto")).alias("categoria")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _role_sql(role: str) -> str:
    return f"""regexp_matches(roles, '(?:^|[,;\\s\\[\\]''"]){role}(?:$|[,;\\s\\[\\]''"])')"""


@check(
    "role_contains",
    f"""SELECT roles, {_role_sql('buyer')} AS comprador, {_role_sql('procuringEntity')} AS contratante,
        count(*) AS n FROM ocds_parties GROUP BY ALL""",
    "ocds_parties",
)
def _(t: Tables) -> DataFrame:
    flags = t.ocds_parties.select(
        "roles",
        text.role_contains(F.col("roles"), "buyer").alias("comprador"),
        text.role_contains(F.col("roles"), "procuringEntity").alias("contratante"),
    )
    return flags.groupBy("roles", "comprador", "contratante").agg(F.count(F.lit(1)).alias("n"))


@check(
    "consortium_flag",
    """SELECT name, regexp_matches(name, '(?i)(^|[^\\p{L}\\p{N}_])CONSORCIO([^\\p{L}\\p{N}_]|$)') AS es_consorcio,
       count(*) AS n FROM ocds_awards_suppliers GROUP BY ALL""",
    "ocds_awards_suppliers",
)
def _(t: Tables) -> DataFrame:
    return t.ocds_awards_suppliers.groupBy("name", text.consortium_flag(F.col("name")).alias("es_consorcio")).agg(
        F.count(F.lit(1)).alias("n")
    )


@check("composite_contract_id", "SELECT main_ocid || '::' || id AS id_contrato FROM ocds_contracts", "ocds_contracts")
def _(t: Tables) -> DataFrame:
    return t.ocds_contracts.select(opendata.composite_contract_id(F.col("main_ocid"), F.col("id")).alias("id_contrato"))


# --- amounts and dates --------------------------------------------------------------------


@check(
    "modality_flags",
    f"""SELECT modalidad, modalidad = '{DIRECT}' AS es_contratacion_directa,
        modalidad = 'Comparación de Precios' AS es_comparacion_precios, count(*) AS n FROM contracts GROUP BY ALL""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    flags = [expr.alias(name) for name, expr in modality_flags(F.col("modalidad")).items()]
    return t.contracts.groupBy("modalidad", *flags).agg(F.count(F.lit(1)).alias("n"))


@check("cap_amount", "SELECT id_contrato, CASE WHEN monto > 500000 THEN 500000.0 ELSE monto END AS monto_capped FROM contracts", "contracts")
def _(t: Tables) -> DataFrame:
    return t.contracts.select("id_contrato", cap_amount(F.col("monto"), 500_000.0).alias("monto_capped"))


@check(
    "payment_ratio_status",
    """
    , r AS (SELECT o.id_contrato, o.monto, count(p.id_pago) AS n, coalesce(sum(p.monto_pagado), 0) AS pagado
      FROM order_contracts o LEFT JOIN order_payments p ON o.id_contrato = p.id_contrato GROUP BY ALL)
    SELECT id_contrato, round(CASE WHEN monto > 0 THEN pagado / monto END, 6) AS ratio_pagado_contrato,
      CASE WHEN n = 0 OR NOT coalesce(monto > 0, FALSE) THEN 'sin_pago_o_sin_cuantia'
        WHEN pagado / monto <= 0.01 THEN 'pendiente_sin_pago' WHEN pagado / monto < 0.98 THEN 'pago_parcial'
        WHEN pagado / monto > 1.02 THEN 'sobrepago_senal_revisar'
        ELSE 'pagado_aproximadamente_completo' END AS estado_pago_analitico
    FROM r""",
    "order_contracts order_payments",
)
def _(t: Tables) -> DataFrame:
    summary = payments.payments_per_contract(t.order_contracts, t.order_payments)
    return rounded(
        summary.select("id_contrato", "ratio_pagado_contrato", "estado_pago_analitico"), 6, "ratio_pagado_contrato"
    )


@check(
    "accrual_delay_days",
    "SELECT id_pago, CAST(date_diff('day', fecha_devengado, fecha_pagado) AS BIGINT) AS dias FROM order_payments",
    "order_payments",
)
def _(t: Tables) -> DataFrame:
    days = accrual_delay_days(F.col("fecha_devengado"), F.col("fecha_pagado"))
    return t.order_payments.select("id_pago", days.cast("bigint").alias("dias"))


@check(
    "year_month",
    "SELECT strftime(fecha_contrato, '%Y-%m') AS anio_mes, count(*) AS n FROM contracts GROUP BY ALL",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return t.contracts.groupBy(year_month(F.col("fecha_contrato")).alias("anio_mes")).agg(F.count(F.lit(1)).alias("n"))


# --- dated rules ------------------------------------------------------------------------------

_CATEGORY = """CASE WHEN lower(trim(categoria_principal)) IN ('works', 'obra', 'obras') THEN 'obras'
  WHEN lower(trim(categoria_principal)) IN ('goods', 'services', 'consultingservices', 'consulting services',
    'bienes', 'servicios', 'consultoria', 'consultoría') THEN 'bienes_servicios' END"""
_WORKS = f"""coalesce(({_CATEGORY}) = 'obras', regexp_matches(lower(objeto), '{"|".join(norms.WORKS_WORDS)}'), FALSE)"""
_TYPE = """CASE WHEN lower(trim(categoria_principal)) IN ('works', 'obra', 'obras') THEN 'works'
  WHEN lower(trim(categoria_principal)) IN ('goods', 'bien', 'bienes') THEN 'goods'
  WHEN lower(trim(categoria_principal)) IN ('services', 'servicio', 'servicios', 'consultingservices',
    'consulting services') THEN 'services' END"""
_REGIME = "CASE WHEN fecha_contrato >= TIMESTAMP '2025-04-22' THEN 'Ley 32069' ELSE 'Ley 30225' END"
_THRESHOLD_ROWS = ", ".join(
    f"({year}, '{name}', {amount}::DOUBLE)" for year, row in norms.THRESHOLDS.items() for name, amount in row.items()
)
define("umbrales", f"SELECT * FROM (VALUES {_THRESHOLD_ROWS}) AS v(anio, categoria_umbral, umbral)")
define(
    "reglas",
    f"""
    SELECT c.*, {_REGIME} AS regimen, {_WORKS} AS es_obra, {_TYPE} AS tipo, {_CATEGORY} AS categoria,
      CASE WHEN {_WORKS} THEN 'obras' ELSE 'bienes_servicios' END AS categoria_umbral, u.umbral
    FROM contracts c LEFT JOIN umbrales u ON u.anio = year(c.fecha_contrato)
      AND u.categoria_umbral = CASE WHEN {_WORKS} THEN 'obras' ELSE 'bienes_servicios' END""",
    "contracts",
    "umbrales",
)
define(
    "procedimientos",
    """
    SELECT *, CASE WHEN monto IS NULL THEN NULL WHEN monto < umbral THEN nombre
        WHEN tipo = 'services' THEN 'Concurso Público' WHEN tipo IN ('goods', 'works') OR es_obra THEN 'Licitación Pública'
        ELSE 'Licitación/Concurso Público' END AS procedimiento
    FROM (SELECT *, CASE WHEN regimen = 'Ley 30225' THEN 'Adjudicación Simplificada'
        WHEN es_obra OR tipo = 'goods' THEN 'Licitación Pública Abreviada'
        WHEN tipo = 'services' THEN 'Concurso Público Abreviado'
        ELSE 'Licitación/Concurso Público Abreviado' END AS nombre FROM reglas)""",
    "reglas",
)
_SPECIAL = "|".join(norms.SPECIAL_MODALITIES)
define(
    "clasificados",
    f"""
    SELECT *, CASE WHEN coalesce(trim(modalidad), '') = '' THEN 'sin_informacion'
      WHEN regexp_matches(strip_accents(lower(modalidad)), '{_SPECIAL}') THEN 'especial_no_inferible_por_cuantia'
      WHEN procedimiento IS NULL THEN 'sin_cuantia_para_comparar'
      WHEN lower(modalidad) = lower(procedimiento)
        OR (procedimiento = 'Licitación/Concurso Público Abreviado'
            AND modalidad IN ('Licitación Pública Abreviada', 'Concurso Público Abreviado'))
        OR (procedimiento = 'Licitación/Concurso Público' AND modalidad IN ('Licitación Pública', 'Concurso Público'))
        THEN 'compatible_referencial_por_cuantia'
      ELSE 'requiere_revision_contexto' END AS clasificacion_modalidad
    FROM procedimientos""",
    "procedimientos",
)
def _rule_columns() -> dict:
    """The dated rules as columns of the contracts view, by query name."""
    date, amount, text_, category = (F.col(c) for c in ("fecha_contrato", "monto", "objeto", "categoria_principal"))
    return {
        "normalize_category": norms.normalize_category(category),
        "is_works": norms.is_works(text_, category),
        "threshold_category": norms.threshold_category(text_, category),
        "regime": norms.regime(date),
        "threshold": norms.threshold(date, text_, category),
        "structured_type": norms.structured_type(category),
        "procedure_name": norms.procedure_name(date, text_, category),
        "procedure_by_amount": norms.procedure_by_amount(date, amount, text_, category),
        "classify_modality_expression": norms.classify_modality(date, amount, F.col("modalidad"), text_, category),
        "normative_context": norms.normative_context(date, text_, category),
    }


def _rule_check(name: str, column: str) -> None:
    @check(name, f"SELECT id_contrato, {column} AS valor FROM procedimientos", "procedimientos")
    def _(t: Tables) -> DataFrame:
        return t.contracts.select("id_contrato", _rule_columns()[name].alias("valor"))


_rule_check("normalize_category", "categoria")
_rule_check("is_works", "es_obra")
_rule_check("threshold_category", "categoria_umbral")
_rule_check("regime", "regimen")
_rule_check("threshold", "umbral")
_rule_check("structured_type", "tipo")
_rule_check("procedure_name", "nombre")
_rule_check("procedure_by_amount", "procedimiento")


@check("classify_modality", "SELECT id_contrato, clasificacion_modalidad FROM clasificados", "clasificados")
def _(t: Tables) -> DataFrame:
    return norms.with_modality_class(t.contracts).select("id_contrato", "clasificacion_modalidad")


@check(
    "classify_modality_expression",
    "SELECT id_contrato, clasificacion_modalidad AS valor FROM clasificados",
    "clasificados",
)
def _(t: Tables) -> DataFrame:
    return t.contracts.select("id_contrato", _rule_columns()["classify_modality_expression"].alias("valor"))


@check(
    "threshold_join",
    """SELECT year(fecha_contrato) AS anio, categoria_umbral, umbral, count(*) AS n FROM reglas GROUP BY ALL""",
    "reglas",
)
def _(t: Tables) -> DataFrame:
    norms.require_known_years(t.contracts)
    joined = norms.threshold_join(t.contracts)
    return joined.groupBy(F.col("anio").cast("bigint").alias("anio"), "categoria_umbral", "umbral").agg(
        F.count(F.lit(1)).alias("n")
    )


def _sources_sql() -> str:
    rows = ", ".join(f"({year}, {len(entries)})" for year, entries in norms.SOURCES.items())
    return f"SELECT * FROM (VALUES {rows}) AS v(anio, n_fuentes)"


define("fuentes", _sources_sql())


@check(
    "normative_context",
    """
    SELECT id_contrato, year(fecha_contrato) AS anio, regimen, categoria_umbral, nombre AS procedimiento_referencial,
      umbral, CAST(coalesce(n_fuentes, 0) AS BIGINT) AS n_fuentes
    FROM procedimientos LEFT JOIN fuentes ON fuentes.anio = year(fecha_contrato)""",
    "procedimientos fuentes",
)
def _(t: Tables) -> DataFrame:
    context = t.contracts.select("id_contrato", _rule_columns()["normative_context"].alias("c"))
    return context.select(
        "id_contrato",
        F.col("c.anio").cast("bigint").alias("anio"),
        "c.regimen", "c.categoria_umbral", "c.procedimiento_referencial", "c.umbral",
        F.size("c.fuentes_normativas").cast("bigint").alias("n_fuentes"),
    )


# --- open data -----------------------------------------------------------------------------------


@check(
    "buyer_entities",
    f"""
    SELECT id AS id_entidad, name AS nombre_entidad, "address_streetAddress" AS direccion,
      "contactPoint_telephone" AS telefono, CAST(NULL AS VARCHAR) AS address_department
    FROM ocds_parties WHERE {_role_sql('buyer')} OR {_role_sql('procuringEntity')} GROUP BY ALL""",
    "ocds_parties",
)
def _(t: Tables) -> DataFrame:
    return opendata.buyer_entities(t.ocds_parties)


@check(
    "supplier_enrichment",
    """
    , p AS (SELECT DISTINCT id, identifier_id, "address_streetAddress" AS d, "contactPoint_telephone" AS t FROM ocds_parties)
    SELECT s.id AS id_proveedor, identifier_id AS ruc, s.name AS razon_social, d AS direccion, t AS telefono,
      regexp_matches(s.name, '(?i)\\bCONSORCIO\\b') AS es_consorcio
    FROM (SELECT DISTINCT id, name FROM ocds_awards_suppliers) s LEFT JOIN p ON s.id = p.id""",
    "ocds_parties ocds_awards_suppliers",
)
def _(t: Tables) -> DataFrame:
    return opendata.supplier_enrichment(t.ocds_parties, t.ocds_awards_suppliers)


define(
    "identidades",
    """
    SELECT main_ocid, awards_id AS award_id,
      CASE WHEN n > 1 THEN 'MULTISUPPLIER:' || substring(sha256(array_to_string(ids, '|')), 1, 16) ELSE ids[1] END AS id_proveedor,
      array_to_string(names, ' / ') AS razon_social_adjudicada,
      n > 1 OR regexp_matches(array_to_string(names, ' / '), '(?i)\\bCONSORCIO\\b') AS es_consorcio,
      CASE WHEN n > 1 THEN n END AS n_integrantes_consorcio,
      CASE WHEN n > 1 THEN array_to_string(ids, ';') END AS integrantes_consorcio
    FROM (SELECT main_ocid, awards_id, list_sort(list(DISTINCT id)) AS ids, list_sort(list(DISTINCT name)) AS names,
      count(DISTINCT id) AS n FROM ocds_awards_suppliers GROUP BY ALL)""",
    "ocds_awards_suppliers",
)


@check("award_supplier_identity", "SELECT * FROM identidades", "identidades")
def _(t: Tables) -> DataFrame:
    found = opendata.award_supplier_identity(t.ocds_awards_suppliers)
    return found.withColumn("n_integrantes_consorcio", F.col("n_integrantes_consorcio").cast("bigint"))


define(
    "resueltos",
    f"""
    SELECT c.main_ocid || '::' || c.id AS id_contrato, c.id AS id_contrato_fuente, c.main_ocid AS ocid, a.id AS award_id,
      i.id_proveedor, i.razon_social_adjudicada, i.es_consorcio, i.n_integrantes_consorcio, i.integrantes_consorcio,
      m.buyer_id AS id_entidad, m."tender_procurementMethodDetails" AS modalidad,
      m."tender_mainProcurementCategory" AS categoria_principal, c.description AS descripcion_contrato,
      {categorize_sql('c.description')} AS objeto, c.value_amount AS monto, strftime(c."dateSigned", '%Y-%m-%d') AS fecha_contrato
    FROM ocds_contracts c LEFT JOIN ocds_main m ON c.main_ocid = m.ocid
      LEFT JOIN (SELECT DISTINCT main_ocid, id FROM ocds_awards) a ON c.main_ocid = a.main_ocid AND c."awardID" = a.id
      LEFT JOIN identidades i ON a.main_ocid = i.main_ocid AND a.id = i.award_id""",
    "ocds_contracts", "ocds_main", "ocds_awards", "identidades",
)


def _resolved(t: Tables) -> DataFrame:
    joined = opendata.ocds_contract_award_supplier(t.ocds_main, t.ocds_contracts, t.ocds_awards, t.ocds_awards_suppliers)
    return joined.withColumn("n_integrantes_consorcio", F.col("n_integrantes_consorcio").cast("bigint"))


@check("ocds_contract_award_supplier", "SELECT * FROM resueltos", "resueltos")
def _(t: Tables) -> DataFrame:
    return day(_resolved(t), "fecha_contrato")


@check(
    "ocds_unresolved_counts",
    """SELECT count(*) AS contratos, count(*) FILTER (WHERE award_id IS NULL) AS sin_adjudicacion,
       count(*) FILTER (WHERE id_proveedor IS NULL) AS sin_proveedor FROM resueltos""",
    "resueltos",
)
def _(t: Tables) -> DataFrame:
    return opendata.unresolved_counts(_resolved(t))


@check(
    "ocds_valid_contracts",
    """SELECT DISTINCT * FROM resueltos WHERE monto > 0 AND fecha_contrato IS NOT NULL AND id_entidad IS NOT NULL
       AND id_proveedor IS NOT NULL AND award_id IS NOT NULL""",
    "resueltos",
)
def _(t: Tables) -> DataFrame:
    return day(opendata.ocds_valid_contracts(_resolved(t)), "fecha_contrato")


@check(
    "dedupe_first",
    """
    SELECT id_contrato, id_proveedor, monto FROM (
      SELECT *, row_number() OVER (PARTITION BY id_proveedor ORDER BY monto NULLS LAST, id_contrato) AS rn
      FROM (SELECT id_contrato, id_proveedor, monto FROM contracts)) WHERE rn = 1""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return opendata.dedupe_first(
        t.contracts.select("id_contrato", "id_proveedor", "monto"), ["id_proveedor"], ["monto", "id_contrato"]
    )


@check(
    "org_link_join",
    """
    , g AS (SELECT id_proveedor, id_entidad, count(*) AS n_contratos, sum(monto) AS monto_total FROM contracts GROUP BY ALL)
    SELECT g.*, coalesce(trim(s.telefono) = trim(e.telefono), FALSE) AS comparte_telefono,
      coalesce(trim(s.direccion) = trim(e.direccion), FALSE) AS comparte_direccion,
      coalesce(trim(s.telefono) = trim(e.telefono), FALSE) OR coalesce(trim(s.direccion) = trim(e.direccion), FALSE)
        AS senal_organizacional
    FROM g LEFT JOIN suppliers s ON g.id_proveedor = s.id_proveedor LEFT JOIN entities e ON g.id_entidad = e.id_entidad""",
    "contracts suppliers entities",
)
def _(t: Tables) -> DataFrame:
    return opendata.org_link_join(t.contracts, t.suppliers, t.entities)


@check(
    "value_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS columna, {c} AS valor, count(*) AS n FROM clasificados GROUP BY ALL"
        for c in ("regimen", "clasificacion_modalidad", "modalidad", "id_entidad", "categoria_principal")
    ),
    "clasificados",
)
def _(t: Tables) -> DataFrame:
    return explore.value_counts(
        norms.with_modality_class(t.contracts),
        ["regimen", "clasificacion_modalidad", "modalidad", "id_entidad", "categoria_principal"],
    )

