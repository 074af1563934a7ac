"""Checks of preprocessing, features, payments, exploration and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atalaya.checks.foundation import family_sql
from atalaya.checks.proxies import Tables, define
from atalaya.checks.registry import check, day, rounded
from atalaya.operators import drift, explore, favoritism, payments, preprocessing, splitting
from atalaya.operators.evaluation import KEY_JOINT, group_id
from atalaya.operators.ordering import approximate_quantiles
from atalaya.runtime import materialize, new_location
from atalaya.sources.readers import load_medians

# --- statistics that the preprocessor learns ------------------------------------------


@check("object_medians", "SELECT * FROM medians", "medians")
def _(t: Tables) -> DataFrame:
    return preprocessing.object_medians(t.contracts)


@check("object_medians_approximate")
def _(t: Tables) -> DataFrame:
    return preprocessing.object_medians(t.contracts, exact=False)


@check("join_medians", "SELECT id_contrato, CASE WHEN c.monto IS NULL THEN monto_mediana END AS mediana_objeto "
       "FROM contracts c LEFT JOIN medians m ON c.objeto = m.objeto", "contracts medians")
def _(t: Tables) -> DataFrame:
    joined = preprocessing.join_medians(t.contracts, preprocessing.object_medians(t.contracts))
    return joined.select("id_contrato", "mediana_objeto")


@check("join_medians_shuffled", "SELECT id_contrato, CASE WHEN c.monto IS NULL THEN monto_mediana END AS mediana_objeto "
       "FROM contracts c LEFT JOIN medians m ON c.objeto = m.objeto", "contracts medians")
def _(t: Tables) -> DataFrame:
    joined = preprocessing.join_medians(t.contracts, preprocessing.object_medians(t.contracts).hint("merge"))
    return joined.select("id_contrato", "mediana_objeto")


@check("global_median", "SELECT mediana_global FROM overall", "overall")
def _(t: Tables) -> DataFrame:
    return preprocessing.global_median(t.contracts, preprocessing.object_medians(t.contracts))


@check("amount_p99", "SELECT round(monto_p99, 4) AS monto_p99 FROM cap", "cap")
def _(t: Tables) -> DataFrame:
    medians = preprocessing.object_medians(t.contracts)
    overall = preprocessing.global_median(t.contracts, medians).first()["mediana_global"]
    return rounded(preprocessing.amount_p99(t.contracts, medians, overall), 4, "monto_p99")


@check("amount_p99_approximate")
def _(t: Tables) -> DataFrame:
    return approximate_quantiles(t.contracts, "monto", {"monto_p99": 0.99})


@check(
    "mode_value",
    """
    SELECT * FROM (SELECT 'modalidad' AS campo, modalidad AS valor, count(*) AS n FROM contracts WHERE modalidad IS NOT NULL
      GROUP BY ALL ORDER BY n DESC, valor LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'objeto', objeto, count(*) AS n FROM contracts WHERE objeto IS NOT NULL
      GROUP BY ALL ORDER BY n DESC, objeto LIMIT 1)""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return preprocessing.mode_values(t.contracts, ["modalidad", "objeto"])


@check(
    "fit_preprocessor",
    """SELECT modalidad_moda, objeto_moda, mediana_global, round(monto_p99, 4) AS monto_p99,
       (SELECT count(*) FROM medians) AS object_medians_count FROM modes, overall, cap""",
    "modes cap medians",
)
def _(t: Tables) -> DataFrame:
    path = new_location(t.spark, "medians")
    state = preprocessing.fit_preprocessor(t.contracts, medians_path=path)
    row = (
        state["modalidad_moda"], state["objeto_moda"], state["monto_mediana_global"],
        round(state["monto_p99"], 4), state["object_medians_count"],
    )
    return t.spark.createDataFrame(
        [row], "modalidad_moda string, objeto_moda string, mediana_global double, monto_p99 double, object_medians_count bigint"
    )


@check("scan_parquet_state", "SELECT * FROM medians", "medians")
def _(t: Tables) -> DataFrame:
    path = new_location(t.spark, "medians")
    state = preprocessing.fit_preprocessor(t.contracts, medians_path=path)
    return load_medians(t.spark, path, state)


_PREPARED = """SELECT id_contrato, id_funcionario, monto, modalidad, objeto, round(monto_capped, 4) AS monto_capped,
  es_contratacion_directa, es_comparacion_precios FROM prepared"""
_PREPARED_COLUMNS = [
    "id_contrato", "id_funcionario", "monto", "modalidad", "objeto", "monto_capped",
    "es_contratacion_directa", "es_comparacion_precios",
]


@check("apply_preprocessor", _PREPARED, "prepared")
def _(t: Tables) -> DataFrame:
    path = new_location(t.spark, "medians")
    state = preprocessing.fit_preprocessor(t.contracts, medians_path=path)
    prepared = preprocessing.apply_preprocessor(t.contracts, state, t.spark.read.parquet(path))
    return rounded(prepared.select(*_PREPARED_COLUMNS), 4, "monto_capped")


@check(
    "impute_in_batch",
    "SELECT id_contrato, monto, modalidad, objeto, round(monto_capped, 4) AS monto_capped FROM prepared",
    "prepared",
)
def _(t: Tables) -> DataFrame:
    filled = preprocessing.impute_in_batch(t.contracts)
    return rounded(filled.select("id_contrato", "monto", "modalidad", "objeto", "monto_capped"), 4, "monto_capped")


@check(
    "standardize_column",
    """SELECT id_contrato, round((monto - avg(monto) OVER ()) / stddev_pop(monto) OVER (), 6) AS monto_norm,
       round((monto - avg(monto) OVER ()) / stddev_samp(monto) OVER (), 6) AS monto_norm_muestra FROM prepared""",
    "prepared",
)
def _(t: Tables) -> DataFrame:
    scaled = preprocessing.standardize_column(t.prepared, "monto", "monto_norm")
    scaled = preprocessing.standardize_column(scaled, "monto", "monto_norm_muestra", sample=True)
    return rounded(
        scaled.select("id_contrato", "monto_norm", "monto_norm_muestra"), 6, "monto_norm", "monto_norm_muestra"
    )


_MODALITIES = [
    "Contratación Directa", "Comparación de Precios", "Adjudicación Simplificada", "Licitación Pública",
    "Licitación Pública Abreviada",
]


@check(
    "one_hot",
    "SELECT id_contrato, "
    + ", ".join(f"CASE WHEN modalidad = '{m}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"modalidad_{m}\"" for m in _MODALITIES)
    + f", CASE WHEN modalidad NOT IN ({', '.join(repr(m) for m in _MODALITIES)}) THEN 1.0 ELSE 0.0 END::DOUBLE AS modalidad_otros FROM contracts",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    coded = preprocessing.one_hot(t.contracts.select("id_contrato", "modalidad"), "modalidad", _MODALITIES)
    return coded.drop("modalidad")


@check(
    "one_hot_values",
    "SELECT modalidad AS valor FROM (SELECT modalidad, count(*) AS n FROM contracts WHERE modalidad IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    values = preprocessing.one_hot_values(t.contracts, "modalidad", 3)
    return t.spark.createDataFrame([(v,) for v in values], "valor string")


# --- pair features ------------------------------------------------------------------------

define(
    "pares",
    """
    SELECT *, 1 - n_objetos_unicos / n_contratos AS concentracion_objeto,
      n_contratos / (dias_actividad / 30) AS contratos_por_mes,
      monto_total / greatest(n_funcionarios_distintos, 1) AS monto_por_funcionario
    FROM (SELECT id_proveedor, id_entidad, count(*) AS n_contratos, sum(monto) AS monto_total,
        sum(monto) / count(*) AS monto_promedio, count(DISTINCT objeto) AS n_objetos_unicos,
        avg(es_contratacion_directa::INT) AS pct_contratacion_directa,
        avg(es_comparacion_precios::INT) AS pct_comparacion_precios,
        count(DISTINCT id_funcionario) AS n_funcionarios_distintos,
        greatest(date_diff('day', min(fecha_contrato), max(fecha_contrato)), 1) AS dias_actividad,
        max(label_favoritismo::INT)::BIGINT AS label, sum(monto_capped) AS monto_capped_total
      FROM prepared GROUP BY ALL)""",
    "prepared",
)
_PAIR_SQL = """SELECT id_proveedor, id_entidad, n_contratos, monto_total, monto_promedio, n_objetos_unicos,
  pct_contratacion_directa, pct_comparacion_precios, n_funcionarios_distintos, dias_actividad,
  concentracion_objeto, contratos_por_mes, monto_por_funcionario, label FROM pares"""


def pairs(t: Tables) -> DataFrame:
    # Contracts are read to fit the preprocessor, to find crowded pairs and for the features.
    found = favoritism.fav_features(t.written().prepared, label="label_favoritismo")
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("dias_actividad", "label")})


@check("fav_features", _PAIR_SQL, "pares")
def _(t: Tables) -> DataFrame:
    return pairs(t)


@check(
    "fav_features_capped",
    "SELECT id_proveedor, id_entidad, round(monto_capped_total, 3) AS monto_total FROM pares",
    "pares",
)
def _(t: Tables) -> DataFrame:
    capped = favoritism.fav_features(t.prepared, amount="monto_capped")
    return rounded(capped.select("id_proveedor", "id_entidad", "monto_total"), 3, "monto_total")


define(
    "pares_reales",
    """
    SELECT *, 1 - n_objetos_unicos / n_contratos AS concentracion_objeto,
      n_contratos / (dias_actividad / 30) AS contratos_por_mes
    FROM (SELECT id_proveedor, id_entidad, count(*) AS n_contratos, sum(monto) AS monto_total,
        avg(monto) AS monto_promedio, count(DISTINCT objeto) AS n_objetos_unicos,
        avg(coalesce(modalidad = 'Contratación Directa', FALSE)::INT) AS pct_contratacion_directa,
        avg(coalesce(modalidad = 'Comparación de Precios', FALSE)::INT) AS pct_comparacion_precios,
        greatest(date_diff('day', min(fecha_contrato), max(fecha_contrato)), 1) AS dias_actividad
      FROM contracts GROUP BY ALL HAVING count(*) >= 2)""",
    "contracts",
)


@check("fav_features_real", "SELECT * FROM pares_reales", "pares_reales")
def _(t: Tables) -> DataFrame:
    found = favoritism.fav_features_real(t.contracts)
    return found.withColumn("dias_actividad", F.col("dias_actividad").cast("bigint"))


@check(
    "small_payment_flag",
    "SELECT id_proveedor, id_entidad, monto_promedio < 500000 AS posible_pago_individual_agrupado FROM pares_reales",
    "pares_reales",
)
def _(t: Tables) -> DataFrame:
    # The amounts of the supplied tables are a hundred times larger than the usual limit.
    flagged = favoritism.small_payment_flag(favoritism.fav_features_real(t.contracts), 500_000)
    return flagged.select("id_proveedor", "id_entidad", "posible_pago_individual_agrupado")


# --- splitting -----------------------------------------------------------------------------

define(
    "familias",
    f"SELECT *, {family_sql('objeto', 'categoria_principal')} AS objeto_familia FROM prepared",
    "prepared",
)
_FRAME = """OVER (PARTITION BY {0} ORDER BY fecha_contrato RANGE BETWEEN CURRENT ROW AND INTERVAL 15 DAYS FOLLOWING)"""
_CATEGORY_KEYS = ["id_proveedor", "id_entidad", "categoria"]


def _by_category(t: Tables) -> DataFrame:
    return t.prepared.withColumn("categoria", F.coalesce("categoria_principal", F.lit("otra")))


define(
    "ventanas",
    f"""
    SELECT id_contrato, id_proveedor, id_entidad, categoria, fecha_contrato,
      count(*) {_FRAME.format('id_proveedor, id_entidad, categoria')} AS contratos_ventana_15d,
      sum(monto) {_FRAME.format('id_proveedor, id_entidad, categoria')} AS monto_ventana_15d
    FROM (SELECT *, coalesce(categoria_principal, 'otra') AS categoria FROM prepared)""",
    "prepared",
)


@check("window_15d", "SELECT id_contrato, contratos_ventana_15d, monto_ventana_15d FROM ventanas", "ventanas")
def _(t: Tables) -> DataFrame:
    return splitting.window_15d(_by_category(t), _CATEGORY_KEYS).select(
        "id_contrato", "contratos_ventana_15d", "monto_ventana_15d"
    )


@check(
    "pick_one_window",
    """
    SELECT id_proveedor, id_entidad, categoria, contratos_ventana_15d AS max_contratos_ventana_15d,
      monto_ventana_15d AS monto_total_ventana_15d
    FROM (SELECT *, row_number() OVER (PARTITION BY id_proveedor, id_entidad, categoria
      ORDER BY contratos_ventana_15d DESC, fecha_contrato, id_contrato) AS rn FROM ventanas) WHERE rn = 1""",
    "ventanas",
)
def _(t: Tables) -> DataFrame:
    return splitting.pick_one_window(_by_category(t), _CATEGORY_KEYS)


def _groups_sql() -> str:
    family = "id_proveedor, id_entidad, objeto_familia"
    works = (
        "coalesce(categoria_principal = 'works', regexp_matches(lower(objeto), "
        "'obra|construcción|construccion|vial|carretera|pavimentación|pavimentacion'))"
    )
    return f"""
    SELECT g.*, o.objeto FROM (
      SELECT {family}, count(*) AS n_contratos_grupo, arg_min(n_v, orden) AS max_contratos_ventana_15d,
        arg_min(m_v, orden) AS monto_total_ventana_15d, avg((monto < umbral * 0.95::DOUBLE)::INT) AS pct_montos_bajo_umbral,
        sum(monto) AS monto_total_grupo, max(label_fraccionamiento::INT)::BIGINT AS label
      FROM (SELECT *, row_number() OVER (PARTITION BY {family} ORDER BY n_v DESC, fecha_contrato, id_contrato) AS orden
        FROM (SELECT f.*, u.umbral, count(*) {_FRAME.format(family)} AS n_v, sum(monto) {_FRAME.format(family)} AS m_v
          FROM familias f JOIN umbrales u ON u.anio = year(f.fecha_contrato)
            AND u.categoria_umbral = CASE WHEN {works} THEN 'obras' ELSE 'bienes_servicios' END))
      GROUP BY ALL HAVING count(*) >= 2) g
    JOIN (SELECT {family}, objeto, row_number() OVER (PARTITION BY {family} ORDER BY count(*) DESC, objeto) AS rn
      FROM familias GROUP BY {family}, objeto) o USING ({family}) WHERE o.rn = 1"""


define("grupos", _groups_sql(), "familias", "umbrales")


def groups(t: Tables) -> DataFrame:
    found = splitting.frac_features(t.written().prepared, label="label_fraccionamiento")
    return found.withColumn("label", F.col("label").cast("bigint"))


@check("frac_features", "SELECT * FROM grupos", "grupos")
def _(t: Tables) -> DataFrame:
    return groups(t)


@check(
    "interpretable_signal",
    """SELECT id_proveedor, id_entidad, objeto_familia, max_contratos_ventana_15d >= 3 AND pct_montos_bajo_umbral >= 0.7
       AS senal_priorizacion_fraccionamiento FROM grupos""",
    "grupos",
)
def _(t: Tables) -> DataFrame:
    return splitting.interpretable_signal(groups(t)).select(
        *splitting.GROUP, "senal_priorizacion_fraccionamiento"
    )


# --- payments and modalities -------------------------------------------------------------------

define(
    "resumen_pagos",
    """
    SELECT o.*, coalesce(n, 0) AS n_pagos, coalesce(dev, 0.0) AS monto_devengado_total,
      coalesce(pag, 0.0) AS monto_pagado_total, primero, ultimo,
      CASE WHEN monto > 0 THEN coalesce(pag, 0.0) / monto END AS ratio
    FROM order_contracts o LEFT JOIN (SELECT id_contrato, count(id_pago) AS n, sum(monto_devengado) AS dev,
        sum(monto_pagado) AS pag, min(fecha_devengado) AS primero, max(fecha_pagado) AS ultimo
      FROM order_payments GROUP BY ALL) p ON o.id_contrato = p.id_contrato""",
    "order_contracts", "order_payments",
)


def _summary(t: Tables) -> DataFrame:
    return payments.payments_per_contract(t.order_contracts, t.order_payments)


@check(
    "payments_per_contract",
    """SELECT id_contrato, monto, n_pagos, monto_devengado_total, monto_pagado_total,
       strftime(primero, '%Y-%m-%d') AS fecha_primer_devengado, strftime(ultimo, '%Y-%m-%d') AS fecha_ultimo_pago
       FROM resumen_pagos""",
    "resumen_pagos",
)
def _(t: Tables) -> DataFrame:
    chosen = _summary(t).select(
        "id_contrato", "monto", "n_pagos", "monto_devengado_total", "monto_pagado_total",
        "fecha_primer_devengado", "fecha_ultimo_pago",
    )
    return day(chosen, "fecha_primer_devengado", "fecha_ultimo_pago")


_STATUS = """CASE WHEN n_pagos = 0 OR ratio IS NULL THEN 'sin_pago_o_sin_cuantia' WHEN ratio <= 0.01 THEN 'pendiente_sin_pago'
  WHEN ratio < 0.98 THEN 'pago_parcial' WHEN ratio > 1.02 THEN 'sobrepago_senal_revisar'
  ELSE 'pagado_aproximadamente_completo' END"""


def _metric(name: str, value: str, source: str = "resumen_pagos") -> str:
    return f"SELECT '{name}' AS metrica, round(CAST({value} AS DOUBLE), 5) AS valor FROM {source}"


_DELAY = "(SELECT date_diff('day', fecha_devengado, fecha_pagado) AS d FROM order_payments WHERE fecha_pagado >= fecha_devengado)"
_METRICS = [
    _metric("contracts_rows", "count(*)"),
    _metric("contracts_with_payments", "count(*) FILTER (WHERE n_pagos > 0)"),
    _metric("contract_amount_missing_rows", "count(*) FILTER (WHERE monto IS NULL)"),
    _metric("monto_contractual_total_valido", "sum(monto)"),
    _metric("monto_devengado_total", "sum(monto_devengado_total)"),
    _metric("monto_pagado_total", "sum(monto_pagado_total)"),
    _metric("ratio_pagado_global_sobre_monto_valido", "sum(monto_pagado_total) / sum(monto)"),
    *[
        _metric(f"estado:{s}", f"count(*) FILTER (WHERE {_STATUS} = '{s}')")
        for s in ("sin_pago_o_sin_cuantia", "pendiente_sin_pago", "pago_parcial", "sobrepago_senal_revisar",
                  "pagado_aproximadamente_completo")
    ],
    _metric("payments_rows", "count(*)", "order_payments"),
    *[_metric(f"ratio_pagado_p{p}", f"quantile_cont(ratio, {p / 100})") for p in (50, 90)],
    *[_metric(f"dias_devengado_a_pagado_p{p}", f"quantile_cont(d, {p / 100})", _DELAY) for p in (50, 90, 95)],
]


@check("payment_metrics", " UNION ALL ".join(_METRICS), "resumen_pagos")
def _(t: Tables) -> DataFrame:
    return rounded(payments.payment_metrics(_summary(t), t.order_payments), 5, "valor")


_MODALITY_SQL = """SELECT regimen, coalesce(modalidad, 'SIN_DATO') AS modalidad, clasificacion_modalidad,
  count(*) AS n_contratos, sum(monto) AS monto_contractual FROM clasificados GROUP BY ALL"""


@check("modality_summary", _MODALITY_SQL, "clasificados")
def _(t: Tables) -> DataFrame:
    return payments.modality_summary(t.contracts)


@check(
    "pivot_modality_regime",
    """SELECT coalesce(modalidad, 'SIN_DATO') AS modalidad,
         count(*) FILTER (WHERE regimen = 'Ley 30225') AS "Ley 30225",
         count(*) FILTER (WHERE regimen = 'Ley 32069') AS "Ley 32069"
       FROM clasificados GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8""",
    "clasificados",
)
def _(t: Tables) -> DataFrame:
    return payments.pivot_modality_regime(payments.modality_summary(t.contracts))


# --- exploration ----------------------------------------------------------------------------------

_COLUMNS = ["id_funcionario", "monto", "modalidad", "objeto", "categoria_principal", "id_contrato"]


@check(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS columna, count(*) FILTER (WHERE {c} IS NULL) AS n_nulos, "
        f"count(*) FILTER (WHERE {c} IS NULL) / count(*) AS proporcion FROM contracts" for c in _COLUMNS
    )
    + " UNION ALL SELECT '*', count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NULL" for c in _COLUMNS) + "), "
    + "count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NULL" for c in _COLUMNS) + ") / count(*) FROM contracts",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return explore.null_profile(t.contracts.select(*_COLUMNS))


@check(
    "iqr_outliers",
    """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, count(*) AS filas FROM orders)
    SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 + 1.5 * (q3 - q1), 4) AS limite,
      (SELECT count(*) FROM orders, q WHERE o_totalprice > q3 + 1.5 * (q3 - q1))
        AS n_sobre_limite, filas FROM q""",
)
def _(t: Tables) -> DataFrame:
    return rounded(explore.iqr_outliers(t.raw("orders"), "o_totalprice").drop("proporcion"), 4, "q1", "q3", "limite")


@check(
    "amount_histogram",
    """
    , r AS (SELECT min(monto) AS lo, max(monto) AS hi FROM contracts)
    SELECT CAST(least(floor((monto - lo) / ((hi - lo) / 60)), 59) AS BIGINT) AS bin, count(*) AS n
    FROM contracts, r WHERE monto IS NOT NULL GROUP BY ALL""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return explore.amount_histogram(t.contracts).select("bin", "n")


@check(
    "ratio_histogram",
    """
    , c AS (SELECT greatest(least(ratio, 1.2::DOUBLE), 0.0::DOUBLE) AS x FROM resumen_pagos WHERE ratio IS NOT NULL),
    r AS (SELECT min(x) AS lo, max(x) AS hi FROM c)
    SELECT CAST(least(floor((x - lo) / ((hi - lo) / 24)), 23) AS BIGINT) AS bin, count(*) AS n FROM c, r GROUP BY ALL""",
    "resumen_pagos",
)
def _(t: Tables) -> DataFrame:
    return explore.ratio_histogram(_summary(t)).select("bin", "n")


@check(
    "monthly_series",
    """
    , m AS (SELECT date_trunc('month', fecha_contrato) AS mes, count(monto) AS n, sum(monto) AS s FROM order_contracts GROUP BY ALL),
    todos AS (SELECT unnest(generate_series((SELECT min(mes) FROM m), (SELECT max(mes) FROM m), INTERVAL 1 MONTH)) AS mes)
    SELECT strftime(todos.mes, '%Y-%m-%d') AS mes, coalesce(n, 0) AS n_contratos, coalesce(s, 0) AS monto_total
    FROM todos LEFT JOIN m ON todos.mes = m.mes""",
    "order_contracts",
)
def _(t: Tables) -> DataFrame:
    return day(explore.monthly_series(t.order_contracts), "mes")


@check(
    "top_suppliers",
    "SELECT id_proveedor, count(*) AS n_contratos FROM contracts GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 15",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return explore.top_suppliers(t.contracts)


@check(
    "burst_groups",
    """SELECT id_proveedor, id_entidad, objeto, count(*) AS n_contratos, sum(monto) AS monto_total,
         date_diff('day', min(fecha_contrato), max(fecha_contrato)) AS rango_dias
       FROM contracts WHERE objeto IS NOT NULL GROUP BY ALL
       HAVING count(*) >= 2 AND date_diff('day', min(fecha_contrato), max(fecha_contrato)) <= 60""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    found = explore.burst_groups(t.contracts, n=2, days=60)
    return found.withColumn("rango_dias", F.col("rango_dias").cast("bigint"))


@check(
    "repeat_modality_pairs",
    """SELECT modalidad, id_proveedor, id_entidad, count(*) AS n_contratos FROM contracts
       WHERE modalidad IN ('Contratación Directa', 'Comparación de Precios') GROUP BY ALL HAVING count(*) >= 5""",
    "contracts",
)
def _(t: Tables) -> DataFrame:
    return explore.repeat_modality_pairs(t.contracts, ["Contratación Directa", "Comparación de Precios"])


_STAT_COLUMNS = [
    "n_contratos", "concentracion_objeto", "pct_contratacion_directa", "pct_comparacion_precios", "monto_total",
]


@check(
    "group_stats",
    " UNION ALL ".join(
        f"SELECT label, '{c}' AS variable, count(*) AS n, round(avg({c}), 5) AS media, round(stddev_samp({c}), 5) AS sd "
        "FROM pares GROUP BY label" for c in _STAT_COLUMNS
    ),
    "pares",
)
def _(t: Tables) -> DataFrame:
    return rounded(explore.group_stats(pairs(t), _STAT_COLUMNS), 5, "media", "sd")


@check(
    "welch_t",
    """
    , s AS (SELECT label, count(*) AS n, avg(concentracion_objeto) AS m, var_samp(concentracion_objeto) AS v FROM pares GROUP BY label),
    a AS (SELECT * FROM s WHERE label = 1), b AS (SELECT * FROM s WHERE label = 0)
    , w AS (SELECT a.m AS media1, b.m AS media0, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
      pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS gl FROM a, b)
    -- The density over the angle whose tangent is t / sqrt(gl), by Simpson's rule.
    , q AS (SELECT *, atan(abs(t) / sqrt(gl)) AS edge, (pi() / 2 - atan(abs(t) / sqrt(gl))) / 20000 AS h FROM w)
    SELECT round(media1, 6) AS media1, round(media0, 6) AS media0, round(t, 6) AS t, round(gl, 4) AS gl,
      round(2 * exp(lgamma((gl + 1) / 2) - lgamma(gl / 2) - ln(pi()) / 2) * h / 3 * (
        SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(edge + i * h), 0.0), gl - 1)) FROM range(20001) r(i)), 6) AS p
    FROM q""",
    "pares",
)
def _(t: Tables) -> DataFrame:
    one = explore.welch_t(pairs(t), "concentracion_objeto")
    return rounded(rounded(one, 6, "media1", "media0", "t", "p"), 4, "gl")


@check(
    "box_stats",
    "SELECT label, "
    + ", ".join(
        f"round(quantile_cont(monto_total, {p}), 4) AS {n}"
        for n, p in {"minimo": 0, "q1": 0.25, "mediana": 0.5, "q3": 0.75, "maximo": 1}.items()
    )
    + " FROM pares GROUP BY label",
    "pares",
)
def _(t: Tables) -> DataFrame:
    return rounded(explore.box_stats(pairs(t), "monto_total"), 4, "minimo", "q1", "mediana", "q3", "maximo")


# --- drift ------------------------------------------------------------------------------------------


def psi_sql(old: str, new: str, columns: list[str]) -> str:
    """SQL of the stability index of several columns of two views."""
    parts = []
    for c in columns:
        edges = f"SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM {old}"

        def shares(view: str) -> str:
            place = f"len(list_filter(e, lambda x: x <= {c}))"
            return f"SELECT {place} AS b, count(*) / sum(count(*)) OVER () AS s FROM {view}, ({edges}) GROUP BY ALL"

        parts.append(
            f"SELECT '{c}' AS variable, round(sum((greatest(coalesce(q.s, 0), 0.0001) - greatest(coalesce(p.s, 0), 0.0001)) "
            f"* ln(greatest(coalesce(q.s, 0), 0.0001) / greatest(coalesce(p.s, 0), 0.0001))), 6) AS psi "
            f"FROM ({shares(old)}) p FULL JOIN ({shares(new)}) q ON p.b = q.b"
        )
    return " UNION ALL ".join(parts)


def _half_pairs(t: Tables, early: bool) -> DataFrame:
    """Labelled pairs of one half."""
    part = F.col("fecha_contrato") < "2024-01-01"
    return favoritism.fav_features(t.prepared.where(part if early else ~part), label="label_favoritismo")


def _half_pairs_sql(condition: str) -> str:
    return f"""SELECT id_proveedor, id_entidad, sum(monto) AS monto_total,
      avg(es_contratacion_directa::INT) AS pct_contratacion_directa, avg(es_comparacion_precios::INT) AS pct_comparacion_precios,
      1 - count(DISTINCT objeto) / count(*) AS concentracion_objeto FROM prepared WHERE {condition} GROUP BY ALL"""


define("pares_antes", _half_pairs_sql("fecha_contrato < TIMESTAMP '2024-01-01'"), "prepared")
define("pares_despues", _half_pairs_sql("fecha_contrato >= TIMESTAMP '2024-01-01'"), "prepared")
_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@check(
    "psi",
    f"""
    WITH viejo AS MATERIALIZED (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    nuevo AS MATERIALIZED (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
    {psi_sql('viejo', 'nuevo', _LINE_COLUMNS)}""",
)
def _(t: Tables) -> DataFrame:
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    lines = t.raw("lineitem")
    return rounded(drift.psi(lines.where(early), lines.where(~early), _LINE_COLUMNS), 6, "psi")


@check(
    "drift_report_pairs",
    f"SELECT *, psi > 0.25 AS trigger_drift FROM ({psi_sql('pares_antes', 'pares_despues', drift.PAIR_DRIFT_FEATURES)})",
    "pares_antes pares_despues",
)
def _(t: Tables) -> DataFrame:
    t = t.written()
    return rounded(drift.drift_report_pairs(*(materialize(_half_pairs(t, early), "pairs") for early in (True, False))), 6, "psi")


def _scored(pairs_of_half: DataFrame) -> DataFrame:
    """Pairs scored by a plain feature, so that SQL can rank them too."""
    return pairs_of_half.select(group_id(favoritism.PAIR).alias("id"), "label", F.col("pct_contratacion_directa").alias("score"))


def _scored_half_sql(condition: str) -> str:
    return f"""SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rango FROM (
      SELECT concat_ws('{KEY_JOINT}', id_proveedor, id_entidad) AS id, max(label_favoritismo::INT) AS label,
        avg(es_contratacion_directa::INT) AS score FROM prepared WHERE {condition} GROUP BY id_proveedor, id_entidad)"""


define("puntuados_antes", _scored_half_sql("fecha_contrato < TIMESTAMP '2024-01-01'"), "prepared")
define("puntuados_despues", _scored_half_sql("fecha_contrato >= TIMESTAMP '2024-01-01'"), "prepared")


def _decision_sql() -> str:
    """Both halves with their labels, and the second one once more without."""
    late = psi_sql("pares_antes", "pares_despues", drift.PAIR_DRIFT_FEATURES)
    recall = """SELECT '{0}' AS lote, TRUE AS con_labels, CAST(count(*) FILTER (WHERE label = 1
      AND rango <= (SELECT sum(label) FROM puntuados_{0})) AS DOUBLE) / nullif(sum(label), 0) AS recall FROM puntuados_{0}"""
    return f"""
    , informes AS (SELECT 'despues' AS lote, * FROM ({late}) UNION ALL SELECT 'despues_sin_labels', * FROM ({late})
      UNION ALL SELECT 'antes', * FROM ({psi_sql('pares_antes', 'pares_antes', drift.PAIR_DRIFT_FEATURES)})),
    m AS (SELECT lote, max(psi) AS psi_max FROM informes GROUP BY ALL),
    r AS ({recall.format('antes')} UNION ALL {recall.format('despues')} UNION ALL SELECT 'despues_sin_labels', FALSE, NULL),
    d AS (SELECT *, psi_max > 0.25 AS trigger_drift, coalesce(recall < 0.8, FALSE) AS trigger_recall FROM m JOIN r USING (lote))
    SELECT lote, psi_max, round(recall, 6) AS recall_at_k, trigger_drift, trigger_recall, trigger_drift OR trigger_recall AS retraining_required,
      (trigger_drift OR trigger_recall) AND con_labels AS candidate_allowed, FALSE AS automatic_promotion FROM d"""


@check("retrain_decision", _decision_sql(), "pares_antes pares_despues puntuados_antes puntuados_despues")
def _(t: Tables) -> DataFrame:
    # Written once: reports, recalls and labels read them.
    t = t.written()
    old, new = (materialize(_half_pairs(t, early), "pairs") for early in (True, False))
    first, late = _scored(old), _scored(new)
    scored = {
        "antes": first, "despues": late,
        "despues_sin_labels": late.withColumn("label", F.lit(None).cast("int")),
    }
    drifted = drift.drift_report_pairs(old, new)
    by_batch = {"antes": drift.drift_report_pairs(old, old), "despues": drifted, "despues_sin_labels": drifted}

    def union(parts) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    decision = drift.retrain_decision(
        union(report.withColumn("lote", F.lit(lote)) for lote, report in by_batch.items()),
        union(drift.batch_recall(rows, lote) for lote, rows in scored.items()),
        union(drift.batch_labels(rows, lote) for lote, rows in scored.items()),
    )
    return rounded(decision, 6, "psi_max", "recall_at_k")
