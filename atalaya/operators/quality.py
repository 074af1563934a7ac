"""Data-quality gates as distributed aggregates.

Every gate of a domain comes from one aggregate in two levels: per key, then over
all keys. A key that repeats very often is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.operators.contract import (
    FOREIGN_KEYS,
    ID_COLUMNS,
    PRIMARY_KEYS,
    TypedDomain,
    count_flag,
    raise_on_contract,
)

SAMPLE_ROWS = 5
SKIPPED = "skipped_parent_not_configured"


def _blank(column: str) -> Column:
    return F.length(F.trim(F.col(column).cast("string"))) == 0


def key_metrics(df: DataFrame, key: Sequence[str], flags: dict[str, Column] | None = None) -> DataFrame:
    """One row: rows, distinct keys, excess and affected rows, duplicate keys, and flag counts."""
    flags = flags or {}
    names = {f"f{i}": name for i, name in enumerate(flags)}
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_flag(flags[name]).alias(column) for column, name in names.items()],
    )
    complete = reduce(and_, [F.col(k).isNotNull() for k in key])
    repeated = complete & (F.col("_n") > 1)
    zero = F.lit(0).cast("bigint")
    totals = per_key.agg(
        F.coalesce(F.sum("_n"), zero).alias("filas"),
        F.coalesce(count_flag(complete), zero).cast("bigint").alias("claves_distintas"),
        F.coalesce(count_flag(repeated), zero).cast("bigint").alias("claves_duplicadas"),
        F.coalesce(F.sum(F.when(repeated, F.col("_n"))), zero).alias("filas_afectadas"),
        *[F.coalesce(F.sum(c), zero).alias(name) for c, name in names.items()],
    )
    return totals.withColumn("filas_excedentes", F.col("filas") - F.col("claves_distintas"))


def pk_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Uniqueness of a key: rows, distinct keys, excess rows and duplicated keys."""
    return key_metrics(df, key)


def duplicate_sample(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The five smallest duplicated keys with their row counts."""
    counted = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1).orderBy(*key).limit(SAMPLE_ROWS)


def blank_ids(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Per identifier column, the non-null values that trim to nothing."""
    one_row = df.agg(*[count_flag(_blank(c)).alias(c) for c in id_columns])
    entries = [
        F.struct(F.lit(c).alias("columna"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n_vacios"))
        for c in id_columns
    ]
    return one_row.select(F.inline(F.array(*entries)))


def negative_amounts(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(count_flag(F.col(column) < 0), F.lit(0)).cast("bigint").alias("n_negativos"))


def orphan_keys(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct non-null child keys without a parent row."""

    def keys(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("clave")).distinct()

    return keys(child, child_column).join(keys(parent, parent_column), "clave", "left_anti")


def fk_orphans(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Number of orphan keys of one relation, with the smallest five as a sample."""
    orphans = orphan_keys(child, child_column, parent, parent_column)
    total = orphans.agg(F.count(F.lit(1)).alias("n_huerfanas"))
    sample = orphans.orderBy("clave").limit(SAMPLE_ROWS).agg(
        F.array_join(F.array_sort(F.collect_list("clave")), ",").alias("muestra")
    )
    # Two one-row results of the same relation, put side by side.
    return total.withColumn("_k", F.lit(1)).join(sample.withColumn("_k", F.lit(1)), "_k").drop("_k")


def relation_name(relation: tuple[str, str, str, str]) -> str:
    child, child_column, parent, parent_column = relation
    return f"{child}.{child_column}->{parent}.{parent_column}"


def _domain_flags(domain: str, columns: Sequence[str]) -> dict[str, Column]:
    flags = {f"vacio:{c}": _blank(c) for c in ID_COLUMNS if c in columns}
    if domain == "contracts" and "monto" in columns:
        flags["negativo:monto"] = F.col("monto") < 0
    return flags


def domain_gate(df: DataFrame, domain: str) -> DataFrame:
    """All gates of one domain in long form (dominio, regla, columna, valor)."""
    metrics = key_metrics(df, PRIMARY_KEYS[domain], _domain_flags(domain, df.columns))
    entries = [
        F.struct(
            F.lit(domain).alias("dominio"),
            F.lit(name.split(":")[0]).alias("regla"),
            F.lit(name.split(":")[1] if ":" in name else "").alias("columna"),
            F.col(f"`{name}`").cast("bigint").alias("valor"),
        )
        for name in metrics.columns
    ]
    return metrics.select(F.inline(F.array(*entries)))


def quality_report(datasets: dict[str, DataFrame]) -> DataFrame:
    """Gates of all domains and relations in one long table with a status per row."""
    parts = [domain_gate(df, domain) for domain, df in datasets.items() if domain in PRIMARY_KEYS]
    for relation in FOREIGN_KEYS:
        child, child_column, parent, parent_column = relation
        if child not in datasets:
            continue
        if parent in datasets:
            counted = orphan_keys(
                datasets[child], child_column, datasets[parent], parent_column
            ).agg(F.count(F.lit(1)).alias("valor"))
        else:
            counted = datasets[child].sparkSession.createDataFrame([(None,)], "valor bigint")
        parts.append(
            counted.select(
                F.lit(child).alias("dominio"),
                F.lit("huerfanas").alias("regla"),
                F.lit(relation_name(relation)).alias("columna"),
                "valor",
            )
        )
    report = reduce(DataFrame.unionByName, parts)
    clean = ~F.col("regla").isin("claves_duplicadas", "filas_excedentes", "filas_afectadas", "vacio", "negativo", "huerfanas")
    status = (
        F.when(F.col("valor").isNull(), F.lit(SKIPPED))
        .when(clean | (F.col("valor") == 0), F.lit("ok"))
        .otherwise(F.lit("error"))
    )
    return report.withColumn("estado", status)


def gate_domain(typed: TypedDomain) -> dict[str, int]:
    """Run contract and quality gates of a typed domain in one job; returns its counts."""
    rows, flags = typed.flagged()
    flags |= _domain_flags(typed.domain, typed.data.columns)
    counts = key_metrics(rows, PRIMARY_KEYS[typed.domain], flags).first().asDict()
    raise_on_contract(typed.domain, typed.mode, counts)
    for rule, text in (("vacio", "blank identifiers"), ("negativo", "negative amounts")):
        found = {k.split(":")[1]: v for k, v in counts.items() if k.startswith(f"{rule}:") and v}
        if found:
            raise GateError(f"{typed.domain}: {text} {found}")
    if counts["filas_excedentes"]:
        sample = [r.asDict() for r in duplicate_sample(typed.data, PRIMARY_KEYS[typed.domain]).collect()]
        raise GateError(
            f"{typed.domain}: {counts['claves_duplicadas']} duplicated keys, "
            f"{counts['filas_excedentes']} excess rows; sample {sample}"
        )
    return counts


def gate_relations(datasets: dict[str, DataFrame]) -> dict[str, dict]:
    """Check the declared relations; raises with the count and a sample of orphans."""
    outcome: dict[str, dict] = {}
    for relation in FOREIGN_KEYS:
        child, child_column, parent, parent_column = relation
        if child not in datasets:
            continue
        name = relation_name(relation)
        if parent not in datasets:
            outcome[name] = {"status": SKIPPED, "orphans": None}
            continue
        require_columns(datasets[child], [child_column], name)
        require_columns(datasets[parent], [parent_column], name)
        found = fk_orphans(datasets[child], child_column, datasets[parent], parent_column).first()
        if found["n_huerfanas"]:
            raise GateError(f"{name}: {found['n_huerfanas']} orphan keys; sample {found['muestra']}")
        outcome[name] = {"status": "ok", "orphans": 0}
    return outcome


def orphan_payments(payments: DataFrame, contracts: DataFrame) -> DataFrame:
    """Number of payment rows whose contract is unknown."""
    # Keys are counted first, so a contract with very many payments is one row in the join.
    per_contract = payments.groupBy("id_contrato").agg(F.count(F.lit(1)).alias("n"))
    orphans = per_contract.join(contracts.select("id_contrato").distinct(), "id_contrato", "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_payments"))


# --- publication gates --------------------------------------------------------


def publish_gate_pk(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Null and duplicate counts of an output key; nulls must not occur at all."""
    metrics = key_metrics(df, key, {"nulos": reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])})
    return metrics.select("filas", "nulos", F.col("filas_excedentes").alias("duplicados"))


def publish_gate_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, the values that are null, not numeric or outside [0, 1]."""
    def outside(c: str) -> Column:
        value = F.col(c).cast("string").try_cast("double")
        return value.isNull() | F.isnan(value) | ~value.between(0, 1)

    one_row = df.agg(*[count_flag(outside(c)).alias(c) for c in columns])
    entries = [
        F.struct(F.lit(c).alias("columna"), F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n_fuera"))
        for c in columns
    ]
    return one_row.select(F.inline(F.array(*entries)))


def order_inversions(ranked: DataFrame, score: str) -> DataFrame:
    """Rows of an ordered result whose score is above the one before; all rows are looked at.

    Neighbours are compared inside each sorted partition, and the partitions' first and last rows with each
    other: one row per partition.
    """
    placed = ranked.select(F.col(score).alias("_score"), F.monotonically_increasing_id().alias("_place"))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    before = F.lag("_score").over(Window.partitionBy("_part").orderBy("_place"))
    parts = placed.withColumn("_inverted", F.col("_score") > before).groupBy("_part").agg(
        F.count(F.lit(1)).alias("rows"), count_flag(F.col("_inverted")).alias("inside"),
        F.min_by("_score", "_place").alias("first"), F.max_by("_score", "_place").alias("last"),
    )
    edge = F.col("first") > F.lag("last").over(Window.orderBy("_part"))
    joined = parts.withColumn("_edge", edge).agg(
        F.sum("rows").alias("rows"), F.sum("inside").alias("inside"), count_flag(F.col("_edge")).alias("edges")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return joined.select(zero("rows").alias("filas"), (zero("inside") + zero("edges")).alias("inversiones"))


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise GateError(f"{name}: missing columns {missing}")


def require_publishable(
    df: DataFrame, key: Sequence[str], unit_columns: Sequence[str], non_negative: Sequence[str], name: str
) -> int:
    """Gates of a report table, all in one job; returns the number of rows."""
    def outside(c: str) -> Column:
        value = F.col(c).cast("double")
        return value.isNull() | ~value.between(0, 1)

    flags = {f"nulo:{k}": F.col(k).isNull() for k in key}
    flags |= {f"rango:{c}": outside(c) for c in unit_columns}
    flags |= {f"negativo:{c}": F.col(c).cast("double") < 0 for c in non_negative}
    counts = key_metrics(df, key, flags).first().asDict()
    found = {k: v for k, v in counts.items() if ":" in k and v}
    if counts["claves_duplicadas"]:
        found["duplicados"] = counts["claves_duplicadas"]
    if found:
        raise GateError(f"{name}: {found}")
    return counts["filas"]
