"""Profiles, histograms, series and group statistics behind the exploratory charts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atalaya.operators.contract import count_flag
from atalaya.operators.ordering import exact_quantiles

BURST_CONTRACTS, BURST_DAYS, REPEAT_CONTRACTS = 3, 15, 5


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequencies of several columns in one pass (columna, valor, n)."""
    pairs = [F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in columns]
    return df.select(F.inline(F.array(*pairs))).groupBy("columna", "valor").agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, and the rows with any null under the name `*`."""
    flags = {c: F.col(c).isNull() for c in df.columns}
    flags["*"] = reduce(or_, list(flags.values()))
    names = {f"c{i}": name for i, name in enumerate(flags)}
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_flag(flags[n]).alias(c) for c, n in names.items()])
    entries = [
        F.struct(
            F.lit(name).alias("columna"),
            F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("n_nulos"),
            F.try_divide(F.col(c).cast("double"), F.col("_rows")).alias("proporcion"),
        )
        for c, name in names.items()
    ]
    return counted.select(F.inline(F.array(*entries)))


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Upper fence q3 + 1.5 iqr, and the rows above it."""
    quartiles = exact_quantiles(df, column, {"q1": 0.25, "q3": 0.75}).first()
    if quartiles is None:
        return df.sparkSession.createDataFrame(
            [], "q1 double, q3 double, limite double, n_sobre_limite bigint, filas bigint, proporcion double"
        )
    q1, q3 = quartiles["q1"], quartiles["q3"]
    fence = q3 + 1.5 * (q3 - q1)
    counted = df.agg(
        count_flag(F.col(column) > F.lit(fence)).alias("n_sobre_limite"), F.count(F.lit(1)).alias("filas")
    )
    return counted.select(
        F.lit(q1).alias("q1"),
        F.lit(q3).alias("q3"),
        F.lit(fence).alias("limite"),
        "n_sobre_limite",
        "filas",
        (F.col("n_sobre_limite") / F.col("filas")).alias("proporcion"),
    )


def equal_width_histogram(
    df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Counts of equal-width bins (0 to bins-1), the last one closed; empty bins are left out.

    With bounds given, values outside are clipped to them first.
    """
    value = F.col(column).cast("double")
    usable = df.where(value.isNotNull())
    if low is not None and high is not None:
        value = F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
    seen = usable.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if seen["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin bigint, desde double, n bigint")
    lo, hi = seen["lo"], seen["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((value - lo) / width), F.lit(bins - 1))
    return (
        usable.groupBy(place.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("desde"), "n")
    )


def amount_histogram(df: DataFrame) -> DataFrame:
    return equal_width_histogram(df, "monto", 60)


def ratio_histogram(summary: DataFrame) -> DataFrame:
    return equal_width_histogram(summary, "ratio_pagado_contrato", 24, 0.0, 1.2)


def monthly_series(contracts: DataFrame) -> DataFrame:
    """Contracts and amount per calendar month; months without contracts are kept as zeros."""
    month = F.trunc(F.col("fecha_contrato").cast("date"), "month")
    found = contracts.groupBy(month.alias("mes")).agg(
        F.count("monto").alias("n_contratos"), F.sum("monto").alias("monto_total")
    )
    months = found.agg(
        F.explode(F.sequence(F.min("mes"), F.max("mes"), F.expr("interval 1 month"))).alias("mes")
    )
    return months.join(found, "mes", "left").fillna({"n_contratos": 0, "monto_total": 0.0})


def top_suppliers(contracts: DataFrame, top: int = 15) -> DataFrame:
    counted = contracts.groupBy("id_proveedor").agg(F.count(F.lit(1)).alias("n_contratos"))
    return counted.orderBy(F.desc("n_contratos"), "id_proveedor").limit(top)


def burst_groups(contracts: DataFrame, n: int = BURST_CONTRACTS, days: int = BURST_DAYS) -> DataFrame:
    """Supplier, entity and object with at least `n` contracts, all within `days` days."""
    groups = contracts.where(F.col("objeto").isNotNull()).groupBy("id_proveedor", "id_entidad", "objeto").agg(
        F.count("id_contrato").alias("n_contratos"),
        F.sum("monto").alias("monto_total"),
        F.datediff(F.max("fecha_contrato"), F.min("fecha_contrato")).alias("rango_dias"),
    )
    return groups.where((F.col("n_contratos") >= n) & (F.col("rango_dias") <= days))


def repeat_modality_pairs(contracts: DataFrame, modalities: Sequence[str], n: int = REPEAT_CONTRACTS) -> DataFrame:
    """Pairs with at least `n` contracts under one of the modalities."""
    counted = (
        contracts.where(F.col("modalidad").isin(*modalities))
        .groupBy("modalidad", "id_proveedor", "id_entidad")
        .agg(F.count(F.lit(1)).alias("n_contratos"))
    )
    return counted.where(F.col("n_contratos") >= n)


def _long(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns]
    return df.select(*keep, F.inline(F.array(*entries)))


def group_stats(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """Mean and sample deviation of each column by label, in one pass."""
    return _long(df, columns, label).groupBy(label, "variable").agg(
        F.count("x").alias("n"), F.avg("x").alias("media"), F.stddev_samp("x").alias("sd")
    )


def box_stats(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Five-number summary by label."""
    names = {"minimo": 0.0, "q1": 0.25, "mediana": 0.5, "q3": 0.75, "maximo": 1.0}
    return exact_quantiles(df, column, names, [label])


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive column: Stirling's series eight steps above it."""
    up = z + 8
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, F.lit(3))) + 1 / (1260 * F.pow(up, F.lit(5))) - 1 / (1680 * F.pow(up, F.lit(7)))
    stirling = (up - 0.5) * F.log(up) - up + math.log(2 * math.pi) / 2 + series
    return stirling - reduce(add, [F.log(z + i) for i in range(8)])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function by its continued fraction, from the side on which that converges fast.

    The steps needed grow with the square root of `a` and `b`.
    """
    near = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(1 - x)
    fixed = F.struct(p.alias("p"), q.alias("q"), y.alias("y"))
    steps = F.sequence(F.lit(1), F.ceil(200 + 5 * F.sqrt(a + b)).cast("int"))

    def turn(state: Column, factor: Column) -> Column:
        upper, lower = 1 + factor / state["upper"], 1 / (1 + factor * state["lower"])
        return F.struct(upper.alias("upper"), lower.alias("lower"), (state["value"] * upper * lower).alias("value"))

    def of(part: Column) -> Column:
        p, q, y = part["p"], part["q"], part["y"]
        first = 1 / (1 - (p + q) * y / (p + 1))

        def step(state: Column, m: Column) -> Column:
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            halfway = F.transform(F.array(state), lambda s: turn(s, even))
            return F.get(F.transform(halfway, lambda s: turn(s, odd)), F.lit(0))

        start = F.struct(F.lit(1.0).alias("upper"), first.alias("lower"), first.alias("value"))
        front = F.exp(p * F.log(y) + q * F.log(1 - y) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
        return F.when(y <= 0, F.lit(0.0)).otherwise(front * F.aggregate(steps, start, step)["value"])

    share = F.get(F.transform(F.array(fixed), of), F.lit(0))
    return F.when(near, share).otherwise(1 - share)


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p value of a t statistic."""
    return incomplete_beta(freedom / (freedom + t * t), freedom / 2, F.lit(0.5))


def welch_t(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Welch statistic, degrees of freedom and two-sided p value of label 1 against label 0, as one row."""

    def moments(value: int) -> list[Column]:
        x = F.when(F.col(label) == value, F.col(column))
        return [
            F.count(x).alias(f"n{value}"), F.avg(x).alias(f"media{value}"), F.var_samp(x).alias(f"var{value}")
        ]

    one_row = df.agg(*moments(1), *moments(0))
    v1, v0 = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    statistics = one_row.select(
        "media1",
        "media0",
        ((F.col("media1") - F.col("media0")) / F.sqrt(v1 + v0)).alias("t"),
        (
            F.pow(v1 + v0, F.lit(2))
            / (F.pow(v1, F.lit(2)) / (F.col("n1") - 1) + F.pow(v0, F.lit(2)) / (F.col("n0") - 1))
        ).alias("gl"),
    )
    return statistics.withColumn("p", t_p_value(F.col("t"), F.col("gl")))
