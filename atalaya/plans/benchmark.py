"""Timed run of integration, preprocessor fit and feature building."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atalaya.operators.favoritism import fav_features
from atalaya.operators.preprocessing import apply_preprocessor, fit_preprocessor
from atalaya.operators.splitting import frac_features
from atalaya.plans.evaluate import MODEL_AMOUNT
from atalaya.plans.integrate import integrate_domains
from atalaya.runtime import new_location


def run_to_nowhere(df: DataFrame) -> None:
    """Compute every row of `df` without keeping any."""
    df.write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def statistics_of(seconds: list[float]) -> dict[str, float]:
    return {
        "min_s": min(seconds),
        "median_s": statistics.median(seconds),
        "max_s": max(seconds),
        "mean_s": statistics.fmean(seconds),
    }


def benchmark_job(
    spark: SparkSession, load: Callable[[], tuple[DataFrame, int]], repetitions: int = 3
) -> DataFrame:
    """Long table (etapa, medida, valor) of a run; `load` gives contracts and their number."""
    if repetitions < 1:
        raise ValueError("repetitions must be at least 1")
    start = time.perf_counter()
    contracts, rows = load()
    integration = time.perf_counter() - start

    path = new_location(spark, "medians")
    start = time.perf_counter()
    state = fit_preprocessor(contracts, medians_path=path)
    fit = time.perf_counter() - start
    prepared = apply_preprocessor(contracts, state, spark.read.parquet(path))

    runs = [
        timed(lambda: run_to_nowhere(fav_features(prepared, amount=MODEL_AMOUNT)))
        + timed(lambda: run_to_nowhere(frac_features(prepared)))
        for _ in range(repetitions)
    ]
    measured = [
        ("integracion", "segundos", integration),
        ("ajuste", "segundos", fit),
        *[("features", name, value) for name, value in statistics_of(runs).items()],
        ("features", "filas_por_segundo", rows / statistics.median(runs)),
        ("integracion", "filas", float(rows)),
    ]
    return spark.createDataFrame(measured, "etapa string, medida string, valor double")


def benchmark_config(spark: SparkSession, config: dict, repetitions: int = 3) -> DataFrame:
    """The benchmark of a configured source."""

    def load() -> tuple[DataFrame, int]:
        datasets, summary = integrate_domains(config, spark)
        return datasets["contracts"], summary["domains"]["contracts"]["rows"]

    return benchmark_job(spark, load, repetitions)
