"""Sinks: new Parquet outputs, compatibility CSV, partitioned and managed tables, staged publication.

Paths go through the file system that Spark has configured for them, so a local
folder, HDFS and an object store all work.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.functions.amounts import year_month


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, location = _file_system(spark, path)
    return fs.exists(location)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, location = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(location)) if fs.exists(location) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, location = _file_system(spark, source)
    parent = _file_system(spark, target)[1].getParent()
    if parent is not None:
        fs.mkdirs(parent)
    if not fs.rename(location, _file_system(spark, target)[1]):
        raise OSError(f"could not rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, location = _file_system(spark, path)
    fs.delete(location, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, location = _file_system(spark, path)
    stream = fs.create(location, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.option("wholetext", True).text(path).collect()
    return "".join(r[0] for r in rows)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2))


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def sink_parquet_new(outputs: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each output as distributed Parquet into a new or empty folder; nothing is overwritten."""
    spark = next(iter(outputs.values())).sparkSession
    if list_names(spark, folder):
        raise FileExistsError(f"folder is not empty: {folder}")
    written = {}
    for name, df in outputs.items():
        written[name] = f"{folder}/{name}.parquet"
        df.write.mode("errorifexists").parquet(written[name])
    return written


def sink_csv_single(df: DataFrame, target: str) -> str:
    """One CSV file, for small outputs that other tools expect as a file.

    One task writes it. Large results belong in `sink_parquet_new`.
    """
    spark = df.sparkSession
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(staging)
    parts = [n for n in list_names(spark, staging) if n.startswith("part-")]
    if len(parts) != 1:
        raise GateError(f"expected one part for {target}, found {len(parts)}")
    if path_exists(spark, target):
        delete(spark, target)
    rename(spark, f"{staging}/{parts[0]}", target)
    delete(spark, staging)
    return target


def sink_csv_domains(datasets: dict[str, DataFrame], summary: dict, folder: str) -> None:
    """One CSV folder per domain and a JSON manifest."""
    for domain, df in datasets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{domain}")
    spark = next(iter(datasets.values())).sparkSession
    write_json(spark, f"{folder}/integration_manifest.json", summary)


def sink_partitioned(contracts: DataFrame, path: str) -> DataFrame:
    """Rewrite the fact table partitioned by year and month; returns the table as read back.

    Rows are rebalanced by month first: large months are split over several tasks by
    size and small ones share a task, so a month gets few files and no task is large.
    """
    with_month = contracts.withColumn("anio_mes", year_month(F.col("fecha_contrato")))
    balanced = with_month.hint("rebalance", F.col("anio_mes"))
    balanced.write.mode("overwrite").partitionBy("anio_mes").parquet(path)
    return contracts.sparkSession.read.parquet(path).withColumn("anio_mes", F.col("anio_mes").cast("string"))


def recent_partitions(facts: DataFrame, n: int = 6) -> DataFrame:
    """The latest distinct year-months."""
    return facts.select("anio_mes").distinct().orderBy(F.desc("anio_mes")).limit(n)


def partition_prune_filter(facts: DataFrame, n: int = 6, minimum: float = 100_000) -> DataFrame:
    """Contracts over `minimum` in the latest months; the month bound prunes partitions."""
    first = recent_partitions(facts, n).agg(F.min("anio_mes").alias("m")).first()["m"]
    if first is None:
        raise GateError("there are no partitions")
    return facts.where((F.col("anio_mes") >= F.lit(first)) & (F.col("monto") > minimum))


def sink_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Register an output as a table of the catalog."""
    writer = df.write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def entity_totals(spark: SparkSession, table: str, top: int = 5) -> DataFrame:
    """Contracts and rounded amount of the entities with the largest totals."""
    return spark.sql(
        """
        SELECT id_entidad, count(*) AS n_contratos, round(sum(monto), 2) AS monto_total
        FROM IDENTIFIER(:tabla) GROUP BY id_entidad
        ORDER BY monto_total DESC, id_entidad LIMIT :top
        """,
        args={"tabla": table, "top": top},
    )


def sink_staged_publish(
    spark: SparkSession,
    write: Callable[[str], object],
    gate: Callable[[str], object],
    final: str,
) -> None:
    """Write to a hidden folder, run the gate on what was written, then swap it in.

    Whatever fails before the swap leaves the earlier output untouched; a failed swap
    puts it back.
    """
    parent, name = final.rsplit("/", 1)
    token = uuid.uuid4().hex
    staging, backup = f"{parent}/.{name}.staging-{token}", f"{parent}/.{name}.backup-{token}"
    try:
        write(staging)
        gate(staging)
    except Exception:
        delete(spark, staging)
        raise
    had_previous = path_exists(spark, final)
    if had_previous:
        rename(spark, final, backup)
    try:
        rename(spark, staging, final)
    except Exception:
        if had_previous:
            rename(spark, backup, final)
        raise
    if had_previous:
        delete(spark, backup)
