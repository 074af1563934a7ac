"""Versioned tables on Parquet: append, keyed update, time travel, history and change feed.

A full write stores all rows of its version. An update stores only the rows it
changed, so correcting one contract does not copy the table. Reading a version takes
the last full write and lets later changes replace rows by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atalaya.errors import GateError
from atalaya.sources.sinks import path_exists

FULL, UPDATE = "WRITE", "UPDATE"
PREIMAGE, POSTIMAGE, INSERT, DELETE = "update_preimage", "update_postimage", "insert", "delete"


def _rows_path(path: str, version: int) -> str:
    return f"{path}/rows/_version={version}"


def snapshot_history(spark: SparkSession, path: str) -> DataFrame:
    """Versions with their time, operation and rows written."""
    return spark.read.schema("version bigint, momento timestamp, operacion string, filas bigint").parquet(
        f"{path}/versions"
    )


def last_version(spark: SparkSession, path: str) -> int | None:
    if not path_exists(spark, f"{path}/versions"):
        return None
    return snapshot_history(spark, path).agg(F.max("version").alias("v")).first()["v"]


def _commit(df: DataFrame, path: str, operation: str) -> int:
    spark = df.sparkSession
    last = last_version(spark, path)
    version = 0 if last is None else last + 1
    # Rows first, then the log: a version exists once its log row does.
    df.write.mode("overwrite").parquet(_rows_path(path, version))
    written = spark.read.parquet(_rows_path(path, version))
    written.agg(F.count(F.lit(1)).alias("filas")).select(
        F.lit(version).cast("bigint").alias("version"),
        F.current_timestamp().alias("momento"),
        F.lit(operation).alias("operacion"),
        "filas",
    ).write.mode("append").parquet(f"{path}/versions")
    return version


def snapshot_append(df: DataFrame, path: str) -> int:
    """Store all rows as the next version; earlier versions stay readable."""
    return _commit(df, path, FULL)


def snapshot_update(
    spark: SparkSession, path: str, key: Sequence[str], condition: Column, column: str, value: Column
) -> int:
    """Set one column where the condition holds, as the next version."""
    current = snapshot_as_of(spark, path, key)
    changed = current.where(condition).withColumn(column, value.cast(current.schema[column].dataType))
    return _commit(changed, path, UPDATE)


def snapshot_as_of(spark: SparkSession, path: str, key: Sequence[str], version: int | None = None) -> DataFrame:
    """The table as it was at a version, by default the latest."""
    log = {r["version"]: r["operacion"] for r in snapshot_history(spark, path).collect()}
    wanted = max(log) if version is None else version
    if wanted not in log:
        raise GateError(f"{path} has no version {version}")
    base = max(v for v, operation in log.items() if v <= wanted and operation == FULL)
    rows = spark.read.parquet(_rows_path(path, base))
    changes = [v for v in sorted(log) if base < v <= wanted]
    if not changes:
        return rows
    # Changed rows are few; the base is only filtered by their keys.
    stored = None
    for v in changes:
        part = spark.read.schema(rows.schema).parquet(_rows_path(path, v)).withColumn("_version", F.lit(v))
        stored = part if stored is None else stored.unionByName(part)
    others = [c for c in rows.columns if c not in key]
    latest = stored.groupBy(*key).agg(F.max_by(F.struct(*others), "_version").alias("_row"))
    latest = latest.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    return rows.join(latest.select(*key), list(key), "left_anti").select(*rows.columns).unionByName(latest)


def compare_with_version(
    spark: SparkSession, path: str, key: Sequence[str], version: int, column: str
) -> DataFrame:
    """Rows whose `column` differs between a version and the latest one."""
    now = snapshot_as_of(spark, path, key).select(*key, F.col(column).alias("actual"))
    then = snapshot_as_of(spark, path, key, version).select(*key, F.col(column).alias("anterior"))
    return then.join(now, list(key)).where(~F.col("actual").eqNullSafe(F.col("anterior")))


def change_feed(before: DataFrame, after: DataFrame, key: Sequence[str], commit_version: int) -> DataFrame:
    """Row-level changes between two versions with `_change_type` and `_commit_version`."""
    columns = before.columns
    old = before.select(*key, F.struct(*columns).alias("_old"))
    new = after.select(*key, F.struct(*columns).alias("_new"))
    both = old.join(new, list(key), "full").where(~F.col("_old").eqNullSafe(F.col("_new")))

    def image(row: str, change: str) -> Column:
        return F.struct(F.col(row).alias("row"), F.lit(change).alias("_change_type"))

    changes = (
        F.when(F.col("_old").isNull(), F.array(image("_new", INSERT)))
        .when(F.col("_new").isNull(), F.array(image("_old", DELETE)))
        .otherwise(F.array(image("_old", PREIMAGE), image("_new", POSTIMAGE)))
    )
    return both.select(F.inline(changes)).select(
        "row.*", "_change_type", F.lit(commit_version).cast("bigint").alias("_commit_version")
    )
