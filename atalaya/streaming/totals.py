"""Running totals per entity over a folder of arriving CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from atalaya.sources.sinks import delete, list_names, path_exists

# --- fixed values: layout of an arriving file ---------------------------------
STREAM_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id_contrato", "id_proveedor", "id_entidad", "modalidad")]
    + [T.StructField("monto", T.DoubleType())]
)
TRIGGER = "2 seconds"
# --------------------------------------------------------------------------------


def scan_stream_csv(spark: SparkSession, folder: str, schema: T.StructType = STREAM_SCHEMA) -> DataFrame:
    """Stream of the CSV files that arrive in a folder, with a fixed schema."""
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def entity_running_totals(stream: DataFrame) -> DataFrame:
    """Contracts and accumulated amount per entity; the state is one row per entity."""
    return stream.groupBy("id_entidad").agg(
        F.count("id_contrato").alias("n_contratos"), F.sum("monto").alias("monto_acumulado")
    )


def stream_entity_totals(
    stream: DataFrame,
    checkpoint: str,
    output: str,
    *,
    available_now: bool = False,
    query_name: str | None = None,
) -> StreamingQuery:
    """Keep a Parquet table of all totals up to date.

    Every micro-batch writes the complete result to a folder of its own number, so a
    repeated batch replaces itself and readers never see half of one. The two latest
    batches are kept.
    """

    def store(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{output}/batch={batch:010d}")
        outdated = f"{output}/batch={batch - 2:010d}"
        if batch >= 2 and path_exists(totals.sparkSession, outdated):
            delete(totals.sparkSession, outdated)

    writer = (
        entity_running_totals(stream)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def stream_to_memory(stream: DataFrame, checkpoint: str, name: str, *, available_now: bool = False) -> StreamingQuery:
    """The same totals in an in-memory table, for small demonstrations."""
    writer = (
        entity_running_totals(stream)
        .writeStream.format("memory")
        .queryName(name)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGER)
    return writer.start()


def stream_drain_read(query: StreamingQuery, spark: SparkSession, output: str) -> DataFrame:
    """Wait until all available input is processed, then read the latest totals in order."""
    query.processAllAvailable()
    return latest_totals(spark, output)


def drain_memory(query: StreamingQuery, spark: SparkSession, name: str) -> DataFrame:
    """Wait for the in-memory table and read it in order."""
    query.processAllAvailable()
    return spark.table(name).orderBy("id_entidad")


def latest_totals(spark: SparkSession, output: str) -> DataFrame:
    """Totals of the last batch that was written to its end."""
    batches = [
        n for n in list_names(spark, output)
        if n.startswith("batch=") and path_exists(spark, f"{output}/{n}/_SUCCESS")
    ]
    if not batches:
        return spark.createDataFrame([], "id_entidad string, n_contratos bigint, monto_acumulado double")
    return spark.read.parquet(f"{output}/{max(batches)}").orderBy("id_entidad")
