"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed partition is split even when that costs one more shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app_name: str,
    *,
    master: str | None = None,
    shuffle_partitions: int | None = None,
) -> SparkSession:
    """Session for a job; the master comes from spark-submit unless one is given."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        if not master.strip():
            raise ValueError("master must not be empty")
        builder = builder.master(master)
    if shuffle_partitions is not None:
        if shuffle_partitions < 1:
            raise ValueError("shuffle_partitions must be a positive integer")
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the run-time re-planning that the operators count on."""
    for key, value in _ADAPTIVE.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Rows that a shuffle partition starts with at most. Too many in one task, and it spills what it puts in order.
SHUFFLE_ROWS = 250_000
START_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def deal(spark: SparkSession, rows: int) -> None:
    """Let shuffles of `rows` rows start with as many partitions as these need; re-planning joins those that turn out small.

    With a fixed number of partitions the rows of a task, and with them what it spills, would grow with the input.
    """
    wanted = -(-rows // SHUFFLE_ROWS)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(START_PARTITIONS, str(wanted))
    else:  # an earlier, larger input may have set it
        spark.conf.unset(START_PARTITIONS)


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: `spark.checkpoint.dir` of the session.

    A local session without that setting gets a scratch folder. On a cluster the
    setting is required, since a machine-local folder does not outlive its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_location(spark: SparkSession, label: str) -> str:
    """A location under the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/atalaya/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and continue from the written rows.

    Later stages read the table, so losing an executor repeats one stage and not
    the whole history, and values that depend on partitioning stay fixed.
    """
    spark = df.sparkSession
    location = new_location(spark, label)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(location)
    kept = spark.read.schema(df.schema).parquet(location)
    kept._kept_at = location
    return kept


#: Rows of a partition that a model is fitted on. Samples are seeded by partition, so their number comes from the rows alone.
#: Every task of every iteration reports to the driver, so beyond `FIT_PARTS` partitions grow, up to `MOST_FIT_ROWS`.
FIT_ROWS, FIT_PARTS, MOST_FIT_ROWS = 10_000, 64, 1_000_000


def fit_partitions(rows: int) -> int:
    return max(min(1 + rows // FIT_ROWS, FIT_PARTS), -(-rows // MOST_FIT_ROWS))


def spread(df: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """The `rows` rows in a number of partitions that follows from it, in a fixed order inside each, by the given plain columns.

    So a fit that samples by partition gives the same model on any number of cores, and grows with its rows.
    """
    return df.repartition(fit_partitions(rows), *columns).sortWithinPartitions(*columns)


def discard(kept: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing reads any more."""
    spark, location = kept.sparkSession, kept._kept_at
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_parallel(spark: SparkSession, tasks: Sequence[Callable[[], object]], parallelism: int = 4) -> list:
    """Run independent jobs from a few driver threads, as cross-validation does."""
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks, chunksize=1)
