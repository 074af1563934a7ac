"""Small helpers that every operator of this folder uses."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Documents are long, and a batch is held in memory as a whole.
BATCH_ROWS = 512

#: Characters of text worked on at once inside a batch.
CHUNK_CHARS = 4_000_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hand Python at most `rows` rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) != str(rows):
        spark.conf.set(key, str(rows))


def documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only id and text, under fixed names; a null text is an empty one.

    Reading two columns here keeps any other column of the input, whatever its name,
    away from the operators.
    """
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )


def give_back() -> None:
    """Return memory that is free inside this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` with memory given back before and after: Python workers serve many tasks, and idle ones keep what they hold."""

    def whole(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return whole


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with columns named by their place, so that no helper column can clash with one."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes, one given batch at least."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` that hold about `limit` characters each, one text at least."""
    return ranges_of(map(len, texts), limit)


def ranges_of(lengths: Iterable[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of places whose lengths add up to about `limit`, one place at least."""
    start = size = end = 0
    for i, length in enumerate(lengths):
        if i > start and size + length > limit:
            yield start, i
            start, size = i, 0
        size += length
        end = i + 1
    if start < end:
        yield start, end
