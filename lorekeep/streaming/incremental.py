"""Rows new since the last run, as a stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def folder_per_batch(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that overwrites one folder per batch, so a repeated batch adds nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return write


def ingest_new(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    fmt: str = "parquet",
    max_files_per_batch: int | None = None,
) -> None:
    """Hand the files that arrived below ``source`` since the last call to ``write``.

    ``write(batch, batch_id)`` may be called again for the same batch after a failure and must
    then replace what it wrote, as ``folder_per_batch`` and ``KnowledgeBase.append`` do.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    query = (
        reader.load(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
