"""The shared folder named by the session, and tables written there."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder; nothing is created yet.

    All folders of an application lie below one named after it, which may be deleted when the
    application and the readers of its results are done.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/lorekeep-{application}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so several readers do not recompute it."""
    path = new_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, or None where there is none yet. A given schema is not read
    from the files."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name.

    Spark 4.1 may treat the union of hash-partitioned inputs as hash-partitioned although
    adaptive execution has since merged partitions of one input only; rows then miss each other
    in a later grouping or join. Plans are made when a result is read, so the switch below must
    outlive this call; it only costs a possible extra shuffle.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return functools.reduce(DataFrame.unionByName, frames)
