"""Named sources: registration, scans, snapshot refresh, SQL pass-through."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.session import shared_dir, union_all


def _quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def _path_literal(path: str) -> str:
    return path.replace("`", "``")


def ensure_source(spark: SparkSession, source: str, location: str | None = None) -> None:
    """Create the source database unless it exists, by default in the shared folder."""
    location = location or f"{shared_dir(spark)}/{source}.db"
    where = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(source)} LOCATION '{where}'")


def register_table(
    spark: SparkSession, source: str, table: str, path: str, fmt: str = "parquet"
) -> DataFrame:
    """Point ``source.table`` at files that carry their own schema.

    Calling it again changes nothing but the path.
    """
    ensure_source(spark, source)
    spark.sql(
        f"CREATE OR REPLACE VIEW {_quoted(source, table)} AS "
        f"SELECT * FROM {fmt}.`{_path_literal(path)}`"
    )
    return scan(spark, source, table)


def register_external(
    spark: SparkSession,
    source: str,
    table: str,
    fmt: str,
    options: Mapping[str, str],
    schema: T.StructType | None = None,
) -> DataFrame:
    """Register a table of any Spark format (csv, json, jdbc, ...) with its options.

    An existing table of that name is kept.
    """
    ensure_source(spark, source)
    name = _quoted(source, table)
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, source=fmt, schema=schema, **options)
    return scan(spark, source, table)


def scan(spark: SparkSession, source: str, table: str) -> DataFrame:
    return spark.table(_quoted(source, table))


def table_counts(spark: SparkSession, source: str, tables: list[str]) -> DataFrame:
    """``table_name, n_rows`` of registered tables, as one plan."""
    return union_all(
        [
            scan(spark, source, table)
            .agg(F.count("*").alias("n_rows"))
            .select(F.lit(table).alias("table_name"), "n_rows")
            for table in tables
        ]
    )


def refresh_table(df: DataFrame, source: str, table: str, root: str, version: int | str) -> DataFrame:
    """Write a fresh snapshot beside the old one, then point the view at it.

    Readers see the old or the new snapshot, never a gap; the plan may read the old one. A version
    that exists is refused: overwriting it would delete files under its readers.
    """
    path = f"{root.rstrip('/')}/{table}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return register_table(df.sparkSession, source, table, path)


def run_sql(
    spark: SparkSession,
    query: str,
    args: Mapping[str, Any] | None = None,
    source: str | None = None,
) -> DataFrame:
    """Run query text; values travel as named parameters, never inside the text."""
    if source is None:
        return spark.sql(query, args=dict(args or {}))
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(source)
    try:
        return spark.sql(query, args=dict(args or {}))
    finally:
        spark.catalog.setCurrentDatabase(before)
