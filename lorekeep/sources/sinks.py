"""Writing results as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace table ``name`` with ``df`` and return it read back."""
    writer = df.write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def append_columns(df: DataFrame, name: str, columns: list[str]) -> None:
    """``INSERT INTO name (columns) SELECT columns``: matched by name, not by position."""
    target = df.sparkSession.table(name).columns
    if sorted(columns) != sorted(target):
        raise ValueError(f"table {name} has columns {target}, not {columns}")
    df.select(*target).write.insertInto(name)
