"""Labelled rows for the classifiers: folds by id, a bounded sample, stored feature tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.tables import require

FOLDS = 5


def fold(id_column: Column) -> Column:
    """CRC-32 of the id as text, modulo 5 (NULL: fold 0). Fold 0 is held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS, F.lit(0))


def training_labels(labels: DataFrame, id_column: str, label: str, bound: int | None = None) -> DataFrame:
    """``id, label`` (0.0 or 1.0) of ids outside fold 0.

    Rows without an id or a label are left out; of several labels of one id the mean counts, 1 from a half on. With
    a bound, ids whose hash falls below bound / rows stay: about ``bound`` rows, whatever the table.
    """
    require(labels, id_column, label)
    rows = labels.select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("label"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL").filter(fold(F.col("id")) != 0)
    rows = rows.groupBy("id").agg(F.when(F.avg("label") >= 0.5, 1.0).otherwise(0.0).alias("label"))
    if bound is None:
        return rows
    known = rows.count()
    if known <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / known))


def to_rows(features: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix and labels of a bounded sample, in the order of the ids' hashes."""
    table = features.orderBy(F.xxhash64("id"), "id", *names).select(*names, "label").toArrow()
    return np.column_stack([table.column(n).to_numpy() for n in names]).astype(np.float64), table.column("label").to_numpy()
