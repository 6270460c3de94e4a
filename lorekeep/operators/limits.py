"""Ordered limits with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tie_breakers(df: DataFrame) -> list[Column]:
    """Columns in their order; maps and the like, which do not sort, by their JSON."""
    plain = (T.AtomicType, T.ArrayType, T.StructType)
    return [
        F.col(f"`{f.name}`") if isinstance(f.dataType, plain) and "map<" not in f.dataType.simpleString()
        else F.to_json(F.struct(F.col(f"`{f.name}`")))
        for f in df.schema.fields
    ]


def first_rows(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in ``order``; ties are broken by all columns, so the rows do not
    depend on partitions or runs. Spark plans a top-n, beyond its own bound a distributed sort."""
    return df.orderBy(*order, *tie_breakers(df)).limit(limit)
