"""Metadata filter documents compiled to one pushable predicate."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The range operators of a filter document.
RANGE_OPERATORS = {
    "$gt": operator.gt,
    "$gte": operator.ge,
    "$lt": operator.lt,
    "$lte": operator.le,
}


def _literal(name: str, dtype: T.DataType, value: Any) -> Column:
    """A literal of the column's own kind; raises rather than rely on implicit casts."""
    if isinstance(dtype, T.BooleanType):
        fits = isinstance(value, bool)
    elif isinstance(dtype, T.NumericType):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool)
    elif isinstance(dtype, T.StringType):
        fits = isinstance(value, str)
    elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            value = dt.datetime.fromisoformat(value)
            if isinstance(dtype, T.DateType):
                value = value.date()
        fits = isinstance(value, dt.date)
        if fits:
            text = value.isoformat(" ") if isinstance(value, dt.datetime) else value.isoformat()
            return F.lit(text).cast(dtype)
    else:
        raise TypeError(f"column {name!r} of type {dtype.simpleString()} cannot be filtered")
    if not fits:
        raise TypeError(
            f"{value!r} cannot be compared with column {name!r} of type {dtype.simpleString()}"
        )
    return F.lit(value)


def compile_filter(filters: Mapping[str, Any] | None, schema: T.StructType) -> Column:
    """AND of ``{column: value}`` and ``{column: {"$gt": value, ...}}`` conditions.

    ``None`` as a value means IS NULL. Unknown columns or operators raise: dropping a
    condition silently would widen the result.
    """
    conditions: list[Column] = []
    for name, wanted in (filters or {}).items():
        if name not in schema.fieldNames():
            raise ValueError(f"unknown filter column {name!r}")
        column, dtype = F.col(f"`{name}`"), schema[name].dataType
        if isinstance(wanted, Mapping):
            for op, value in wanted.items():
                if op not in RANGE_OPERATORS:
                    raise ValueError(f"unknown filter operator {op!r} on column {name!r}")
                if value is None:
                    raise ValueError(f"{op} on column {name!r} needs a value")
                conditions.append(RANGE_OPERATORS[op](column, _literal(name, dtype, value)))
        elif wanted is None:
            conditions.append(column.isNull())
        else:
            conditions.append(column == _literal(name, dtype, wanted))
    return functools.reduce(operator.and_, conditions, F.lit(True))
