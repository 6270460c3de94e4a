"""Deterministic scores for a pair of texts, and the hook for user scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import token_set

PairScorer = Callable[[Column, Column], Column]
PandasPairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def jaccard(left: Column, right: Column) -> Column:
    """Shared distinct tokens over all distinct tokens of both texts; 0 without any."""
    a, b = token_set(left), token_set(right)
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))),
        F.lit(0.0),
    )


def coverage(wanted: Column, found: Column) -> Column:
    """Share of the distinct tokens of ``wanted`` that occur in ``found``; 0 without any."""
    a, b = token_set(wanted), token_set(found)
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0)
    )


def score_pairs(
    pairs: DataFrame,
    left: str,
    right: str,
    scorer: PairScorer | None = None,
    pandas_scorer: PandasPairScorer | None = None,
    out: str = "score",
) -> DataFrame:
    """Add ``out``: a column scorer, or a user model over Arrow batches."""
    if pandas_scorer is None:
        score = (scorer or jaccard)(F.col(left), F.col(right))
        return pairs.withColumn(out, F.round(score.cast("double"), 6))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: pandas_scorer(batch[left], batch[right])})

    schema = T.StructType([*pairs.schema.fields, T.StructField(out, T.DoubleType())])
    return pairs.mapInPandas(run, schema)
