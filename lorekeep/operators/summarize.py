"""Extractive summaries: the sentences with the most widely used words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import DEFAULT_DIM, sentences, term_buckets
from lorekeep.operators.embed import document_frequency
from lorekeep.operators.models import number_array


def frequency_table(bags: DataFrame, dim: int = DEFAULT_DIM) -> list[int]:
    """Document frequency of every bucket: ``dim`` numbers, however many rows there are."""
    table = [0] * dim
    for row in document_frequency(bags).collect():
        table[row["bucket"]] = row["df"]
    return table


def summary(text: str, frequencies: list[int], n_sentences: int = 2) -> Column:
    """The ``n_sentences`` best sentences in their original order, joined by ". ".

    A sentence scores the mean document frequency of its tokens; earlier sentences win ties.
    Computed within the row.
    """
    table = number_array(frequencies)
    dim = len(frequencies)

    def score(sentence: Column) -> Column:
        return F.aggregate(
            term_buckets(sentence, dim),
            F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, b: F.struct(
                (acc["sum"] + F.get(table, b)).alias("sum"), (acc["n"] + 1).alias("n")
            ),
            lambda acc: F.coalesce(F.try_divide(acc["sum"], acc["n"]), F.lit(0.0)),
        )

    ranked = F.array_sort(
        F.transform(
            sentences(text),
            lambda s, i: F.struct((-score(s)).alias("cost"), i.alias("at"), s.alias("text")),
        )
    )
    chosen = F.array_sort(
        F.transform(F.slice(ranked, 1, n_sentences), lambda x: F.struct(x["at"], x["text"]))
    )
    return F.array_join(F.transform(chosen, lambda x: x["text"]), ". ")
