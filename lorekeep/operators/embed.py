"""Embedders: hashed term bags, document-frequency weights, user models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions.text import DEFAULT_DIM, each, term_buckets
from lorekeep.operators.kernels import bag_entries, usable
from lorekeep.operators.search import VectorKind

IDF_SCALE = 100
ROWS_PER_SLICE = 512  # of an Arrow batch whose postings are made at a time
HASH_DIM = "hash_dim"  # in the metadata of a column of bags: the number of its buckets


def hash_bags(df: DataFrame, content: str = "content", dim: int = DEFAULT_DIM) -> DataFrame:
    """Add ``vector``: one hash bucket per token. Row-local, no shuffle. The column knows its ``dim``."""
    return df.withColumn("vector", term_buckets(F.col(content), dim)).withMetadata("vector", {HASH_DIM: dim})


def postings(bags: DataFrame) -> DataFrame:
    """``id, bucket, w, norm`` rows of the bags; the norm is that of the whole bag.

    Counted within each row: grouping by id and bucket would shuffle every posting.
    """
    schema = T.StructType(
        [
            bags.schema["id"],
            T.StructField("bucket", T.LongType()),
            T.StructField("w", T.LongType()),
            T.StructField("norm", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_SLICE):
                table = usable(pa.Table.from_batches([batch.slice(start, ROWS_PER_SLICE)]), "id")
                row, bucket, counts, norms = bag_entries(table.column("vector"))
                ids = table.column("id").combine_chunks().take(pa.array(row, pa.int64()))
                columns = [
                    ids.cast(arrow.field(0).type),
                    pa.array(bucket, pa.int64()),
                    pa.array(counts.astype("int64")),
                    pa.array(norms[row], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return bags.select("id", "vector").mapInArrow(run, schema)


def document_frequency(bags: DataFrame) -> DataFrame:
    """``bucket, df``: in how many rows a bucket occurs. At most ``dim`` rows."""
    return (
        bags.select(each(F.array_distinct("vector")).alias("bucket"))
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count("*").alias("df"))
    )


def idf_kind(bags: DataFrame, dim: int = DEFAULT_DIM) -> VectorKind:
    """Whole-number inverse document frequencies as bucket weights.

    At most ``dim`` numbers reach the driver, however large the knowledge base is.
    """
    total = bags.count()
    weight = F.round(F.log((F.lit(total) + 1) / (F.col("df") + 1)) * IDF_SCALE).cast("bigint") + 1
    weights = [1] * dim
    for row in document_frequency(bags).select("bucket", weight.alias("w")).toLocalIterator():
        weights[row["bucket"]] = row["w"]
    return VectorKind(weights=tuple(weights))


def embed_with(
    df: DataFrame,
    model: Callable[[pd.Series], pd.Series],
    content: str = "content",
) -> DataFrame:
    """Add ``vector`` from a user model that maps a batch of texts to lists of numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vector=model(batch[content]))

    field = T.StructField("vector", T.ArrayType(T.DoubleType()))
    return df.mapInPandas(run, T.StructType([*df.schema.fields, field]))
