"""Top-k similarity search of many questions over a whole knowledge base.

One pass over the knowledge base scores every block of rows against all questions with
numpy and keeps k rows per question, so only ``questions x k`` rows per task are shuffled.
Question vectors are measured before they are broadcast; larger question sets are cut into blocks
of broadcast size, and each block is one more pass over the knowledge base. Nothing of the base is
replicated or shuffled.

Scores are rounded to six decimals and ties are broken by id.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions.filters import compile_filter
from lorekeep.operators.kernels import BagKernel, DenseKernel, score_tables, usable
from lorekeep.session import checkpointed

BROADCAST_BYTES = 64 << 20
LOOKUP_BYTES = 32 << 20
LOOKUP_IDS = 1_000


@dataclass(frozen=True)
class VectorKind:
    """How to score a vector column: bags of hash buckets or dense arrays."""

    dense: bool = False
    weights: tuple[int, ...] | None = None

    def kernel(self, vectors: pa.ChunkedArray) -> BagKernel | DenseKernel:
        if self.dense:
            return DenseKernel(vectors)
        weights = None if self.weights is None else np.asarray(self.weights, np.float64)
        return BagKernel(vectors, weights)


BAG = VectorKind()
DENSE = VectorKind(dense=True)


def hit_schema(question_type: T.DataType, id_type: T.DataType) -> tuple[T.StructType, pa.Schema]:
    schema = T.StructType(
        [
            T.StructField("question_id", question_type),
            T.StructField("id", id_type),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return schema, to_arrow_schema(schema)


def question_bytes(questions: DataFrame, extra_per_row: int = 0) -> int:
    """Upper estimate of the memory that the vectors of a question set need."""
    size = questions.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("values")
    ).first()
    return (64 + extra_per_row) * size["rows"] + 16 * size["values"]


def scan_scores(
    kb: DataFrame,
    questions: pa.Table,
    k: int | None,
    kind: VectorKind,
    schema: T.StructType,
    arrow: pa.Schema,
    probes: np.ndarray | None = None,
) -> DataFrame:
    """One pass over ``kb`` with the (size-checked) questions broadcast.

    ``probes[list, question]`` tells which lists of a partitioned index a question reads;
    ``kb`` then has a ``list_id`` column.
    """
    if probes is None:
        questions = usable(questions, "question_id")
    shared = kb.sparkSession.sparkContext.broadcast((questions, probes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, allowed = shared.value
        kernel = kind.kernel(local.column("vector"))
        ids = local.column("question_id").combine_chunks()
        tables = (pa.Table.from_batches([b]) for b in batches)
        yield from score_tables(tables, kernel, ids, k, arrow, allowed)

    return kb.mapInArrow(scan, schema)


def score_vectors(
    kb: DataFrame,
    questions: DataFrame,
    k: int | None,
    kind: VectorKind = BAG,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``question_id, id, score`` of at most k rows per question and task.

    ``kb`` has ``id, vector``; ``questions`` has ``question_id, vector``. ``k`` of None or
    below one keeps every match.
    """
    k = k if k and k > 0 else None
    schema, arrow = hit_schema(
        questions.schema["question_id"].dataType, kb.schema["id"].dataType
    )
    kb, questions = kb.select("id", "vector"), checkpointed(questions.select("question_id", "vector"))
    blocks = max(1, math.ceil(question_bytes(questions) / broadcast_bytes))
    found = []
    for block in range(blocks):
        chosen = questions if blocks == 1 else questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        found.append(scan_scores(kb, chosen.toArrow(), k, kind, schema, arrow))
    return functools.reduce(DataFrame.unionByName, found)


def rank_hits(hits: DataFrame, k: int, by: str = "score", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Global top k per question. The rank filter is planned as a group limit ahead of the
    shuffle, so each task sends at most k rows per question."""
    order = Window.partitionBy("question_id").orderBy(F.desc(by), *keys)
    return hits.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(
        F.col("rank") <= k
    )


def search(
    kb: DataFrame,
    questions: DataFrame,
    k: int | None = 5,
    filters: Mapping[str, Any] | Column | None = None,
    kind: VectorKind = BAG,
    **limits: int,
) -> DataFrame:
    """``question_id, id, score, rank``: the k most similar rows for every question.

    Filters apply before scoring, so the result is the exact top k of the qualifying rows.
    Without a positive ``k`` the result is ``question_id, id, score`` of every match: ranking all
    rows of a question would put them in one task.
    """
    if filters is not None:
        predicate = filters if isinstance(filters, Column) else compile_filter(filters, kb.schema)
        kb = kb.filter(predicate)
    hits = score_vectors(kb, questions, k, kind, **limits)
    return rank_hits(hits, k) if k and k > 0 else hits


def lookup(hits: DataFrame, kb: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join columns of ``kb`` to hits that are stored, not computed again.

    Only winners move: what ``thinned`` lets through is little more than the hits' own rows, and only that is joined.
    """
    return hits.join(thinned(kb.select("id", *columns), hits.select("id").distinct()), "id")


def thinned(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is one of the distinct ``ids``, and where these are many perhaps some others.

    Few ids become a filter, so the scan can skip row groups by their statistics or Bloom filters. More are counted; up
    to ``LOOKUP_BYTES`` they are broadcast, so no content is shuffled. Beyond, each id sets one bit of a filter of at
    most that size, and rows that share a bit get through.
    """
    wanted = [row["id"] for row in ids.limit(LOOKUP_IDS + 1).collect()]
    if len(wanted) <= LOOKUP_IDS:
        whole = wanted and all(isinstance(i, int) for i in wanted)
        few = F.expr(f"id IN ({', '.join(map(str, wanted))})") if whole else F.col("id").isin(wanted)
        return rows.filter(few)
    if ids.count() * 64 <= LOOKUP_BYTES:
        return rows.join(F.broadcast(ids), "id", "left_semi")
    return maybe_wanted(rows, ids)


def maybe_wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id shares its bit with one of ``ids``; the bits have at most ``LOOKUP_BYTES``."""
    n_bits = LOOKUP_BYTES * 8
    slot = F.pmod(F.xxhash64("id"), F.lit(n_bits))
    buckets = (
        ids.select((slot + 1).alias("s"))
        .groupBy(F.bitmap_bucket_number("s").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        .collect()
    )
    flags = np.zeros(n_bits // 8, np.uint8)
    for row in buckets:
        start = (row["bucket"] - 1) * 4096
        flags[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    told = rows.sparkSession.sparkContext.broadcast(flags)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_slot").to_numpy()
            good = (told.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            yield batch.drop_columns(["_slot"]).filter(pa.array(good))

    return rows.withColumn("_slot", slot).mapInArrow(keep, rows.schema)


def fetch(hits: DataFrame, kb: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join content and metadata of ``kb`` to hits.

    The hits are written first: they are scored once however often they are used.
    """
    return lookup(checkpointed(hits), kb, columns)
