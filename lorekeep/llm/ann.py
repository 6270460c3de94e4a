"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every vector is centred on the mean of all, rotated at random and kept as the signs of its
components: one bit per dimension, its length and its alignment with the signs. From these the
inner product with a query is estimated without touching the vector, and the error is at most
``epsilon`` standard deviations of a random direction. Only vectors whose upper bound reaches the
k-th best lower bound (later: the k-th best exact score) are scored again with the original numbers.

Queries are cut into blocks of checked size; each block meets all index rows in one scan. A task
returns at most k rows per query. Of equal vectors only the k + 1 smallest ids can ever be among
the k nearest of a query, so the others are left out of the index (not of the queries), by a window limit that acts
ahead of the shuffle; a vector that a third of the rows share is scored k + 1 times.

Vectors that are NULL, zero or hold NULL or non-finite numbers take no part, nor do those whose
length is not the most frequent one (ties: the longer). Rows of one id and one vector count once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.tables import checkpointed, require

BLOCK_BYTES = 16 << 20
SCAN_ROWS = 2048
SCAN_QUERIES = 512
RERANK_PAIRS = 1 << 15
EPSILON = 1.9


def usable(vector: str) -> Column:
    """Not NULL, no NULL or non-finite component, not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def prepared(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id`` (bigint), ``vector`` of the rows that take part."""
    require(rows, id_column, vector)
    good = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("vector"))
    return good.filter(usable("vector")).filter("id IS NOT NULL")


def _matrix(column: pa.Array, dim: int, kind: type = np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def mean_vector(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean over all rows: one partial sum per task and dimension is shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for batch in batches:
            total, n = total + _matrix(batch.column("vector"), dim).sum(axis=0), n + batch.num_rows
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim, dtype=np.int32), "total": total, "n": np.full(dim, n)})

    parts = rows.select("vector").mapInArrow(sums, "at int, total double, n bigint")
    found = parts.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("at").collect()
    return np.array([r["mean"] or 0.0 for r in found])


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def build_index(rows: DataFrame, dim: int, k: int, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """``id, vector, code, scale, spread`` of every distinct vector, and the mean.

    ``scale`` turns the sign product into the estimate, ``spread`` times the query's length and
    epsilon bounds its error.
    """
    centre, turn = mean_vector(rows, dim), rotation(dim, seed)
    same = Window.partitionBy(F.xxhash64("vector"), "vector").orderBy("id")
    rows = rows.withColumn("_n", F.dense_rank().over(same)).filter(F.col("_n") <= k + 1)
    rows = rows.withColumn("_before", F.lag("id").over(same)).filter("_before IS NULL OR _before <> id").select("id", "vector")
    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("spread", T.DoubleType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = _matrix(batch.column("vector"), dim) - centre
            length = np.linalg.norm(rest, axis=1)
            unit = (rest / np.where(length, length, 1)[:, None]) @ turn.T
            aligned = np.abs(unit).sum(axis=1) / math.sqrt(dim)
            safe = np.where(length > 0, aligned, 1.0)
            codes = np.packbits(unit > 0, axis=1)
            spread = length * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / math.sqrt(max(1, dim - 1))
            arrays = [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length / safe), pa.array(spread)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return checkpointed(rows.mapInArrow(encode, schema)), centre


class _Best:
    """The k best exact scores of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge hits, given in the order of their queries."""
        for q, part in _runs(queries):
            s, i = np.concatenate([self.scores[q], scores[part]]), np.concatenate([self.ids[q], ids[part]])
            top = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[top], i[top]


def _runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
        if b > a:
            yield values[a], slice(a, b)


def scan_block(index: DataFrame, queries: pa.Table, centre: np.ndarray, dim: int, k: int, epsilon: float, seed: int) -> DataFrame:
    """``query_id, vec_id, score``: each task's k nearest of each query of a block."""
    shared = index.sparkSession.sparkContext.broadcast(
        (np.asarray(queries.column("id")), _matrix(queries.column("vector").combine_chunks(), dim))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        turned = (vectors @ rotation(dim, seed).T / math.sqrt(dim)).astype(np.float32)
        base, lengths = (vectors @ centre).astype(np.float32), np.linalg.norm(vectors, axis=1).astype(np.float32)
        slack = np.float32(1e-4)  # the estimate is made in single floats
        best = _Best(len(query_ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(start, SCAN_ROWS)
                ids = part.column("id").to_numpy()
                rows = _matrix(part.column("vector"), dim)
                packed = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
                scale, spread = (part.column(c).to_numpy().astype(np.float32) for c in ("scale", "spread"))
                norms = np.linalg.norm(rows, axis=1).astype(np.float32)
                for q in range(0, len(query_ids), SCAN_QUERIES):
                    own = slice(q, q + SCAN_QUERIES)
                    estimate = (turned[own] @ signs.T) * scale + base[own, None]
                    error = lengths[own, None] * (np.float32(epsilon) * spread + slack * norms)
                    estimate[query_ids[own, None] == ids] = -np.inf
                    floor = best.scores[own, -1].copy()
                    if len(ids) > k:
                        low = np.partition(estimate - error, len(ids) - k, axis=1)[:, len(ids) - k]
                        floor = np.maximum(floor, low)
                    at, row = np.nonzero((estimate + error >= floor[:, None]) & (estimate > -np.inf))
                    if len(at):
                        scores = np.empty(len(at))
                        for p in range(0, len(at), RERANK_PAIRS):
                            own_pairs = slice(p, p + RERANK_PAIRS)
                            scores[own_pairs] = np.einsum("ij,ij->i", vectors[q + at[own_pairs]], rows[row[own_pairs]])
                        best.add(q + at, ids[row], scores)
        at, rank = np.nonzero(best.scores > -np.inf)
        yield pa.RecordBatch.from_pydict({"query_id": query_ids[at], "vec_id": best.ids[at, rank], "score": best.scores[at, rank]})

    return index.mapInArrow(scan, "query_id bigint, vec_id bigint, score double")


def nearest(rows: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int = 20, epsilon: float = EPSILON, block_bytes: int = BLOCK_BYTES, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query id its k nearest rows of another id.

    ``queries`` has the columns of ``rows``. Ids are integers of any width. Inner products need equal lengths, so every
    length of vector has an index of its own and its queries are answered from it. Query rows of one id share one
    list. An empty side gives no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    empty = rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good, asked = prepared(rows, id_column, vector), checkpointed(prepared(queries, id_column, vector).distinct())
    sizes = [r["d"] for r in asked.select(F.size("vector").alias("d")).distinct().collect()]
    hits = [h for dim in sorted(sizes) for h in _hits(good.filter(F.size("vector") == dim), asked.filter(F.size("vector") == dim), dim, k, epsilon, block_bytes, seed)]
    if not hits:
        return empty
    found = functools.reduce(DataFrame.unionAll, hits)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _hits(good: DataFrame, asked: DataFrame, dim: int, k: int, epsilon: float, block_bytes: int, seed: int) -> list[DataFrame]:
    """``query_id, vec_id, score`` per block of the queries of one length; no block where no row has that length."""
    if good.isEmpty():
        return []
    index, centre = build_index(good, dim, k, seed)
    count = asked.count()
    blocks = max(1, math.ceil(count * (8 * dim + 16) / block_bytes))
    hits = []
    for b in range(blocks if count else 0):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            hits.append(scan_block(index, block, centre, dim, k, epsilon, seed))
    return hits
