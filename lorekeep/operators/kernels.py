"""Block scoring and per-task top k, used inside Arrow batches of the search operators.

A kernel prepares a block of rows once and scores it against one step of the questions at a
time, so a task holds one small question matrix, however many questions there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS_PER_PASS = 2048
ROWS_PER_BLOCK = 512
QUESTIONS_PER_STEP = 256
SINGLE_LIMIT = float(1 << 24)

Weights = np.ndarray | None


def flat_values(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row each value belongs to."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # an empty column has no chunk to return
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def dense_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long vectors as doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return flat_values(column)[0].astype(np.float64).reshape(len(column), -1)


def usable(table: pa.Table, key: str) -> pa.Table:
    """Rows with a key and a vector. Done here: as a filter in the plan the test of the vector
    would be pushed below the embedding and compute every vector twice."""
    for name in (key, "vector"):
        if table.column(name).null_count:
            table = table.filter(table.column(name).is_valid())
    return table


def cosine(dots: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cosines rounded half up to six decimals; 0 for vectors of length zero."""
    scaled = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0) * 1e6
    return np.copysign(np.floor(np.abs(scaled) + 0.5), scaled) / 1e6


def bag_entries(column: pa.ChunkedArray, weights: Weights = None) -> tuple[np.ndarray, ...]:
    """(row, bucket, weight) entries of bags of buckets, and the norms of the rows."""
    values, rows = flat_values(column)
    width = int(values.max()) + 1 if len(values) else 1
    keys, counts = np.unique(rows * width + values, return_counts=True)
    row, bucket = keys // width, keys % width
    weight = counts.astype(np.float64)
    if weights is not None:
        weight *= weights[bucket]
    norms = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(column)))
    return row, bucket, weight, norms


class BagKernel:
    """Cosine of bags of hash buckets below ``MAX_DIM``.

    Weights are whole numbers, so dot products are exact.
    """

    def __init__(self, vectors: pa.ChunkedArray, weights: Weights) -> None:
        self.weights, self.questions = weights, vectors

    def rows(self, column: pa.ChunkedArray) -> tuple[np.ndarray, ...]:
        return bag_entries(column, self.weights)

    def step(self, start: int):
        row, bucket, weight, norms = self.rows(self.questions.slice(start, QUESTIONS_PER_STEP))
        vocabulary, at = np.unique(bucket, return_inverse=True)
        matrix = np.zeros((len(vocabulary), len(norms)))
        matrix[at, row] = weight
        columns = np.full(vocabulary.max(initial=0) + 2, -1)  # matrix row of each bucket
        columns[vocabulary] = np.arange(len(vocabulary))
        return columns, {8: matrix, 4: matrix.astype(np.float32)}, norms

    def score(self, step, rows) -> tuple[np.ndarray, np.ndarray]:
        """Scores and which of them are matches: rows that share a bucket."""
        columns, matrices, question_norms = step
        row, bucket, weight, norms = rows
        # No dot product exceeds the product of the norms, so below 2**24 floats are exact too.
        small = norms.max(initial=0) * question_norms.max(initial=0) < SINGLE_LIMIT
        matrix = matrices[4 if small else 8]
        dense = np.zeros((len(norms), len(matrix)), matrix.dtype)
        at = columns[np.minimum(bucket, len(columns) - 1)]
        known = at >= 0
        dense[row[known], at[known]] = weight[known]
        dots = (dense @ matrix).astype(np.float64)
        return cosine(dots, norms[:, None] * question_norms[None, :]), dots > 0


class DenseKernel:
    """Cosine of dense vectors; vectors of length zero never match."""

    def __init__(self, vectors: pa.ChunkedArray) -> None:
        self.questions = vectors

    def rows(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        matrix = dense_matrix(column)
        return matrix, np.sqrt((matrix * matrix).sum(axis=1))

    def step(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rows(self.questions.slice(start, QUESTIONS_PER_STEP))

    def score(self, step, rows) -> tuple[np.ndarray, np.ndarray]:
        scale = rows[1][:, None] * step[1][None, :]
        return cosine(rows[0] @ step[0].T, scale), scale > 0


class TopK:
    """Best k (score, id) per question over the blocks of one task; ties by id."""

    def __init__(self, n_questions: int, k: int) -> None:
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0)] * n_questions
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n_questions
        self.floor = np.full(n_questions, -np.inf)

    def add(self, first: int, scores: np.ndarray, matching: np.ndarray, ids: np.ndarray) -> None:
        matching = matching & (scores >= self.floor[first : first + scores.shape[1]])
        for column in np.flatnonzero(matching.any(axis=0)):
            question = first + int(column)
            rows = np.flatnonzero(matching[:, column])
            found, found_ids = scores[rows, column], ids[rows]
            if len(self.scores[question]):
                found = np.concatenate([self.scores[question], found])
                found_ids = np.concatenate([self.ids[question], found_ids])
            names = found_ids.astype(str) if found_ids.dtype == object else found_ids
            keep = np.lexsort((names, -found))[: self.k]
            self.scores[question], self.ids[question] = found[keep], found_ids[keep]
            if len(keep) == self.k:
                self.floor[question] = found[keep[-1]]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Question positions, ids and scores."""
        sizes = [len(s) for s in self.scores]
        kept = [i for i in self.ids if len(i)]
        ids = np.concatenate(kept) if kept else np.empty(0, object)
        return np.repeat(np.arange(len(sizes)), sizes), ids, np.concatenate([np.empty(0), *self.scores])


def hits_batch(question_ids: pa.Array, questions, ids, scores, schema: pa.Schema) -> pa.RecordBatch:
    columns = [
        question_ids.take(pa.array(questions, pa.int64())).cast(schema.field(0).type),
        pa.array(ids, schema.field(1).type),
        pa.array(scores, pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def score_tables(
    tables: Iterator[pa.Table],
    kernel: BagKernel | DenseKernel,
    question_ids: pa.Array,
    k: int | None,
    schema: pa.Schema,
    probes: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    """Score ``id, vector`` tables; yield the top k of all of them, or every match without k.

    ``probes[list, question]`` limits questions to rows of some lists (column ``list_id``).
    """
    top = TopK(len(question_ids), k) if k else None
    starts = range(0, len(question_ids), QUESTIONS_PER_STEP)
    step = kernel.step(0) if len(starts) == 1 else None
    for table in tables:
        table = usable(table, "id")
        for offset in range(0, table.num_rows, ROWS_PER_PASS):
            part = table.slice(offset, ROWS_PER_PASS)
            blocks = [part.slice(o, ROWS_PER_BLOCK) for o in range(0, part.num_rows, ROWS_PER_BLOCK)]
            ids = [b.column("id").to_numpy() for b in blocks]
            rows = [kernel.rows(b.column("vector")) for b in blocks]
            for start in starts:
                current = step or kernel.step(start)
                for block, block_ids, prepared in zip(blocks, ids, rows, strict=True):
                    scores, matching = kernel.score(current, prepared)
                    if probes is not None:
                        span = slice(start, start + scores.shape[1])
                        matching &= probes[block.column("list_id").to_numpy()][:, span]
                    if top is not None:
                        top.add(start, scores, matching, block_ids)
                    else:
                        row, question = np.nonzero(matching)
                        found = scores[row, question]
                        yield hits_batch(question_ids, start + question, block_ids[row], found, schema)
    if top is not None:
        yield hits_batch(question_ids, *top.result(), schema)
