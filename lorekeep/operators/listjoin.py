"""Top-k search of question sets of any size over an inverted file, as a join by lists.

Questions are dealt to lists as the rows of the index were, and both sides meet by bundles of lists. Nothing of the questions
reaches the driver or is broadcast. Bundles with many rows or many questions are cut into parts of bounded size, so
every meeting is a group of about ``PART_ROWS`` rows and as many questions, whatever a hot list holds. Within a meeting
a question still reads only the lists whose radius leaves room.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions.filters import compile_filter
from lorekeep.operators import ivf
from lorekeep.operators.kernels import cosine, dense_matrix
from lorekeep.operators.search import hit_schema, rank_hits
from lorekeep.session import checkpointed, union_all

PART_ROWS = 32_768
QUESTIONS_PER_STEP = 4_096
ROWS_PER_STEP = 1_024
SINGLE_ERROR = 1.2e-7  # of a product of unit vectors in single precision, per dimension


@dataclass(frozen=True)
class Lists:
    """The lists of an index as they are met: several in one bundle of bounded size, a larger one cut into parts.

    ``table`` has ``bundle, n_rows``; ``shared`` is a broadcast of the centres, the radii and the bundle of every list.
    """

    table: DataFrame
    bundle_of: np.ndarray
    shared: Any


def read_lists(spark: SparkSession, path: str, index: DataFrame, part_rows: int) -> Lists:
    """Lists in their order, as many in one bundle as hold ``part_rows`` rows together. One row per list reaches the driver."""
    sizes = {r["list_id"]: r["n"] for r in index.groupBy("list_id").agg(F.count("*").alias("n")).collect()}
    centres = ivf.read_tree(spark, path)
    bundle_of, held = np.full(len(centres.lists), -1, np.int32), [0]
    for number, n in sorted(sizes.items()):
        if held[-1] and held[-1] + n > part_rows:
            held.append(0)
        bundle_of[number] = len(held) - 1
        held[-1] += n
    bundles = [(b, n) for b, n in enumerate(held) if n]
    table = checkpointed(spark.createDataFrame(bundles, "bundle int, n_rows bigint").coalesce(1))
    shared = spark.sparkContext.broadcast((centres, ivf.read_radii(spark, path, len(centres.lists)), bundle_of))
    return Lists(table, bundle_of, shared)


def search_join(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int = 5,
    filters: Mapping[str, Any] | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``question_id, id, score, rank``: the exact k most similar rows of the index at ``path`` for every question.

    Every question first meets the bundle of its own list, which gives a k-th score, then the bundles with a list whose
    radius leaves room for a better one. Questions without an id or a vector have no hits, nor have vectors of length zero.
    """
    if k < 1:
        raise ValueError("a join of questions with a base needs a positive k")
    index = ivf.read_index(spark, path)
    if filters is not None:
        index = index.filter(compile_filter(filters, index.schema))
    index = index.select("id", "vector", "list_id")
    lists = read_lists(spark, path, index, part_rows)
    asked = questions.select(F.col("question_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = checkpointed(ivf.assigned(asked, path).withColumnRenamed("id", "question_id"))

    own = _reachable(asked.select("question_id", "vector", "list_id", F.lit(None).cast("double").alias("floor")), lists, True)
    first = checkpointed(rank_hits(_meet(checkpointed(own), index, lists, k, part_rows), k).drop("rank"))
    floors = first.groupBy("question_id").agg(F.count("*").alias("_n"), F.min("score").alias("floor"))
    floors = floors.select("question_id", F.when(F.col("_n") >= k, F.col("floor")).alias("floor"))
    known = asked.hint("merge").join(floors, "question_id", "left")
    others = checkpointed(_reachable(known, lists, False))
    return rank_hits(union_all([first, _meet(others, index, lists, k, part_rows)]), k)


def _reachable(asked: DataFrame, lists: Lists, own: bool) -> DataFrame:
    """``question_id, vector, list_id, floor, bundles``: the bundle of a question's own list, or the others with a list
    that may hold a better row than ``floor``. One row per question that has any, so vectors are not copied yet."""
    fields = [asked.schema[c] for c in ("question_id", "vector", "list_id", "floor")]
    schema = T.StructType([*fields, T.StructField("bundles", T.ArrayType(T.IntegerType()))])
    arrow, shared = to_arrow_schema(schema), lists.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, bundle_of = shared.value
        filled = np.flatnonzero(bundle_of >= 0)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(start, 1024)]).select(arrow.names[:4])
                home = bundle_of[part.column("list_id").to_numpy()]
                met = np.zeros((part.num_rows, int(bundle_of.max(initial=-1)) + 1), bool)
                if own:
                    some = np.flatnonzero(home >= 0)
                    met[some, home[some]] = True
                elif len(filled):
                    floor = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                    away = centres.away(ivf.unit_rows(dense_matrix(part.column("vector"))), None)
                    open_lists = ivf.best_scores(away, radius) >= np.nan_to_num(floor, nan=-np.inf)[None, :] - ivf.ROUNDING
                    open_lists &= np.isfinite(away)
                    firsts = filled[np.flatnonzero(np.diff(bundle_of[filled], prepend=-1))]  # bundles are runs of lists
                    place = np.searchsorted(filled, firsts)
                    met[:, bundle_of[firsts]] = np.logical_or.reduceat(open_lists[filled], place, axis=0).T
                    some = np.flatnonzero(home >= 0)
                    met[some, home[some]] = False
                question, bundle = np.nonzero(met)
                ends = np.searchsorted(question, np.arange(part.num_rows + 1)).astype(np.int32)
                bundles = pa.ListArray.from_arrays(pa.array(ends), pa.array(bundle.astype(np.int32)))
                found = part.append_column("bundles", bundles).filter(pa.array(met.any(axis=1)))
                yield from found.cast(arrow).to_batches()

    return asked.select(*arrow.names[:4]).mapInArrow(run, schema)


def _meet(asked: DataFrame, index: DataFrame, lists: Lists, k: int, part_rows: int) -> DataFrame:
    """``question_id, id, score``: of every part of a bundle the k best rows of each question that reads the bundle.

    A vector is copied once per meeting of up to ``part_rows`` questions and rows, not once per list.
    """
    spread = asked.select("question_id", "vector", "list_id", "floor", F.explode("bundles").alias("bundle"))
    cuts = spread.groupBy("bundle").agg(F.count("*").alias("n_asked")).join(lists.table, "bundle")
    ceil = lambda n: F.ceil(F.col(n) / part_rows).cast("int")
    cuts = checkpointed(cuts.select("bundle", ceil("n_rows").alias("row_parts"), ceil("n_asked").alias("question_parts")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = spread.join(cuts, "bundle").select(
        "bundle", dealt("question_id", "question_parts").alias("question_part"), every("row_parts").alias("row_part"), "question_id", "vector", "list_id", "floor"
    )
    numbers = F.lit([int(b) for b in lists.bundle_of]).cast("array<int>")
    rows = index.withColumn("bundle", F.get(numbers, F.col("list_id")))
    right = rows.join(cuts, "bundle").select(
        "bundle", dealt("id", "row_parts").alias("row_part"), every("question_parts").alias("question_part"), "id", "vector", "list_id"
    )
    schema, arrow = hit_schema(asked.schema["question_id"].dataType, index.schema["id"].dataType)
    shared = lists.shared

    def best(some: pa.Table, rows: pa.Table) -> pa.Table:
        if not some.num_rows or not rows.num_rows:
            return arrow.empty_table()
        centres, radius, _ = shared.value
        question, row, score = _best_rows(some, rows, centres.lists, radius, k)
        columns = [some.column("question_id").take(pa.array(question)), rows.column("id").take(pa.array(row)), pa.array(score)]
        return pa.Table.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    key = ("bundle", "row_part", "question_part")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, schema)


def _best_rows(some: pa.Table, rows: pa.Table, centres: np.ndarray, radius: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Positions of questions and rows and their scores: the best k rows of each question, by score and id.

    A list is met by the questions whose own it is, then by others as far as its radius leaves room above their k-th
    score so far. Products in single precision with a margin for their error choose the pairs that are scored exactly.
    """
    ids = rows.column("id").combine_chunks()
    place = np.empty(rows.num_rows, np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(rows.num_rows)
    matrix, asked = dense_matrix(rows.column("vector")), dense_matrix(some.column("vector"))
    norms, asked_norms = (np.sqrt((m * m).sum(axis=1)) for m in (matrix, asked))
    list_of, own = rows.column("list_id").to_numpy(), some.column("list_id").to_numpy()
    units, asked_units = ivf.unit_rows(matrix), ivf.unit_rows(asked)
    floor = np.nan_to_num(some.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
    floor[asked_norms == 0] = np.inf  # matches nothing
    top = _Top(floor, k, place, matrix, asked, norms, asked_norms)
    single, asked_single = units.astype(np.float32), asked_units.astype(np.float32)
    # of equal vectors in a list only the k of smallest ids can be among the best
    keep = np.lexsort((place, _same(matrix), list_of))
    same = _same(matrix)[keep]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(same) != 0) | (np.diff(list_of[keep]) != 0)]))
    nth = np.arange(len(keep)) - np.repeat(begins, np.diff(np.append(begins, len(keep))))
    keep = keep[(nth < k) & (norms[keep] > 0)]
    numbers, starts = np.unique(list_of[keep], return_index=True)
    members = dict(zip(numbers.tolist(), np.split(keep, starts[1:]) if len(keep) else [], strict=True))
    for number, at in members.items():
        top.meet(np.flatnonzero(own == number), at, single, asked_single)
    for first in range(0, len(asked), QUESTIONS_PER_STEP):
        part = np.arange(first, min(first + QUESTIONS_PER_STEP, len(asked)))
        away = ivf.distances(centres[numbers], asked_units[part])
        for i, (number, at) in enumerate(members.items()):
            may = ivf.best_scores(away[i : i + 1], radius[number : number + 1])[0] >= top.floor[part] - ivf.ROUNDING
            top.meet(part[may & (own[part] != number)], at, single, asked_single)
    return top.result()


def _same(matrix: np.ndarray) -> np.ndarray:
    """Equal numbers for equal rows."""
    packed = np.ascontiguousarray(matrix + 0.0).view(np.dtype((np.void, matrix.shape[1] * 8))).ravel()
    return np.unique(packed, return_inverse=True)[1].reshape(-1)


class _Top:
    """The best k rows of every question so far, and each question's k-th score as the floor of what can still matter."""

    def __init__(self, floor: np.ndarray, k: int, place: np.ndarray, rows: np.ndarray, asked: np.ndarray, norms: np.ndarray, asked_norms: np.ndarray) -> None:
        self.floor, self.k, self.place = floor, k, place
        self.rows, self.asked, self.norms, self.asked_norms = rows, asked, norms, asked_norms
        self.score, self.row = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1, np.int64)
        self.margin = 1e-6 + SINGLE_ERROR * rows.shape[1]

    def meet(self, questions: np.ndarray, rows: np.ndarray, single: np.ndarray, asked: np.ndarray) -> None:
        for first in range(0, len(questions), QUESTIONS_PER_STEP):
            some = questions[first : first + QUESTIONS_PER_STEP]
            wanted = asked[some]
            for start in range(0, len(rows), ROWS_PER_STEP):
                at = rows[start : start + ROWS_PER_STEP]
                near = wanted @ single[at].T
                floor = self.floor[some] - self.margin
                new = np.flatnonzero(np.isneginf(floor))
                if len(new) and len(at) >= self.k:  # these rows give a floor themselves
                    floor[new] = np.partition(near[new], len(at) - self.k, axis=1)[:, len(at) - self.k] - 2 * self.margin
                question, row = np.nonzero(near >= floor.astype(np.float32)[:, None])
                self.add(some[question], at[row])

    def add(self, question: np.ndarray, row: np.ndarray) -> None:
        scores = np.empty(len(question))
        for start in range(0, len(question), 1 << 16):
            part = slice(start, start + (1 << 16))
            dots = np.einsum("ij,ij->i", self.asked[question[part]], self.rows[row[part]])
            scores[part] = cosine(dots, self.asked_norms[question[part]] * self.norms[row[part]])
        good = scores >= self.floor[question]
        question, row, scores = question[good], row[good], scores[good]
        met = np.unique(question)
        question = np.concatenate([np.repeat(met, self.k), question])
        row = np.concatenate([self.row[met].ravel(), row])
        scores = np.concatenate([self.score[met].ravel(), scores])
        filled = row >= 0
        question, row, scores = question[filled], row[filled], scores[filled]
        order = np.lexsort((self.place[row], -scores, question))
        question, row, scores = question[order], row[order], scores[order]
        nth = np.arange(len(question)) - np.searchsorted(question, question, "left")
        best = nth < self.k
        self.score[question[best], nth[best]], self.row[question[best], nth[best]] = scores[best], row[best]
        self.floor[met] = np.maximum(self.floor[met], self.score[met, self.k - 1])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        question, nth = np.nonzero(self.row >= 0)
        return question, self.row[question, nth], self.score[question, nth]
