"""Inverted-file index over dense vectors: k-means lists stored as partitions.

Vectors are scaled to unit length, so cosine and Euclidean order agree. Every list keeps its
centre and radius; the triangle inequality then bounds the best score a list can offer, which
makes the default search exact while lists that cannot win are not read. An index may have two levels of centres: groups, and
the lists of each group.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lorekeep.functions.filters import compile_filter
from lorekeep.operators.kernels import dense_matrix, usable
from lorekeep.operators.search import (
    BROADCAST_BYTES,
    DENSE,
    hit_schema,
    question_bytes,
    rank_hits,
    scan_scores,
    search,
)
from lorekeep.session import checkpointed, stored_table

ROUNDING = 2e-6
TRAINING_ROWS_PER_LIST = 256
MARK = "_mark"


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows x centres."""
    squares = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(squares - 2.0 * rows @ centres.T, 0.0))


def _unit_features(vectors: DataFrame) -> DataFrame:
    """Unit vectors for training, made in one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = usable(pa.Table.from_batches([batch]), "id").column("vector")
            if len(rows):
                units = unit_rows(dense_matrix(rows))
                sizes = np.arange(len(units) + 1, dtype=np.int32) * units.shape[1]
                yield pa.RecordBatch.from_pydict({"unit": pa.ListArray.from_arrays(sizes, units.ravel())})

    units = vectors.select("id", "vector").mapInArrow(run, "unit array<double>")
    return units.select(array_to_vector("unit").alias("features"))


def _centres(features: DataFrame, k: int, seed: int, iterations: int) -> np.ndarray:
    """At most ``k`` centres; one where all vectors are alike, which k-means does not take."""
    some = features.distinct().limit(2).collect()
    if k < 2 or len(some) < 2:
        return np.array([row["features"].toArray() for row in some[:1]])
    return np.array(KMeans(k=k, seed=seed, maxIter=iterations, initMode="random").fit(features).clusterCenters())


def _assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``list_id`` of the nearest centre and ``away``, the distance to it.

    Centres beyond the broadcast limit are met in blocks, each a pass that keeps the nearer one.
    """
    step = max(1, BROADCAST_BYTES // max(1, centres[0].nbytes))
    added = [T.StructField("away", T.DoubleType()), T.StructField("list_id", T.IntegerType())]
    schema = T.StructType([*rows.schema.fields, *added])
    rows = rows.withColumn("away", F.lit(None).cast("double")).withColumn("list_id", F.lit(None).cast("int"))
    for first in range(0, len(centres), step):
        shared = rows.sparkSession.sparkContext.broadcast((first, centres[first : first + step]))
        rows = rows.mapInArrow(_nearer(shared, to_arrow_schema(schema)), schema)
    return rows


def _nearer(shared, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, centres = shared.value
        for batch in batches:
            table = usable(pa.Table.from_batches([batch]), "id")
            if not table.num_rows:
                continue
            away = distances(unit_rows(dense_matrix(table.column("vector"))), centres)
            nearest = away.argmin(axis=1)
            away = away[np.arange(len(nearest)), nearest]
            before = table.column("away").to_numpy(zero_copy_only=False).astype(np.float64)
            lists = np.nan_to_num(table.column("list_id").to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            nearer = np.isnan(before) | (away < before)
            table = table.drop_columns(["away", "list_id"])
            table = table.append_column("away", pa.array(np.where(nearer, away, before), pa.float64()))
            table = table.append_column("list_id", pa.array(np.where(nearer, nearest + first, lists), pa.int32()))
            yield from table.select(arrow.names).cast(arrow).to_batches()

    return run


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with a hash of all they hold, by which changed rows are found."""
    return rows.withColumn(MARK, F.xxhash64(F.to_json(F.struct(*[c for c in rows.columns]))))


def _write(assigned: DataFrame, path: str, version: int) -> None:
    """One folder per version and list. Rebalancing merges small lists and splits a hot one over
    tasks. The largest distance of each list is stored beside it."""
    balanced = assigned.hint("rebalance", "list_id")
    balanced.write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists/version={version}")
    written = assigned.sparkSession.read.parquet(f"{path}/lists/version={version}")
    radii = written.groupBy("list_id").agg(F.max("away").alias("radius"))
    radii.coalesce(1).write.mode("overwrite").parquet(f"{path}/radii/version={version}")


def default_lists(rows: int) -> int:
    """The square root of the number of rows, the usual balance of lists and list length."""
    return max(1, math.isqrt(rows))


def build_index(
    vectors: DataFrame, path: str, lists: int | None = None, seed: int = 42, iterations: int = 5
) -> None:
    """Train ``lists`` centres and write every row to its list as version 0.

    ``vectors`` has ``id, vector`` and columns to filter by. Centres are trained on about
    ``TRAINING_ROWS_PER_LIST`` rows per list, by the hash of the id.
    """
    rows = vectors.count()
    lists = lists or default_lists(rows)
    share = min(1.0, lists * TRAINING_ROWS_PER_LIST / max(1, rows))
    sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    features = checkpointed(_unit_features(sample))
    centres = _centres(features, lists, seed, iterations)
    numbered = [(i, [float(x) for x in centre]) for i, centre in enumerate(centres)]
    saved = vectors.sparkSession.createDataFrame(numbered, "list_id int, centre array<double>")
    saved.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write(_assign(marked(vectors), centres), path, 0)


def build_tree_index(
    vectors: DataFrame, path: str, lists: int | None = None, seed: int = 42, iterations: int = 5
) -> None:
    """The same index with two levels of centres: a row meets about twice the square root of the lists.

    Centres of groups are trained on a sample as in ``build_index``; then every group trains its own lists, as
    many as its share of the sample asks for, in a task of its own. A group has at most ``1.5 * sqrt(lists)`` lists.
    """
    rows = vectors.count()
    lists = lists or default_lists(rows)
    n_groups = max(2, math.isqrt(lists))
    share = min(1.0, lists * TRAINING_ROWS_PER_LIST / max(1, rows))
    sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("id", "vector")
    top = F.pmod(F.xxhash64("id", F.lit("top")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, n_groups / lists * 4))
    features = checkpointed(_unit_features(sample.filter(top) if lists > 64 else sample))
    groups = _centres(features, n_groups, seed, iterations)
    grouped = checkpointed(_assign(sample, groups).withColumnRenamed("list_id", "group_id"))
    sizes = {r["group_id"]: r["n"] for r in grouped.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    most = max(1, math.floor(1.5 * math.sqrt(lists)))
    wanted = {g: min(most, max(1, round(lists * n / sum(sizes.values())))) for g, n in sizes.items()}
    ends = np.cumsum([wanted.get(g, 1) for g in range(len(groups))])
    most_rows = TRAINING_ROWS_PER_LIST * most

    def train(key: tuple[int, ...], part: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        units = unit_rows(np.array(part["vector"].tolist(), np.float64))
        rng, k = np.random.default_rng(seed + group), min(wanted[group], len(units))
        centres = units[rng.choice(len(units), k, replace=False)]
        for _ in range(iterations):
            nearest = distances(units, centres).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, units)
            counts = np.bincount(nearest, minlength=k)[:, None]
            centres = np.divide(sums, counts, out=centres.copy(), where=counts > 0)
        ids = (ends[group] - wanted[group] + np.arange(k)).astype(int)
        return pd.DataFrame({"list_id": ids, "group_id": group, "centre": list(centres)})

    # a group trains on a bounded number of its rows, whatever share of all rows it holds
    keep = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, most_rows / n))])
    few = grouped.filter(F.pmod(F.xxhash64("id", F.lit("group")), F.lit(1 << 20)) < keep[F.col("group_id")] * (1 << 20))
    saved = few.select("group_id", "vector").groupBy("group_id").applyInPandas(train, "list_id int, group_id int, centre array<double>")
    saved.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    numbered = [(i, [float(x) for x in centre]) for i, centre in enumerate(groups)]
    tops = vectors.sparkSession.createDataFrame(numbered, "group_id int, centre array<double>")
    tops.coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")
    _write(assigned(marked(vectors), path), path, 0)


@dataclass(frozen=True)
class Centres:
    """Centres of lists by list id, and for a tree the groups' centres and each list's group."""

    lists: np.ndarray
    groups: np.ndarray | None = None
    group_of: np.ndarray | None = None

    def compared(self) -> int:
        """With how many centres a row is compared at most."""
        if self.groups is None:
            return len(self.lists)
        return len(self.groups) + int(np.bincount(self.group_of[self.group_of >= 0]).max())

    def away(self, units: np.ndarray, n_groups: int | None) -> np.ndarray:
        """Distances lists x rows; with ``n_groups`` only to the lists of each row's nearest groups, others infinite."""
        if self.groups is None or n_groups is None or n_groups >= len(self.groups):
            away = distances(self.lists, units)
        else:
            nearest = distances(units, self.groups).argsort(axis=1)[:, :n_groups]
            away = np.full((len(self.lists), len(units)), np.inf)
            for group in np.unique(nearest):
                asked, lists = np.flatnonzero((nearest == group).any(axis=1)), np.flatnonzero(self.group_of == group)
                away[np.ix_(lists, asked)] = distances(self.lists[lists], units[asked])
        if self.group_of is not None:
            away[self.group_of < 0] = np.inf  # ids without a list
        return away


def read_tree(spark: SparkSession, path: str) -> Centres:
    saved = spark.read.parquet(f"{path}/centres").collect()
    groups = stored_table(spark, f"{path}/groups")
    lists = np.zeros((max(r["list_id"] for r in saved) + 1, len(saved[0]["centre"])))
    for row in saved:
        lists[row["list_id"]] = row["centre"]
    if groups is None:
        return Centres(lists)
    group_of = np.full(len(lists), -1)
    for row in saved:
        group_of[row["list_id"]] = row["group_id"]
    return Centres(lists, np.array([r["centre"] for r in groups.orderBy("group_id").collect()]), group_of)


def read_radii(spark: SparkSession, path: str, lists: int) -> np.ndarray:
    """The radius of every list over all versions; 0 for lists without rows."""
    radius = np.zeros(lists)
    for row in spark.read.parquet(f"{path}/radii").groupBy("list_id").agg(F.max("radius").alias("radius")).collect():
        radius[row["list_id"]] = row["radius"]
    return radius


def best_scores(away: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The best cosine that a list can offer a question ``away`` from its centre, lists x questions."""
    gap = np.minimum(np.maximum(away - radius[:, None], 0.0), 2.0)
    return 1.0 - gap * gap / 2.0


def assigned(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``away, list_id``: through the groups where the index has them."""
    tree = read_tree(rows.sparkSession, path)
    if tree.groups is None:
        return _assign(rows, tree.lists)
    added = [T.StructField("away", T.DoubleType()), T.StructField("list_id", T.IntegerType())]
    schema = T.StructType([*rows.schema.fields, *added])
    arrow = to_arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        filled = np.unique(known.group_of[known.group_of >= 0])
        for batch in batches:
            table = usable(pa.Table.from_batches([batch]), "id")
            if not table.num_rows:
                continue
            units = unit_rows(dense_matrix(table.column("vector")))
            group = filled[distances(units, known.groups[filled]).argmin(axis=1)]
            away, nearest = np.empty(len(units)), np.empty(len(units), np.int32)
            for g in np.unique(group):
                at, lists = np.flatnonzero(group == g), np.flatnonzero(known.group_of == g)
                far = distances(units[at], known.lists[lists])
                nearest[at], away[at] = lists[far.argmin(axis=1)], far.min(axis=1)
            table = table.append_column("away", pa.array(away)).append_column("list_id", pa.array(nearest))
            yield from table.select(arrow.names).cast(arrow).to_batches()

    return rows.mapInArrow(run, schema)


def refresh_index(vectors: DataFrame, path: str) -> None:
    """Bring the index up to date with ``vectors``: new and changed rows are added as the next
    version, the former rows of changed and removed ids are noted as gone. The centres stay.

    Only ids and marks are compared, so vectors that are indexed already are not shuffled.
    """
    spark = vectors.sparkSession
    known, wanted = read_index(spark, path).select("id", MARK), marked(vectors)
    version = next_version(spark, path, "lists")
    new = checkpointed(wanted.select("id", MARK).join(known, ["id", MARK], "left_anti"))
    gone = checkpointed(known.join(wanted.select("id", MARK), ["id", MARK], "left_anti").select("id").distinct())
    if not gone.isEmpty():
        gone.write.parquet(f"{path}/gone/before={version}")
    if not new.isEmpty():
        rows = wanted.join(new.select("id").distinct(), "id", "left_semi")
        _write(assigned(rows, path), path, version)


def next_version(spark: SparkSession, path: str, rows: str) -> int:
    """The number of the next refresh: beyond every batch of rows and every note of removed ids."""
    noted = stored_table(spark, f"{path}/gone")
    last = [spark.read.parquet(f"{path}/{rows}").agg(F.max("version")).first()[0]]
    if noted is not None:
        last.append(noted.agg(F.max("before")).first()[0])
    return 1 + max(v for v in last if v is not None)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The current rows with ``away, list_id``; a filter on ``list_id`` prunes folders."""
    rows, gone = spark.read.parquet(f"{path}/lists"), stored_table(spark, f"{path}/gone")
    if gone is not None:
        last = gone.groupBy("id").agg(F.max("before").alias("_before"))
        rows = rows.join(last, "id", "left").filter(F.col("_before").isNull() | (F.col("version") >= F.col("_before")))
        rows = rows.drop("_before")
    return rows.drop("version")


def search_index(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int = 5,
    nprobe: int | None = None,
    filters: Mapping[str, Any] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    groups: int | None = None,
) -> DataFrame:
    """``question_id, id, score, rank``.

    With ``nprobe`` each question reads that many nearest lists (approximate); in an index with two levels it
    meets only the lists of its ``groups`` nearest groups (by default as many as hold about three times ``nprobe`` lists). Without it the
    nearest list gives a first k-th score, then only lists whose bound reaches that score are
    read (exact). Filters apply before scoring. Question sets beyond the broadcast limit are
    searched block by block, each in the same way.
    """
    index, centres = read_index(spark, path), read_tree(spark, path)
    if nprobe is not None and groups is None and centres.groups is not None:
        groups = max(2, math.ceil(3 * nprobe * len(centres.groups) / len(centres.lists)))
    if filters is not None:
        index = index.filter(compile_filter(filters, index.schema))
    questions = questions.select("question_id", "vector")
    blocks = max(1, math.ceil(question_bytes(questions, 16 * len(centres.lists)) / broadcast_bytes))
    if blocks > 1:
        questions = checkpointed(questions)
    found = []
    for block in range(blocks):
        chosen = questions if blocks == 1 else questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        found.append(_search_block(spark, path, index, centres, chosen, k, nprobe, groups))
    return functools.reduce(DataFrame.unionByName, found)


def _search_block(
    spark: SparkSession, path: str, index: DataFrame, centres: Centres, questions: DataFrame, k: int, nprobe: int | None, groups: int | None
) -> DataFrame:
    table = usable(questions.toArrow(), "question_id")
    if not table.num_rows:
        return search(index.limit(0), questions, k, kind=DENSE)
    schema, arrow = hit_schema(questions.schema["question_id"].dataType, index.schema["id"].dataType)
    away = centres.away(unit_rows(dense_matrix(table.column("vector"))), groups if nprobe is not None else None)

    def probe(allowed: np.ndarray) -> DataFrame:
        wanted = [int(i) for i in np.flatnonzero(allowed.any(axis=1))]
        rows = index.filter(F.col("list_id").isin(wanted)).select("id", "vector", "list_id")
        return rank_hits(scan_scores(rows, table, k, DENSE, schema, arrow, allowed), k)

    nearest = (away.argsort(axis=0).argsort(axis=0) < (nprobe or 1)) & np.isfinite(away)
    first = probe(nearest)
    if nprobe is not None:
        return first

    floor = np.full(len(table), -np.inf)
    position = {q: i for i, q in enumerate(table.column("question_id").to_pylist())}
    for row in first.filter(F.col("rank") == k).select("question_id", "score").collect():
        floor[position[row["question_id"]]] = row["score"]
    return probe(best_scores(away, read_radii(spark, path, len(centres.lists))) >= floor[None, :] - ROUNDING)
