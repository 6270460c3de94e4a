"""Knowledge bases and models as views and functions of SQL text.

``register_base`` gives a base's rows as a view and two functions: a score of a row's vector and a question, to be
used with any filter of the view's columns, and a table function of the best rows. ``register_model`` gives a fitted
model as a function of a text. All live as long as the session, are run over Arrow batches, and shuffle nothing but
the best rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import bucket_sql
from lorekeep.operators import models
from lorekeep.operators.kb import Base
from lorekeep.operators.kernels import bag_entries, cosine, dense_matrix
from lorekeep.operators.search import VectorKind


ROWS_PER_SLICE = 512  # of an Arrow batch: what a task holds beside the batch does not grow with it


def _name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"{name!r} is no name of letters, digits and underscores")
    return name


def pair_scores(kind: VectorKind) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Cosines of two vector columns row by row, as a search gives them; NULL where they do not match."""
    weights = None if kind.weights is None else np.asarray(kind.weights, np.float64)

    def bags(rows: pa.ChunkedArray, asked: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (row, bucket, weight, norm), (at, wanted, asked_weight, asked_norm) = (bag_entries(c, weights) for c in (rows, asked))
        width = int(max(bucket.max(initial=0), wanted.max(initial=0))) + 1
        _, left, right = np.intersect1d(row * width + bucket, at * width + wanted, assume_unique=True, return_indices=True)
        dots = np.bincount(row[left], weights=weight[left] * asked_weight[right], minlength=len(rows)).astype(np.float64)
        return dots, norm * asked_norm, dots > 0

    def dense(rows: pa.ChunkedArray, asked: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = dense_matrix(rows), dense_matrix(asked)
        scale = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
        return (a * b).sum(axis=1), scale, scale > 0

    def score(rows: pa.Array, asked: pa.Array) -> pa.Array:
        slices = [some(rows.slice(at, ROWS_PER_SLICE), asked.slice(at, ROWS_PER_SLICE)) for at in range(0, max(1, len(rows)), ROWS_PER_SLICE)]
        return pa.concat_arrays(slices)

    def some(rows: pa.Array, asked: pa.Array) -> pa.Array:
        known = np.flatnonzero(rows.is_valid().to_numpy(False) & asked.is_valid().to_numpy(False))
        out, found = np.zeros(len(rows)), np.zeros(len(rows), bool)
        if len(known):
            pairs = [pa.chunked_array([c.take(pa.array(known))]) for c in (rows, asked)]
            dots, scale, found[known] = (dense if kind.dense else bags)(*pairs)
            out[known] = cosine(dots, scale)
        return pa.array(out, mask=~found)

    return score


def register_base(spark: SparkSession, base: Base, name: str) -> None:
    """The view ``name`` (id, content, vector, metadata), ``name_score(vector, question)`` and the table function
    ``name_search(question, k)`` (id, content, score, rank).

    Questions are texts for a base of hashed terms; a base with an embedder of its own takes question vectors. Filters
    before the ranking are written with the score::

        SELECT id, name_score(vector, 'warranty') AS score FROM name
        WHERE lang = 'en' AND name_score(vector, 'warranty') IS NOT NULL ORDER BY score DESC, id LIMIT 5

    The base is read as it is when this is called; NULL questions match nothing.
    """
    rows = base.rows()
    rows.createOrReplaceTempView(_name(name))
    vector = rows.schema["vector"].dataType
    spark.udf.register(f"{name}_cosine", F.arrow_udf(pair_scores(base.kind), "double"))
    asked = vector.simpleString() if base.embedder is not None else "string"
    embedded = "question" if base.embedder is not None else bucket_sql("question", base.dim)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_score(vector {vector.simpleString()}, question {asked}) "
        f"RETURNS DOUBLE RETURN {name}_cosine(vector, {embedded})"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_search(question {asked}, k INT) "
        f"RETURNS TABLE (id {rows.schema['id'].dataType.simpleString()}, content STRING, score DOUBLE, rank BIGINT) RETURN "
        f"SELECT id, content, score, rank FROM (SELECT id, content, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank "
        f"FROM (SELECT id, content, {name}_score(vector, question) AS score FROM {name}) WHERE score IS NOT NULL AND id IS NOT NULL) WHERE rank <= k"
    )


def register_model(spark: SparkSession, path: str, name: str, version: int | None = None) -> None:
    """The stored naive Bayes model at ``path`` as the function ``name(text)``, by default its latest version.

    It predicts as ``predict_model`` does. Classes are met in blocks, each a function that keeps the better class.
    """
    made = models.definition(spark, path)
    if made["kind"] == "classifier":
        raise ValueError("only naive Bayes models are functions; predict_model applies the others")
    model = models.load_version(spark, made["target"], path, version, made["dim"])
    step = max(1, models.BLOCK_NUMBERS // model.dim)
    body = "NULL"
    for first in range(0, len(model.classes), step):
        last = min(first + step, len(model.classes))
        shared = spark.sparkContext.broadcast((first, np.array(model.priors[first:last]), model.log_probs(first, last)))
        block = f"{_name(name)}_{first}"
        if first == 0:
            spark.udf.register(block, F.arrow_udf(models.first_best(shared), models.BEST))
            body = f"{block}({bucket_sql("coalesce(text, '')", model.dim)})"
        else:
            spark.udf.register(block, F.arrow_udf(models.next_best(shared), models.BEST))
            body = f"{block}({bucket_sql("coalesce(text, '')", model.dim)}, {body})"
    classes = spark.sparkContext.broadcast(model.classes)
    spark.udf.register(f"{name}_label", F.arrow_udf(models.labels(classes, model.kind), model.kind))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {model.kind.simpleString()} RETURN {name}_label({body})")
