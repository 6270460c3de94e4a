"""Models fitted from a query and applied to tables.

A fitted naive Bayes model is a table (classes x hash buckets) of whole numbers. It is applied in
an Arrow pass per block of classes: prediction needs no join and no shuffle, filters still reach
the scan, and sums of whole numbers do not depend on the order of rows or partitions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.functions.prompt import render
from lorekeep.functions.text import DEFAULT_DIM, TOKEN_BREAK, bucket, each, term_buckets, tokens
from lorekeep.session import checkpointed, stored_table, union_all

LOG_SCALE = 1_000_000
BLOCK_NUMBERS = 4_000_000
GATHERED_NUMBERS = 1_000_000  # logarithms that a task holds at a time, 8 MB
BEST = T.StructType([T.StructField("score", T.LongType()), T.StructField("class", T.IntegerType())])


def number_array(values: Sequence[int]) -> Column:
    """A constant array, folded into the plan once."""
    return F.from_json(F.lit(json.dumps(list(values))), T.ArrayType(T.LongType()))


def class_counts(labelled: DataFrame, text: str, target: str) -> DataFrame:
    """``target, n_tokens, n_docs`` per class."""
    return labelled.groupBy(target).agg(
        F.sum(F.size(tokens(text))).alias("n_tokens"), F.count("*").alias("n_docs")
    )


def token_counts(labelled: DataFrame, text: str, target: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """``target, bucket, n``: at most classes x ``dim`` rows, summed before the shuffle."""
    return (
        labelled.select(target, each(tokens(text)).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy(target, bucket(F.col("token"), dim).cast("bigint").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


@dataclass(frozen=True)
class NaiveBayes:
    """Multinomial naive Bayes with add-one smoothing over hash buckets.

    Classes, priors and totals are small; the counts stay a stored table (class number, bucket,
    n) and are met in blocks of classes of at most ``BLOCK_NUMBERS`` numbers.
    """

    classes: tuple[Any, ...]
    priors: tuple[int, ...]
    totals: tuple[int, ...]
    counts: DataFrame = field(compare=False, repr=False)
    kind: T.DataType
    dim: int

    def log_probs(self, first: int, last: int) -> np.ndarray:
        """Scaled logarithms of the bucket probabilities, buckets x classes ``first`` to ``last``."""
        rows = self.counts.filter(F.col("class").between(first, last - 1)).toArrow()
        table = np.zeros((self.dim, last - first))
        at = [rows.column(c).to_numpy() for c in ("bucket", "class", "n")]
        table[at[0], at[1] - first] = at[2]
        smoothed = (table + 1) / (np.array(self.totals[first:last]) + self.dim)
        return np.floor(np.log(smoothed) * LOG_SCALE + 0.5).astype(np.int64)

    def transform(self, df: DataFrame, text: str, out: str = "prediction", block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
        """One row out for every row in, with the most likely class; texts without tokens get the
        most frequent one, ties go to the class that sorts first. No shuffle, filters still reach the
        scan; each block of classes is one more Arrow pass that keeps the better class. Only bags go through Python."""
        spark = df.sparkSession
        step = max(1, block_numbers // self.dim)
        kept = [c for c in df.columns if c != out]
        rows = df.withColumn("_bag", term_buckets(F.coalesce(F.col(text), F.lit("")), self.dim))
        for first in range(0, len(self.classes), step):
            last = min(first + step, len(self.classes))
            block = spark.sparkContext.broadcast((first, np.array(self.priors[first:last]), self.log_probs(first, last)))
            best = F.arrow_udf(next_best(block), BEST)("_bag", "_best") if first else F.arrow_udf(first_best(block), BEST)("_bag")
            rows = rows.withColumn("_best", best)
        label = F.arrow_udf(labels(spark.sparkContext.broadcast(self.classes), self.kind), self.kind)
        return rows.select(*[F.col(f"`{c}`") for c in kept], label("_best").alias(out))


def _token_sums(values: np.ndarray, ends: np.ndarray, logs: np.ndarray, numbers: int = GATHERED_NUMBERS) -> np.ndarray:
    """Per row the sum of ``logs`` over its buckets ``values[ends[row] : ends[row + 1]]``.

    Many rows at a time, as long as ``numbers`` hold their tokens; a longer row is counted by bucket.
    """
    sums = np.zeros((len(ends) - 1, logs.shape[1]), logs.dtype)
    step, row = max(1, numbers // logs.shape[1]), 0
    while row < len(sums):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + step, "right")) - 1)
        part = values[ends[row] : ends[last]]
        if len(part) > step:
            sums[row] = np.bincount(part, minlength=len(logs)) @ logs
        elif len(part):
            some = row + np.flatnonzero(np.diff(ends[row : last + 1]))
            sums[some] = np.add.reduceat(logs[part], ends[some] - ends[row], axis=0)
        row = last
    return sums


def best_class(bags: pa.Array, priors: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best score of every bag over a block of classes and the class that has it, counted within the block."""
    values = bags.flatten().to_numpy(zero_copy_only=False)  # no owner of each value: ends of the rows say it
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(bags).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    scores = np.tile(priors, (len(bags), 1)) + _token_sums(values, ends, logs)
    return scores.max(axis=1, initial=np.iinfo(np.int64).min), scores.argmax(axis=1)


def _struct(score: np.ndarray, number: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(score.astype(np.int64)), pa.array(number.astype(np.int32))], ["score", "class"])


def first_best(shared):
    """The best class of every bag among those of the first block."""

    def run(bags: pa.Array) -> pa.Array:
        _, priors, logs = shared.value
        return _struct(*best_class(bags, priors, logs))

    return run


def next_best(shared):
    """The class found before, or a better one of this block; blocks come in the classes' order."""

    def run(bags: pa.Array, before: pa.Array) -> pa.Array:
        first, priors, logs = shared.value
        score, which = best_class(bags, priors, logs)
        old, old_class = (before.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        better = score > old
        return _struct(np.where(better, score, old), np.where(better, which + first, old_class))

    return run


def labels(classes, kind: T.DataType):
    """The labels of numbered classes."""
    arrow = to_arrow_type(kind)

    def run(best: pa.Array) -> pa.Array:
        return pa.array(classes.value, arrow).take(best.field(1))

    return run


def _scaled_log(x: float) -> int:
    return math.floor(math.log(x) * LOG_SCALE + 0.5)


def naive_bayes_from_counts(classes: DataFrame, counts: DataFrame, target: str, dim: int) -> NaiveBayes:
    """A model from ``target, n_docs`` and stored ``target, bucket, n`` rows. One row per class reaches
    the driver; the counts do so in blocks, when the model is applied."""
    known = F.col(target).isNotNull()
    sums = counts.filter(known).groupBy(target).agg(F.sum("n").alias("total"))
    found = classes.filter(known).select(target, "n_docs").join(sums, target, "left").collect()
    if not found:
        raise ValueError(f"no labelled rows in column {target!r}")
    found = sorted(found, key=lambda r: r[target])
    kind = classes.schema[target].dataType
    numbers = classes.sparkSession.createDataFrame([(r[target], i) for i, r in enumerate(found)], T.StructType([T.StructField(target, kind), T.StructField("class", T.IntegerType())]))
    total = sum(r["n_docs"] for r in found)
    return NaiveBayes(
        classes=tuple(r[target] for r in found),
        priors=tuple(_scaled_log(r["n_docs"] / total) for r in found),
        totals=tuple(r["total"] or 0 for r in found),
        counts=checkpointed(counts.join(numbers, target).select("class", "bucket", "n")),
        kind=kind,
        dim=dim,
    )


def fit_naive_bayes(labelled: DataFrame, text: str, target: str, dim: int = DEFAULT_DIM) -> NaiveBayes:
    classes = checkpointed(labelled.groupBy(target).agg(F.count("*").alias("n_docs")))
    return naive_bayes_from_counts(classes, checkpointed(token_counts(labelled, text, target, dim)), target, dim)


def fit_version(labelled: DataFrame, text: str, target: str, path: str, version: int,
                dim: int = DEFAULT_DIM) -> None:
    """Fit on the current rows and store the counts as a new version.

    The class table is written last: readers move to the new version once it is complete.
    """
    counts = token_counts(labelled, text, target, dim)
    counts.write.mode("overwrite").parquet(f"{path}/tokens/version={version}")
    _write_classes(labelled.groupBy(target).agg(F.count("*").alias("n_docs")), path, version)


def _write_classes(classes: DataFrame, path: str, version: int, batch: str | None = None) -> None:
    """The classes of a version, which make it the latest, and the batch of differences that it took."""
    classes.withColumn(BATCH, F.lit(batch).cast("string")).write.mode("overwrite").parquet(f"{path}/classes/version={version}")


def refit(spark: SparkSession, query: str, text: str, target: str, path: str, version: int,
          dim: int = DEFAULT_DIM) -> None:
    """Run the stored training query again and write the next version."""
    fit_version(spark.sql(query), text, target, path, version, dim)


def load_version(spark: SparkSession, target: str, path: str, version: int | None = None,
                 dim: int = DEFAULT_DIM) -> NaiveBayes:
    """A stored version, by default the latest complete one."""
    classes = spark.read.parquet(f"{path}/classes")
    if version is None:
        version = classes.agg(F.max("version")).first()[0]
    counts = spark.read.parquet(f"{path}/tokens")
    at = F.col("version") == version
    return naive_bayes_from_counts(classes.filter(at), counts.filter(at), target, dim)


BATCH = "_batch"
DEFINITION = "query string, text string, target string, dim int, kind string"


def create_model(spark: SparkSession, path: str, query: str, text: str, target: str,
                 dim: int = DEFAULT_DIM, kind: str = "bayes") -> None:
    """Store a model's training query and parameters below ``path`` and fit version 1.

    ``kind`` is ``bayes`` (naive Bayes) or ``classifier`` (``fit_classifier``).
    """
    if kind not in ("bayes", "classifier"):
        raise ValueError(f"there is no kind of model {kind!r}")
    if stored_table(spark, f"{path}/definition") is not None:
        raise ValueError(f"there is a model at {path}")
    made = [(query, text, target, dim, kind)]
    spark.createDataFrame(made, DEFINITION).coalesce(1).write.parquet(f"{path}/definition")
    refit_model(spark, path)


def definition(spark: SparkSession, path: str) -> Row:
    """Training query, columns and parameters of the model at ``path``."""
    return spark.read.schema(DEFINITION).parquet(f"{path}/definition").first()


def _last_version(spark: SparkSession, path: str) -> int:
    known = stored_table(spark, f"{path}/classes")
    return 0 if known is None else known.agg(F.max("version")).first()[0]


def refit_model(spark: SparkSession, path: str) -> int:
    """Run the stored training query again and write the next version; returns its number."""
    made, version = definition(spark, path), _last_version(spark, path) + 1
    labelled = spark.sql(made["query"])
    if made["kind"] == "classifier":
        fitted = fit_classifier(labelled, made["text"], made["target"], made["dim"])
        fitted.write().overwrite().save(f"{path}/fitted/{version}")
        _write_classes(labelled.groupBy(made["target"]).agg(F.count("*").alias("n_docs")), path, version)
    else:
        fit_version(labelled, made["text"], made["target"], path, version, made["dim"])
    return version


def refit_delta(spark: SparkSession, path: str, batch: str, added: DataFrame | None, removed: DataFrame | None = None) -> int:
    """The next version of a naive Bayes model from differences only; returns its number.

    ``added`` are new labelled rows and the new form of changed ones, ``removed`` the former rows of changed and
    removed ones, with the text and target columns of the training query. Their counts are added to and taken from
    those of the latest version, so the result equals a fit on all rows as they are now and reads none of the old ones.
    A ``batch`` counts once: its name is stored with the version it makes, so a lost one is done again and a repeated
    one changes nothing.
    A class that has lost its last row is gone; removing rows that the model never counted raises.
    """
    made = definition(spark, path)
    if made["kind"] == "classifier":
        raise ValueError("only counts can be refitted from differences")
    done = stored_table(spark, f"{path}/classes", f"version int, {BATCH} string").filter(F.col(BATCH) == batch).agg(F.max("version")).first()[0]
    if done is not None:
        return done
    last = _last_version(spark, path)
    text, target, dim, version = made["text"], made["target"], made["dim"], last + 1
    parts = [(rows.select(text, target), sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]

    at = F.col("version") == last
    tokens_then = spark.read.parquet(f"{path}/tokens").filter(at).select(target, "bucket", "n")
    classes_then = spark.read.parquet(f"{path}/classes").filter(at).select(target, "n_docs")
    signed = lambda counts, n, sign: counts.withColumn(n, F.col(n) * sign)
    tokens_now = union_all([tokens_then, *(signed(token_counts(rows, text, target, dim), "n", sign) for rows, sign in parts)])
    classes_now = union_all(
        [classes_then, *(signed(rows.groupBy(target).agg(F.count("*").alias("n_docs")), "n_docs", sign) for rows, sign in parts)]
    )
    counts = checkpointed(tokens_now.groupBy(target, "bucket").agg(F.sum("n").alias("n")).filter("n <> 0"))
    classes = checkpointed(classes_now.groupBy(target).agg(F.sum("n_docs").alias("n_docs")).filter("n_docs <> 0"))
    if not (counts.filter("n < 0").isEmpty() and classes.filter("n_docs < 0").isEmpty()):
        raise ValueError("rows were removed that the model was not fitted on")
    if classes.isEmpty():
        raise ValueError("no labelled rows are left")
    counts.write.mode("overwrite").parquet(f"{path}/tokens/version={version}")
    _write_classes(classes, path, version, batch)
    return version


def predict_model(spark: SparkSession, path: str, df: DataFrame, text: str, out: str = "prediction",
                  version: int | None = None) -> DataFrame:
    """Apply a stored model, by default its latest version."""
    made = definition(spark, path)
    if made["kind"] != "classifier":
        return load_version(spark, made["target"], path, version, made["dim"]).transform(df, text, out)
    version = version or _last_version(spark, path)
    fitted = PipelineModel.load(f"{path}/fitted/{version}")
    kind = spark.read.parquet(f"{path}/classes").schema[made["target"]].dataType
    clash = set(df.columns) & {"_text", "_tokens", "_tf", "_features", "rawPrediction", "probability", "prediction", "predicted", made["text"]} - {text, out}
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with those of the classifier")
    rows = df.drop(out).withColumn("_text", F.col(text))
    asked = rows.withColumn(made["text"], F.coalesce(F.col(text), F.lit("")))
    found = fitted.transform(asked)
    label = found["predicted"] if "predicted" in found.columns else found["prediction"].cast(kind)
    restored = [F.col("_text").alias(c) if c == text else F.col(c) for c in df.columns if c != out]
    return found.select(*restored, label.alias(out))


def fit_classifier(labelled: DataFrame, text: str, target: str, dim: int = DEFAULT_DIM,
                   iterations: int = 10) -> PipelineModel:
    """Hashed TF-IDF and logistic regression from MLlib.

    Text targets are numbered in their order; the fitted model then adds ``predicted``, the text,
    beside ``prediction``. Rows without a target are left out. ``fitted.write().save(path)`` stores it.
    """
    rows = labelled.select(text, target).filter(F.col(target).isNotNull())
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_BREAK),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_features"),
    ]
    if not isinstance(rows.schema[target].dataType, T.StringType):
        return Pipeline(stages=[*stages, LogisticRegression(featuresCol="_features", labelCol=target, maxIter=iterations)]).fit(rows)
    index = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    trained = Pipeline(stages=[*stages, LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=iterations)]).fit(index.transform(rows))
    return PipelineModel([*trained.stages, IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)])


def render_prompts(df: DataFrame, template: str, out: str = "prompt") -> DataFrame:
    return df.withColumn(out, render(template, df.columns))


def generate(df: DataFrame, model: Callable[[pd.Series], pd.Series], prompt: str = "prompt",
             out: str = "answer") -> DataFrame:
    """Add ``out`` from a user model that maps a batch of prompts to texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: model(batch[prompt])})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def predict_rows(spark: SparkSession, rows: Sequence[tuple], schema: str, model: NaiveBayes, text: str,
                 out: str = "prediction") -> DataFrame:
    """Predict for literal input rows."""
    return model.transform(spark.createDataFrame(list(rows), schema), text, out)
